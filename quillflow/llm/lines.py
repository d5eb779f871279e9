"""Line dedup by site-relative frequency, with built-in functions only.

A line is boilerplate of a site when more than a given share of the site's pages has it. Lines are
counted by hash, once per page; a site has at most (lines per page / share) boilerplate lines, so
each site's list is short however many pages it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RATIO = 0.1
LEAST_PAGES = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(site, boilerplate): the hashes of the lines that more than `ratio` of the site's pages have, and at
    least `least` pages. White space around a line does not count; blank lines are never boilerplate."""
    rows = pages.where(F.col(site).isNotNull()).select(F.col(site).alias("site"), F.col(text).alias("text"))
    totals = rows.groupBy("site").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), line_key))
    counts = rows.where(F.col("text").isNotNull()).select("site", F.explode(keys).alias("line")).groupBy(
        "site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = counts.join(totals, "site").where(F.col("n") > F.col("pages") * ratio)
    # Once grouped by site and line, a site has few rows left.
    return often.groupBy("site").agg(F.collect_list("line").alias("boilerplate"))


def drop_boilerplate(
        pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES,
        protect: bool = True) -> DataFrame:
    """The rows of `pages` without boilerplate lines in `text`, and `dropped_lines`, how many went.

    Repeated rows are pages of their own. Rows without a site or text stay as they are, blank lines
    stay. With `protect`, a text of boilerplate lines only stays whole: there is nothing that they
    accompany. Without, its lines go too; what is left is empty or blank lines, and the row stays.
    Other columns stay; a column named dropped_lines is replaced. No rows give no rows.
    """
    names = [c for c in pages.columns if c != "dropped_lines"]
    # Written first: its exact size then decides about a broadcast, and mostly no text has to be shuffled.
    known = written(boilerplate(pages, site, text, ratio, least), "boilerplate").select(
        F.col("site").alias("_site"), F.col("boilerplate").alias("_boilerplate"))
    rows = pages.select(*[f"`{c}`" for c in names])
    joined = rows.join(known, rows[site] == known["_site"], "left")
    good = lambda x: (F.trim(x) == "") | ~F.array_contains("_boilerplate", line_key(x))
    kept = F.when(F.col("_boilerplate").isNotNull(), F.filter(lines_of(F.col(text)), good))
    all_lines = lines_of(F.col(text))
    joined = joined.withColumn("_kept", kept)
    cut = F.col("_kept").isNotNull() & (F.size("_kept") < F.size(all_lines))
    if protect:
        cut = cut & F.exists("_kept", lambda x: F.trim(x) != "")
    joined = joined.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    return joined.select(
        *[F.when(F.col("_cut"), F.array_join("_kept", "\n")).otherwise(F.col(f"`{c}`")).alias(c) if c == text
          else F.col(f"`{c}`") for c in names],
        F.when(F.col("_cut"), F.size(all_lines) - F.size("_kept")).otherwise(0).cast("long").alias("dropped_lines"))


# Elements that begin or end a line of shown text; a fixed list of HTML names.
BLOCKS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|"
    "li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul")
HIDDEN = r"<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK = rf"</?({BLOCKS})(/|[ \t\r\n][^>]*)?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"


def shown_lines(html: Column) -> Column:
    """The text of a page with one line per block element; entities stay as they are written."""
    html = F.regexp_replace(html, f"(?is){HIDDEN}", " ")
    html = F.regexp_replace(html, f"(?is){BLOCK}", "\n")
    html = F.regexp_replace(html, f"(?is){TAG}", "")
    return F.regexp_replace(html, "[ \t\r]*\n[ \t\r\n]*", "\n")


def host(url: Column) -> Column:
    """Lower-case host of a url; null if it has none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, host, text without the host's boilerplate lines, dropped_lines of (page_id, url, html).

    Also a page of boilerplate only loses its lines. Repeated rows are pages of their own.
    """
    # Read twice, by the counts and by the result: written once, so that no page is taken apart twice.
    rows = written(
        pages.select("page_id", host(F.col("url")).alias("host"), shown_lines(F.col("html")).alias("text")), "lines")
    return drop_boilerplate(rows, "host", "text", protect=False)


def _sql() -> str:
    text = "html"
    text = f"regexp_replace({text}, '{HIDDEN}', ' ', 'gis')"
    text = f"regexp_replace({text}, '{BLOCK}', chr(10), 'gis')"
    text = f"regexp_replace({text}, '{TAG}', '', 'gis')"
    blank = "'[ ' || chr(9) || chr(13) || ']*' || chr(10) || '[ ' || chr(9) || chr(13) || chr(10) || ']*'"
    text = f"regexp_replace({text}, {blank}, chr(10), 'g')"
    return f"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, {text} AS text, row_number() OVER () AS r FROM pages),
l AS (SELECT host, trim(unnest(string_split(text, chr(10))), ' ') AS line, r FROM p WHERE host IS NOT NULL),
c AS (SELECT host, line, count(DISTINCT r) AS n FROM l WHERE line <> '' GROUP BY host, line),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT c.host, list(line) AS bad FROM c JOIN t USING (host) WHERE n >= {LEAST_PAGES} AND n > pages * {RATIO} GROUP BY c.host),
k AS (SELECT page_id, p.host, text, string_split(text, chr(10)) AS lines,
      list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT coalesce(list_contains(bad, trim(x, ' ')), false)) AS kept
      FROM p LEFT JOIN b ON p.host = b.host),
d AS (SELECT *, len(kept) < len(lines) AS cut FROM k)
SELECT page_id, host, CASE WHEN cut THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       CASE WHEN cut THEN len(lines) - len(kept) ELSE 0 END AS dropped_lines
FROM d"""


ORACLE = _sql()
