"""Landed feed payloads to raw articles.

A payload row is one feed document from one poll: `payload_id` (unique), `source_id`, `fetched_at`,
`payload`. Payloads may come from files (`read_payloads`), from a table, or from a stream; every function below works
on both batch and streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, bind
from ..functions.urls import normalize_url

_PREFIX = r"(?:[A-Za-z_][\w.-]*:)?"
_OPEN = rf"(?i)(?=<{_PREFIX}(?:item|entry)(?:\s[^>]*)?(?<!/)>)"
_CLOSE = rf"(?is)</{_PREFIX}(?:item|entry)\s*>.*\z"
# Comments and CDATA sections in one pattern: whichever opens first covers the other. Else a run of text, or a tag and what follows.
_PIECE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?(?:\]\]>|\z)|[^<]++|<[^<]*+"
_CHUNK = r"[^<]++|<[^<]*+"
_NAME = r"^</?([A-Za-z_][\w.-]*(?::[\w.-]+)?)(?=[\s/>])"
# Elements of the feed formats whose content is text: any markup in them belongs to the text.
TEXTS = (
    "title link description name email uri category comments guid pubdate id published updated summary content rights "
    "content:encoded dc:date dc:creator").split()
# Elements that hold others.
HOLDERS = "item entry author contributor source enclosure".split()
# An entry whose elements, in the usual case, hold nothing but text: as most are, and nothing in it can be misread.
_FLAT = (
    r"(?s)^<(?:item|entry)(?:\s[^<>]*)?>[^<]*+"
    r"(?:<([a-z][a-z0-9.:_-]*|pubDate)(?:\s[^<>]*)?(?:(?<=/)>|(?<!/)>[^<]*+</\1\s*>)[^<]*+)*+$")
_BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});)"
# Characters that XML forbids, and references to them.
_FORBIDDEN = (
    r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
    r"|&#(?:0*(?:[0-8]|1[124-9]|2[0-9]|3[01])|[xX]0*(?:[0-8bcefBCEF]|1[0-9a-fA-F]));")

_TERM = "array<struct<_VALUE:string,_term:string>>"
_BODY = "struct<_VALUE:string,_type:string>"
ENTRY_SCHEMA = f"""
    title string, link array<struct<_VALUE:string,_href:string,_rel:string>>,
    guid struct<_VALUE:string,_isPermaLink:string>, id string,
    pubDate string, published string, updated string, `dc:date` string,
    description string, summary {_BODY}, content {_BODY}, `content:encoded` string,
    author struct<_VALUE:string,name:string>, `dc:creator` string,
    category {_TERM}, _corrupt_record string
"""

# Entry fields a mapping may read, after RSS and Atom spellings are brought together.
# `entry_xml` is the whole entry: a mapping reads other elements from it, and it is kept in the raw payload.
ENTRY_FIELDS = (
    "title", "link", "published", "updated", "summary", "description", "author", "terms", "entry_xml")


def read_payloads(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """One row per landed file; the file name without its suffix is the source id."""
    return _with_source(spark.read.options(wholetext=True, pathGlobFilter=glob).text(path))


def stream_payloads(spark: SparkSession, path: str, glob: str = "*.xml", files_per_batch: int = 1000) -> DataFrame:
    """As `read_payloads`, for files that keep arriving."""
    reader = spark.readStream.options(
        wholetext=True, pathGlobFilter=glob, maxFilesPerTrigger=files_per_batch)
    return _with_source(reader.text(path))


def _with_source(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(
        F.col("_metadata.file_path").alias("payload_id"),
        F.regexp_replace(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", ""), "__.*$", "").alias("source_id"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("payload"),
    )


def _plain(payload: Column) -> Column:
    """The payload with CDATA sections as escaped text and without comments and forbidden characters, so that a tag in it is a tag."""
    escaped = lambda t: F.replace(F.replace(F.replace(
        t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    comment, section = r"(?s)^<!--.*-->$", r"^<!\[CDATA\["
    inner = lambda p: F.regexp_replace(F.regexp_replace(p, section, ""), r"\]\]>$", "")
    pieces = F.regexp_extract_all(payload, F.lit(_PIECE), 0)
    told = F.transform(pieces, lambda p: F.when(p.rlike(comment), "").when(p.rlike(section), escaped(inner(p))).otherwise(p))
    plain = F.when(payload.rlike(r"<!--|<!\[CDATA\["), F.array_join(told, "")).otherwise(payload)
    return F.regexp_replace(plain, _FORBIDDEN, "")


def _entries(payload: Column) -> Column:
    """The entries of a payload as text. An entry ends at its closing tag or, without one, at the next entry."""
    cut = F.split(_plain(payload), _OPEN)
    return F.transform(
        F.filter(cut, lambda p: p.rlike(rf"(?i)^<{_PREFIX}(?:item|entry)[\s>]")),
        lambda p: F.regexp_replace(p, _CLOSE, ""))


def _tag_name(chunk: Column) -> Column:
    return F.lower(F.regexp_extract(chunk, _NAME, 1))


def _marks(chunks: Column) -> Column:
    """One letter per chunk: `t` where it begins with a tag of the entry, `x` where it is text.

    The open text element is carried along. Inside it only its own closing tag counts, and tags of other name spaces are left as
    they are; the same element inside itself is text and has its closing tag there.
    """
    state = F.struct(F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit("").alias("marks"))

    def step(was: Column, chunk: Column) -> Column:
        name, closing = _tag_name(chunk), chunk.startswith("</")
        whole = chunk.rlike(r"^<[^>]*/>")  # opened and closed in one
        inside, same = was["open"] != "", name == was["open"]
        known = name.isin(TEXTS + HOLDERS) | F.contains(name, F.lit(":"))
        ends = inside & same & closing & (was["depth"] == 0)
        begins = ~inside & ~closing & ~whole & name.isin(TEXTS)
        tag = (known & ~inside) | ends | (inside & ~same & F.contains(name, F.lit(":")))
        depth = was["depth"] + F.when(inside & same & ~whole, F.when(closing, F.when(ends, 0).otherwise(-1)).otherwise(1)).otherwise(0)
        return F.struct(
            F.when(ends, "").when(begins, name).otherwise(was["open"]).alias("open"), depth.cast("int").alias("depth"),
            F.concat(was["marks"], F.when(tag & (name != ""), "t").otherwise("x")).alias("marks"))

    return F.aggregate(chunks, state, step, lambda s: s["marks"])


def _sound(entry: Column) -> Column:
    """The entry as XML: its own prefix dropped, names in the usual case, markup in texts and stray ampersands as text, the
    closing tag put back."""
    def spelled(chunk: Column) -> Column:
        name = F.regexp_extract(chunk, _NAME, 1)
        usual = F.when(F.lower(name) == "pubdate", "pubDate").otherwise(F.lower(name))
        start = F.when(chunk.startswith("</"), "</").otherwise("<")
        return F.concat(start, usual, F.substr(chunk, F.length(start) + F.length(name) + 1))

    def rebuilt(chunks: Column) -> Column:
        text = lambda c: F.when(c.startswith("<"), F.concat(F.lit("&lt;"), F.substr(c, F.lit(2)))).otherwise(c)
        return bind(_marks(chunks), lambda marks: F.array_join(F.transform(chunks, lambda c, i: F.when(
            F.substr(marks, i + 1, F.lit(1)) == "t", spelled(c)).otherwise(text(c))), ""))

    def repaired(e: Column) -> Column:
        xml = F.when(e.rlike(_FLAT), e).otherwise(bind(F.regexp_extract_all(e, F.lit(_CHUNK), 0), rebuilt))
        return F.concat(F.regexp_replace(xml, _BARE_AMPERSAND, "&amp;"), F.when(
            e.rlike(r"(?i)^<item[\s>]"), "</item>").otherwise("</entry>"))

    def unprefixed(prefix: Column) -> Column:
        return F.when(prefix == "", entry).otherwise(F.replace(
            F.replace(entry, F.concat(F.lit("<"), prefix), F.lit("<")), F.concat(F.lit("</"), prefix), F.lit("</")))

    return bind(bind(F.regexp_extract(entry, rf"(?i)^<({_PREFIX})(?:item|entry)", 1), unprefixed), repaired)


def feed_scan(payloads: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per entry of every payload, with its place in the payload and its text.

    Entries are cut out before they are parsed, so one broken entry costs only itself. Everyday
    faults are repaired: undeclared entities, bare ampersands, control characters, markup in texts (also with names
    of feed elements), element names in capitals, comments and CDATA that hold each other's openers, a missing
    closing tag. With `keep_empty` nothing is left out: a payload without entries gives one row that holds its
    `payload_error`, and an entry that can't be read, or has no title or link, holds its `entry_error`.
    """
    root = F.from_xml("payload", "version string, _corrupt_record string", {"mode": "PERMISSIVE"})
    sound = root["_corrupt_record"].isNull() & F.contains("payload", F.lit("<"))
    about = [c for c in payloads.columns if c != "payload"]
    cut = payloads.select(*about, "payload", _entries(F.col("payload")).alias("_cut"))
    if keep_empty:
        about.append("payload_error")
        cut = cut.withColumn("payload_error", F.when(
            F.size("_cut") == 0, F.when(sound, "zero_articles").otherwise("malformed_xml")))
    spread = F.posexplode_outer if keep_empty else F.posexplode
    cut = cut.select(*about, spread("_cut").alias("item_pos", "entry_xml"))
    # A generator keeps later filters from running the parser a second time.
    parsed = cut.select("*", F.explode(F.array(
        F.from_xml(_sound(F.col("entry_xml")), ENTRY_SCHEMA, {"mode": "PERMISSIVE"}))).alias("e"))
    links = F.col("e.link")
    alternate = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    first_link = F.coalesce(F.get(alternate, F.lit(0)), F.get(links, F.lit(0)))
    permalink = F.when(F.coalesce(F.col("e.guid._isPermaLink"), F.lit("true")) == "true", F.col("e.guid._VALUE"))
    terms = F.transform(F.col("e.category"), lambda c: F.coalesce(c["_term"], c["_VALUE"]))
    rows = parsed.select(
        *cut.columns, F.col("e._corrupt_record").alias("_corrupt"),
        F.col("e.title").alias("title"),
        F.coalesce(first_link["_href"], first_link["_VALUE"], permalink).alias("link"),
        F.coalesce("e.pubDate", "e.published").alias("published"),
        F.coalesce("e.updated", "e.dc:date").alias("updated"),
        F.col("e.summary._VALUE").alias("summary"),
        F.coalesce("e.description", "e.content:encoded", "e.content._VALUE").alias("description"),
        F.coalesce("e.author.name", "e.author._VALUE", "e.dc:creator").alias("author"),
        F.coalesce(terms, F.array().cast("array<string>")).alias("terms"),
    )
    if not keep_empty:
        return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    error = F.when(F.col("item_pos").isNull(), None).when(F.col("_corrupt").isNotNull(), "UnreadableEntry").when(
        blank("title") | blank("link"), "IncompleteEntry")
    return rows.withColumn("entry_error", error).drop("_corrupt")


def entry_failures(scanned: DataFrame) -> DataFrame:
    """Dead letters of a `feed_scan(keep_empty=True)`: the entries that give no article, with their whole text."""
    unread = F.col("entry_error") == "UnreadableEntry"
    return scanned.filter(F.col("entry_error").isNotNull()).select(
        arrival().alias("seq"), "source_id", F.lit("FETCH").alias("failure_stage"),
        F.col("entry_error").alias("error_type"),
        F.when(unread, "Entry is no readable XML").otherwise("Entry has no title or no link").alias("error_message"),
        F.to_json(F.struct("entry_xml")).alias("raw_payload"))


def feed_outcomes(payloads: DataFrame, scanned: DataFrame) -> DataFrame:
    """Fetch outcome per payload, from its ids and its `feed_scan(keep_empty=True)` rows.

    A payload fails when it gives no article: `malformed_xml` when its markup is broken or an
    entry can't be read, else `zero_articles`.
    """
    usable = F.col("item_pos").isNotNull() & F.col("entry_error").isNull()
    seen = scanned.groupBy("payload_id").agg(
        F.count_if(usable).alias("entries"),
        F.max(F.coalesce("payload_error", F.when(
            F.col("entry_error") == "UnreadableEntry", "malformed_xml"))).alias("_error"))
    found = payloads.select("payload_id", "source_id", "fetched_at").join(seen, "payload_id", "left")
    entries = F.coalesce("entries", F.lit(0))
    return found.select(
        "payload_id", "source_id", "fetched_at", entries.alias("entries"), (entries > 0).alias("ok"),
        F.when(entries == 0, F.coalesce("_error", F.lit("zero_articles"))).alias("error"))


# How entry fields feed a raw article; other source types pass their own mapping.
DEFAULT_MAPPING: Mapping[str, Column | str] = {
    "title": "title",
    "link": "link",
    "published_at_raw": "coalesce(published, updated)",
    "summary": "coalesce(summary, description)",
    "author": "author",
    "terms": "terms",
}


def arrival() -> Column:
    """Total arrival order of entries: the same on every replay of the same payloads."""
    return F.struct("source_id", "fetched_at", "payload_id", "item_pos")


def map_entry(
    entries: DataFrame,
    sources: DataFrame | None = None,
    mapping: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Entries to raw articles; entries without title or link are left out.

    `mapping` overrides single fields with a column or SQL text over the entry. With `sources`
    (id, name, timezone_hint) the source's name and zone are attached; Spark broadcasts that side
    when its measured size allows.
    """
    rules = {**DEFAULT_MAPPING, **(mapping or {})}
    field = {k: F.expr(v) if isinstance(v, str) else v for k, v in rules.items()}
    edges = f"^[{SPACE}]+|[{SPACE}]+$"
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), edges, "")
    kept = [c for c in entries.columns if c not in ENTRY_FIELDS]
    payload = F.to_json(F.struct(*[c for c in entries.columns if c in ENTRY_FIELDS]))
    raw = entries.select(
        *kept,
        trim(field["title"]).alias("title"),
        trim(field["link"]).alias("_link"),
        F.lit(None).cast("string").alias("content"),
        field["summary"].alias("summary"),
        field["author"].alias("author"),
        field["published_at_raw"].alias("published_at_raw"),
        F.get(field["terms"], F.lit(0)).alias("category"),
        F.filter(field["terms"], lambda t: t.isNotNull() & (t != "")).alias("tags"),
        payload.alias("raw_payload"),
    ).filter((F.col("title") != "") & (F.col("_link") != ""))
    raw = raw.withColumn("url", normalize_url(F.col("_link"))).drop("_link")
    if sources is None:
        return raw.withColumns({"source_name": F.col("source_id"), "timezone_hint": F.lit("UTC")})
    about = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), "timezone_hint")
    return raw.join(about, "source_id")


def active_sources(sources: DataFrame) -> DataFrame:
    """Sources the next cycle may read."""
    return sources.filter(
        F.col("is_active")
        & (F.col("circuit_breaker_state") != "OPEN")
        & (F.col("source_type") == "RSS"))
