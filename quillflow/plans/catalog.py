"""Every operator as a query over the given tables, with its SQL oracle.

A query takes (spark, folder of the tables) and gives a DataFrame of plain columns. All of them
read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, stems, text, urls
from ..functions import enrichment as E
from ..operators import articles as A
from ..operators import audit, dedup, enrich, health, maintenance, quality, runs, search, summaries, trends
from ..session import DEFAULTS, scratch_dir, written
from ..sources import feeds, tables
from ..sources.keys import KeyIndex
from ..sources.segments import SegmentedTable, cascade_delete
from ..streaming import jobs
from . import fixtures as X
from .ingest import ingest_cycle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Row groups of landed files are small, so that all cores share a micro-batch of few files.
LANDED = {"parquet.block.size": str(4 << 20)}


def plain(rows: DataFrame) -> DataFrame:
    """Timestamps without zone, which is how the oracle shows them."""
    return rows.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in rows.schema.fields])


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])
            return plain(fn(spark, sf))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def with_views(*views: str, select: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select




def now():
    return X.instant(X.AS_OF)


def gate_now():
    return X.instant(X.GATE_AS_OF)


TS = f"TIMESTAMP '{X.AS_OF}'"

# --- Scans and sources -------------------------------------------------------------------------


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_scan(X.payloads(spark, sf))


FEED_ORACLE = with_views(X.ARTICLES, select=r"""
SELECT source_name AS source_id, source_name || '-' || lpad(CAST(id // 100 AS VARCHAR), 9, '0') AS payload_id,
       CAST(row_number() OVER (PARTITION BY source_name, id // 100 ORDER BY id) - 1 AS INTEGER) AS item_pos,
       trim(title) AS title, url || '?utm_source=rss' AS link,
       strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS published,
       trim(coalesce(summary, body), ' ' || chr(10) || chr(13) || chr(9)) AS description,
       category || ',news' AS terms
FROM articles""")


@query("feed_scan", FEED_ORACLE)
def _(spark, sf):
    return _entries(spark, sf).select(
        "source_id", "payload_id", "item_pos", "title", "link", "published", "description",
        F.array_join("terms", ",").alias("terms"))


@query("map_entry", with_views(X.ARTICLES, select=r"""
SELECT source_name AS source_id, trim(title) AS title, url,
       trim(coalesce(summary, body), ' ' || chr(10) || chr(13) || chr(9)) AS summary,
       strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS published_at_raw,
       category, category || ',news' AS tags, url || '?utm_source=rss' AS payload_link
FROM articles"""))
def _(spark, sf):
    return feeds.map_entry(_entries(spark, sf)).select(
        "source_id", "title", "url", "summary", "published_at_raw", "category",
        F.array_join("tags", ",").alias("tags"),
        F.get_json_object("raw_payload", "$.link").alias("payload_link"))


@query("entry_mapper", with_views(X.ARTICLES, select=r"""
SELECT url, lower(trim(title)) AS title, 'newsroom' AS author FROM articles"""))
def _(spark, sf):
    own = {"title": "lower(title)", "author": F.coalesce(F.col("author"), F.lit("newsroom"))}
    return feeds.map_entry(_entries(spark, sf), mapping=own).select("url", "title", "author")


@query("feed_outcomes", with_views(X.ARTICLES, select="""
SELECT payload_id, CASE WHEN poll % 5 < 3 THEN n ELSE 0 END AS entries, poll % 5 < 3 AS ok,
       CASE poll % 5 WHEN 3 THEN 'zero_articles' WHEN 4 THEN 'malformed_xml' END AS error
FROM (SELECT source_name || '-' || lpad(CAST(id // 100 AS VARCHAR), 9, '0') AS payload_id, id // 100 AS poll, count(*) AS n
      FROM articles GROUP BY ALL)"""))
def _(spark, sf):
    poll = F.element_at(F.split("payload_id", "-"), -1).cast("bigint") % 5
    payloads = X.payloads(spark, sf).withColumn("payload", F.when(
        poll == 3, "<rss><channel></channel></rss>").when(poll == 4, "<rss><channel>").otherwise(F.col("payload")))
    return feeds.feed_outcomes(payloads, feeds.feed_scan(payloads, keep_empty=True)).select(
        "payload_id", "entries", "ok", "error")


@query("feed_repairs", with_views(X.ARTICLES, X.ROUGH, select="SELECT * FROM rough"))
def _(spark, sf):
    scanned = feeds.feed_scan(X.rough_payloads(spark, sf), keep_empty=True)
    good = scanned.filter("entry_error is null").select(
        "payload_id", text.clean_title(F.col("title")).alias("title"), "link", "description",
        F.lit(None).cast("string").alias("error"))
    lost = feeds.entry_failures(scanned).select(
        F.col("seq.payload_id").alias("payload_id"), F.lit(None).alias("title"), F.lit(None).alias("link"),
        F.lit(None).alias("description"), F.col("error_type").alias("error"))
    return good.unionByName(lost)


@query("feed_shapes", with_views(X.ARTICLES, X.ODD, select="SELECT * FROM odd"))
def _(spark, sf):
    scanned = feeds.feed_scan(X.odd_payloads(spark, sf), keep_empty=True)
    collapsed = F.trim(F.regexp_replace("title", f"[{text.SPACE}]+", " "))
    return scanned.filter("entry_error is null").select("payload_id", collapsed.alias("title"), "link", "published", "description")


@query("active_sources", with_views(X.SOURCES, select="""
SELECT id, name, slug FROM sources
WHERE is_active AND circuit_breaker_state <> 'OPEN' AND source_type = 'RSS'"""))
def _(spark, sf):
    return feeds.active_sources(X.sources(spark, sf)).select("id", "name", "slug")


@query("list_projection", with_views(X.ARTICLES, select=f"SELECT {', '.join(A.LIST_COLUMNS)} FROM articles"))
def _(spark, sf):
    return A.list_projection(X.articles(spark, sf))


@query("detail_lookup", with_views(
    X.ARTICLES, select=f"SELECT {', '.join(A.DETAIL_COLUMNS)} FROM articles WHERE id = 42"))
def _(spark, sf):
    return A.detail_lookup(X.articles(spark, sf), 42)


@query("landing_stream", FEED_ORACLE)
def _(spark, sf):
    landed = scratch_dir(spark, "landed")
    X.payloads(spark, sf).write.options(**LANDED).parquet(landed)
    out = scratch_dir(spark, "entries")
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 4).parquet(landed)
    jobs.landing_stream(stream, out, scratch_dir(spark, "offsets"))
    return spark.read.parquet(out).select(
        "source_id", "payload_id", "item_pos", "title", "link", "published", "description",
        F.array_join("terms", ",").alias("terms"))


# --- Cleaning and the quality gate -------------------------------------------------------------

URL_ORACLE = r"""
WITH parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme,
         lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
kept AS (
  SELECT *, array_to_string(list_filter(string_split(query, '&'),
      lambda p: p <> '' AND split_part(lower(p), '=', 1) NOT IN ('utm_source','utm_medium','utm_campaign',
        'utm_term','utm_content','gclid','fbclid','_ga','mc_cid','mc_eid')), '&') AS q
  FROM parts)
SELECT page_id, scheme || '://' || host ||
       CASE WHEN path = '/' THEN path ELSE rtrim(path, '/') END ||
       CASE WHEN q = '' THEN '' ELSE '?' || q END AS clean_url
FROM kept"""


@query("normalize_url", URL_ORACLE)
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("clean_url"))


@query("strip_fragment", "SELECT page_id, split_part(url, '#', 1) AS bare_url FROM pages")
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", urls.strip_fragment(F.col("url")).alias("bare_url"))


@query("clean_title", f"""
SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(
         regexp_extract(html, '<title>(.*?)</title>', 1),
         '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&'),
         '[{text.SPACE}]+', ' ', 'g')), 1, 512) AS title FROM pages""")
def _(spark, sf):
    raw = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return X.table(spark, sf, "pages").select("page_id", text.clean_title(raw).alias("title"))


@query("html_to_text", rf"""
WITH hidden AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
    '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'gis') AS h FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(
         regexp_replace(h, '<[/!]?[A-Za-z][^>]*>', ' ', 'gs'),
         '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&'),
         '[{text.SPACE}]+', ' ', 'g')) AS body FROM hidden""")
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("parse_published", with_views(X.ARTICLES, X.RAW, select="SELECT seq, published_at FROM raw"))
def _(spark, sf):
    return X.raw_articles(spark, sf).select(
        "seq", dates.parse_published(F.col("published_at_raw"), F.col("timezone_hint")).alias("published_at"))


@query("parse_numeric_dates", with_views(X.ARTICLES, select="""
SELECT id, CASE WHEN id % 5 IN (3, 4) THEN date_trunc('day', published_at) ELSE published_at END AS published_at FROM articles"""))
def _(spark, sf):
    at, n = F.col("published_at"), F.col("id") % 5
    shown = F.when(n == 0, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")).when(
        n == 1, F.date_format(at, "EEE MMM dd HH:mm:ss yyyy")).when(n == 2, F.date_format(at, "yyyy/MM/dd HH:mm")).when(
        (n == 3) & (F.day(at) > 12), F.date_format(at, "dd/MM/yyyy")).otherwise(
        F.when(n == 4, F.date_format(at, "yyyyMMdd")).otherwise(F.date_format(at, "MM/dd/yyyy")))
    return X.articles(spark, sf).select("id", dates.parse_published(shown, F.lit("UTC")).alias("published_at"))


@query("freshness_filter", with_views(X.ARTICLES, select=f"""
SELECT id, published_at FROM articles
WHERE published_at IS NULL OR {TS} - published_at <= INTERVAL 72 HOUR"""))
def _(spark, sf):
    return quality.freshness_filter(X.articles(spark, sf), now()).select("id", "published_at")


@query("clean_author", with_views(X.ARTICLES, X.RAW, select="SELECT seq, author FROM raw"))
def _(spark, sf):
    return X.raw_articles(spark, sf).select("seq", text.clean_author(F.col("author")).alias("author"))


@query("content_hash", with_views(X.ARTICLES, select="SELECT id, content_hash FROM articles"))
def _(spark, sf):
    return X.articles(spark, sf).select("id", "content_hash")


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    raw = X.raw_articles(spark, sf).withColumn("url", urls.normalize_url(F.col("link")))
    return written(quality.stage_articles(raw, gate_now()), "staged")


@query("quality_gate", with_views(X.ARTICLES, X.STAGED, select="""
SELECT seq, violations, quality_score, is_valid FROM staged"""))
def _(spark, sf):
    return _staged(spark, sf).select(
        "seq", F.array_join("violations", ", ").alias("violations"), "quality_score", "is_valid")


@query("normalize", with_views(X.ARTICLES, X.STAGED, select="""
SELECT seq, url, title, clean_summary AS summary, author, published_at, content_hash, dropped FROM staged"""))
def _(spark, sf):
    return _staged(spark, sf).select(
        "seq", "url", "title", "summary", "author", "published_at", "content_hash", "dropped")


FAILED_SQL = """,
letters AS (
  SELECT seq, source_id, stage AS failure_stage, 'Drop' AS error_type,
         'Normalizer rejected article' AS error_message
  FROM staged WHERE stage = 'NORMALIZATION'
  UNION ALL
  SELECT seq, source_id, stage, 'QualityGateRejected',
         'Violations: ' || violations || ' (Score: ' || quality_score || ')'
  FROM staged WHERE stage = 'VALIDATION')"""


@query("route_failures", with_views(X.ARTICLES, X.STAGED + FAILED_SQL, select="SELECT * FROM letters"))
def _(spark, sf):
    return quality.route_failures(_staged(spark, sf)).drop("raw_payload")


KEYWORD = "an"
LIST_SQL = f"""
  source_name IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9')
  AND published_at >= TIMESTAMP '2024-01-03' AND published_at <= TIMESTAMP '2024-01-29 12:00:00'
  AND contains(lower(title), '{KEYWORD}') AND lower(sentiment_label) = 'positive'"""


def _filters(**more) -> A.ArticleFilters:
    return A.ArticleFilters(
        source_names=[f"src{i}" for i in range(10)], published_after=datetime(2024, 1, 3),
        published_before=datetime(2024, 1, 29, 12), keywords=KEYWORD, sentiment="POSITIVE", **more)


@query("list_filters", with_views(X.ARTICLES, select=f"SELECT id, title, source_name FROM articles WHERE {LIST_SQL}"))
def _(spark, sf):
    return A.list_filters(X.articles(spark, sf), _filters()).select("id", "title", "source_name")


TOKENS = rf"""
toks AS (
  SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, summary, body)), '[^{text.WORD}]+'),
                         lambda w: w <> '') AS l FROM articles)"""
SEARCH = '"der die" -que or thand ing'
SEARCH_SQL = r"""((contains(' ' || array_to_string(l, ' ') || ' ', ' der die ') AND NOT list_contains(l, 'que'))
  OR (list_contains(l, 'thand') AND list_contains(l, 'ing')))"""


@query("text_match", with_views(X.ARTICLES, TOKENS, select=f"SELECT id FROM toks WHERE {SEARCH_SQL}"))
def _(spark, sf):
    rows = X.articles(spark, sf)
    return rows.filter(search.text_match(
        SEARCH, F.concat_ws(" ", "title", "summary", "body"))).select("id")


@query("is_complete", with_views(X.ARTICLES, select="""
SELECT id, title <> '' AND url <> '' AND published_at IS NOT NULL AS complete FROM articles"""))
def _(spark, sf):
    return X.articles(spark, sf).select("id", quality.is_complete().alias("complete"))


@query("articles_today", with_views(X.ARTICLES, select="""
SELECT id, published_at FROM articles WHERE published_at >= date_trunc('day', TIMESTAMP '2024-01-16 13:30:00')"""))
def _(spark, sf):
    return audit.articles_today(X.articles(spark, sf), X.instant("2024-01-16 13:30:00")).select("id", "published_at")


@query("unhealthy_sources", with_views(X.SOURCES, select="""
SELECT id, slug, circuit_breaker_state, consecutive_failures, health_score FROM sources
WHERE circuit_breaker_state <> 'CLOSED' OR health_score < 100"""))
def _(spark, sf):
    return health.unhealthy_sources(X.sources(spark, sf)).select(
        "id", "slug", "circuit_breaker_state", "consecutive_failures", "health_score")


# --- Enrichment --------------------------------------------------------------------------------

WORDS = rf"""
words AS (
  SELECT id, regexp_split_to_array(lower(title || ' ' || body), '[^{text.WORD}]+') AS l FROM articles),
tok AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM words)"""


def _in(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _entity_sql() -> str:
    parts = []
    for kind, terms in X.ENTITY_WORDS.items():
        name = "upper(w)" if kind == "Regulator" else "upper(substr(w, 1, 1)) || substr(w, 2)"
        parts.append(f"SELECT id AS article_id, {name} AS entity, '{kind}' AS entity_type FROM tok WHERE w IN {_in(terms)}")
    return "ents AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + "))"


ENTITY_SQL = _entity_sql()


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    found = E.entities(E.article_text(F.col("title"), F.col("body")), X.ENTITY_WORDS)
    rows = X.articles(spark, sf).select("id", found.alias("entities"))
    return maintenance.child_rows(rows, "entities")


@query("extract_entities", with_views(X.ARTICLES, WORDS, ENTITY_SQL, select="""
SELECT article_id, entity, entity_type, 1.0::DOUBLE AS confidence, 1::INTEGER AS extractor_version FROM ents"""))
def _(spark, sf):
    return _entities(spark, sf)


def _sector_sql() -> str:
    parts = [
        f"SELECT id, '{name}' AS sector, {place} AS place, least(count(*), 10)::DOUBLE AS score "
        f"FROM tok WHERE w IN {_in(terms)} GROUP BY id"
        for place, (name, terms) in enumerate(X.SECTOR_WORDS.items())]
    return (
        "secs AS (SELECT id AS article_id, sector, score FROM (SELECT *, row_number() OVER (PARTITION BY id "
        "ORDER BY score DESC, place) AS r FROM (" + " UNION ALL ".join(parts) + ")) WHERE r <= 3)")


SECTOR_SQL = _sector_sql()


def _sectors(spark: SparkSession, sf: str) -> DataFrame:
    found = E.sectors(E.article_text(F.col("title"), F.col("body")), X.SECTOR_WORDS)
    return maintenance.child_rows(X.articles(spark, sf).select("id", found.alias("sectors")), "sectors")


@query("classify_sectors", with_views(X.ARTICLES, WORDS, SECTOR_SQL, select="SELECT * FROM secs"))
def _(spark, sf):
    return _sectors(spark, sf)


MOOD_SQL = rf"""
mood_tok AS (
  SELECT id, unnest(regexp_split_to_array(lower(title || ' ' || title || ' ' || body), '[^{text.WORD}]+')) AS w
  FROM articles),
mood AS (
  SELECT a.id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, coalesce(t.total, 0.0::DOUBLE) / 3.0::DOUBLE)) AS s
  FROM articles a LEFT JOIN (
    SELECT id, sum(CASE w {' '.join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in X.MOOD_WORDS.items())} END) AS total
    FROM mood_tok WHERE w IN {_in(X.MOOD_WORDS)} GROUP BY id) t ON t.id = a.id)"""


@query("score_sentiment", with_views(X.ARTICLES, MOOD_SQL, select="""
SELECT id, CASE WHEN s >= 0.2 THEN 'positive' WHEN s <= -0.2 THEN 'negative' ELSE 'neutral' END AS label,
       round_even(s, 4)::DOUBLE AS score FROM mood"""))
def _(spark, sf):
    mood = E.sentiment(F.col("title"), F.col("body"), X.MOOD_WORDS)
    return X.articles(spark, sf).select("id", mood.alias("m")).select("id", "m.label", "m.score")


def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    found = E.keywords(E.article_text(F.col("title"), F.col("body")))
    return maintenance.child_rows(X.articles(spark, sf).select("id", found.alias("keywords")), "keywords")


KEYWORD_SQL = f"""
kw_counts AS (
  SELECT id, w, count(*) AS n, min(pos) AS first FROM tok
  WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {_in(sorted(set(E.KEYWORD_STOP_WORDS)))} GROUP BY id, w),
kws AS (
  SELECT id AS article_id, w AS keyword, n, max(n) OVER (PARTITION BY id) AS top,
         row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS place FROM kw_counts)"""


@query("extract_keywords", with_views(X.ARTICLES, WORDS, KEYWORD_SQL, select="""
SELECT article_id, keyword, round_even(n::DOUBLE / top, 4)::DOUBLE AS weight FROM kws WHERE place <= 5"""))
def _(spark, sf):
    return _keywords(spark, sf)


@query("summarize_extractive", with_views(X.ARTICLES, select=rf"""
, seg AS (
  SELECT id, unnest(l) AS part, generate_subscripts(l, 1) AS seg FROM (
    SELECT id, regexp_extract_all(body, '[^.!?]+[.!?]*') AS l FROM articles WHERE length(body) >= 200)),
cut AS (
  SELECT id, seg, part, regexp_replace(part, '^[{text.SPACE}]+|[{text.SPACE}]+$', '', 'g') AS sentence,
         list_filter(regexp_split_to_array(lower(part), '[^{text.WORD}]+'),
                     lambda w: regexp_full_match(w, '[a-z]{{3,}}')) AS l
  FROM seg),
word AS (SELECT id, seg, unnest(l) AS w FROM cut),
tf AS (SELECT id, w, count(*) AS tf FROM word WHERE w NOT IN {_in(summaries.SUMMARY_STOP_WORDS)} GROUP BY id, w),
weight AS (SELECT word.id, seg, sum(tf) AS weight FROM word JOIN tf ON tf.id = word.id AND tf.w = word.w GROUP BY word.id, seg),
sent AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seg) AS place, count(*) OVER (PARTITION BY id) AS n
  FROM cut WHERE regexp_matches(part, '[.!?]$') AND length(sentence) > 20),
scored AS (
  SELECT sent.id, sentence, place, coalesce(weight, 0)::DOUBLE
         * CASE WHEN len(l) > 30 OR len(l) < 5 THEN 0.5::DOUBLE ELSE 1 END
         * CASE WHEN place = 1 THEN 1.5::DOUBLE ELSE 1 END AS score
  FROM sent LEFT JOIN weight ON weight.id = sent.id AND weight.seg = sent.seg WHERE n > 3),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS r FROM scored),
full_text AS (SELECT id, string_agg(sentence, ' ' ORDER BY place) AS s FROM best WHERE r <= 3 GROUP BY id)
SELECT id, CASE WHEN length(s) > 1000 THEN substr(s, 1, 997) || '...' ELSE s END AS generated_summary
FROM full_text""".lstrip()))
def _(spark, sf):
    return summaries.summarize_extractive(X.articles(spark, sf))


def _custom_enrichers():
    return enrich.standard_enrichers(
        content="body", entities=X.ENTITY_WORDS, sectors=X.SECTOR_WORDS, lexicon=X.MOOD_WORDS)


ENRICH_SQL = """
SELECT a.id, coalesce(e.n, 0) AS n_entities, coalesce(s.n, 0) AS n_sectors, coalesce(k.n, 0) AS n_keywords,
       CASE WHEN m.s >= 0.2 THEN 'positive' WHEN m.s <= -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       round_even(m.s, 4)::DOUBLE AS sentiment_score{more}
FROM articles a JOIN mood m ON m.id = a.id
LEFT JOIN (SELECT article_id, count(*) AS n FROM ents GROUP BY 1) e ON e.article_id = a.id
LEFT JOIN (SELECT article_id, count(*) AS n FROM secs GROUP BY 1) s ON s.article_id = a.id
LEFT JOIN (SELECT article_id, count(*) AS n FROM kws WHERE place <= 5 GROUP BY 1) k ON k.article_id = a.id"""


def _enriched(rows: DataFrame, *more) -> DataFrame:
    return rows.select(
        "id", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("entities", "sectors", "keywords")],
        "sentiment_label", "sentiment_score", *more)


@query("enrich", with_views(X.ARTICLES, WORDS, ENTITY_SQL, SECTOR_SQL, MOOD_SQL, KEYWORD_SQL,
                            select=ENRICH_SQL.format(more="")))
def _(spark, sf):
    return _enriched(enrich.enrich(X.articles(spark, sf).drop("sentiment"), _custom_enrichers()))


@query("register_enricher", with_views(
    X.ARTICLES, WORDS, ENTITY_SQL, SECTOR_SQL, MOOD_SQL, KEYWORD_SQL,
    select=ENRICH_SQL.format(more=", CASE WHEN a.summary IS NULL THEN NULL ELSE length(a.summary) END::BIGINT AS reading, "
                                  "CASE WHEN a.summary IS NULL THEN 1 ELSE 0 END::BIGINT AS n_errors")))
def _(spark, sf):
    reading = enrich.isolated(lambda s: s.map(len).astype("int64"), "bigint", F.col("summary"))
    steps = enrich.register_enricher(_custom_enrichers(), "reading", reading)
    rows = enrich.enrich(X.articles(spark, sf).drop("sentiment"), steps)
    return _enriched(rows, "reading", F.size("errors").cast("bigint").alias("n_errors"))


# --- Joins and duplicates ----------------------------------------------------------------------


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the incoming articles, written as the cycle writes its staged rows."""
    return written(X.incoming_articles(spark, sf).select("seq", "url", "content_hash"), "batch")


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return written(X.stored_articles(spark, sf).select("url", "content_hash"), "known")


@query("existing_candidates", "WITH " + X.BATCH + """
SELECT DISTINCT url, content_hash FROM stored
WHERE url IN (SELECT url FROM incoming) OR content_hash IN (SELECT content_hash FROM incoming)""")
def _(spark, sf):
    return dedup.existing_candidates(_known(spark, sf), _batch(spark, sf))


@query("dedup_against_store", "WITH " + X.BATCH + """
SELECT seq, url, store_method IS NOT NULL AS is_duplicate, store_method AS dup_method,
       CASE WHEN store_method = 'exact_url' THEN url END AS matched_url FROM checked""")
def _(spark, sf):
    return dedup.dedup_against_store(_batch(spark, sf), _known(spark, sf)).select(
        "seq", "url", "is_duplicate", "dup_method", "matched_url")


@query("dedup_in_batch", "WITH " + X.BATCH + """
SELECT i.seq, i.url, CASE WHEN i.url_place > 1 THEN 'batch_url' WHEN h.hash_place > 1 THEN 'batch_hash' END AS batch_method
FROM url_ranked i LEFT JOIN hash_ranked h ON h.seq = i.seq""")
def _(spark, sf):
    return dedup.dedup_in_batch(_batch(spark, sf)).select("seq", "url", "batch_method")


LABEL_SQL = """,
new_url AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS u FROM checked WHERE store_method IS NULL),
new_hash AS (SELECT seq, row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS h FROM new_url WHERE u = 1)"""


@query("label_batch", "WITH " + X.BATCH + LABEL_SQL + """
SELECT c.seq, coalesce(c.store_method, CASE WHEN n.u > 1 THEN 'batch_url' WHEN h.h > 1 THEN 'batch_hash' END) AS dup_method,
       CASE WHEN c.store_method = 'exact_url' THEN c.url END AS matched_url
FROM checked c LEFT JOIN new_url n ON n.seq = c.seq LEFT JOIN new_hash h ON h.seq = c.seq""")
def _(spark, sf):
    return dedup.label_batch(_batch(spark, sf), _known(spark, sf)).select(
        "seq", "dup_method", "matched_url")


def _key_index(spark: SparkSession, sf: str) -> KeyIndex:
    """The stored keys as an index that nine runs have written and one merge has joined; one run is written twice."""
    index = KeyIndex(spark, scratch_dir(spark, "keys"), 16)
    stored = X.stored_articles(spark, sf).select("url", "content_hash")
    runs = stored.withColumn("run_id", F.concat(F.lit("run-"), F.pmod(F.xxhash64("url"), F.lit(9)).cast("string")))
    runs = written(runs, "runs")
    index.build(runs.withColumn("url", F.when(F.col("run_id") == "run-3", F.concat("url", F.lit("/old"))).otherwise(F.col("url"))))
    index.merge()
    index.write_run("run-3", runs.filter("run_id = 'run-3'"))
    return index


@query("index_candidates", "WITH " + X.BATCH + """
SELECT DISTINCT url, content_hash FROM stored
WHERE url IN (SELECT url FROM incoming) OR content_hash IN (SELECT content_hash FROM incoming)""")
def _(spark, sf):
    return dedup.existing_candidates(_key_index(spark, sf), _batch(spark, sf))


@query("dedup_against_index", "WITH " + X.BATCH + LABEL_SQL + """
SELECT c.seq, coalesce(c.store_method, CASE WHEN n.u > 1 THEN 'batch_url' WHEN h.h > 1 THEN 'batch_hash' END) AS dup_method,
       CASE WHEN c.store_method = 'exact_url' THEN c.url END AS matched_url
FROM checked c LEFT JOIN new_url n ON n.seq = c.seq LEFT JOIN new_hash h ON h.seq = c.seq""")
def _(spark, sf):
    return dedup.label_batch(_batch(spark, sf), _key_index(spark, sf)).select("seq", "dup_method", "matched_url")


@query("insert_through_index", "WITH " + X.BATCH + """
SELECT seq, url FROM url_ranked WHERE url_place = 1 AND url NOT IN (SELECT url FROM stored)""")
def _(spark, sf):
    return dedup.insert_if_absent(_batch(spark, sf), _key_index(spark, sf)).select("seq", "url")


@query("first_wins", "WITH " + X.BATCH + """
SELECT url, min(seq) AS seq FROM incoming GROUP BY url""")
def _(spark, sf):
    return dedup.first_wins(X.incoming_articles(spark, sf), ["url"]).select("url", "seq")


@query("insert_if_absent", "WITH " + X.BATCH + """
SELECT seq, url FROM url_ranked WHERE url_place = 1 AND url NOT IN (SELECT url FROM stored)""")
def _(spark, sf):
    return dedup.insert_if_absent(X.incoming_articles(spark, sf), X.stored_articles(spark, sf)).select("seq", "url")


@query("child_rows", "WITH " + X.BATCH + ",\n" + WORDS + ",\n" + KEYWORD_SQL + """
SELECT article_id, substr(keyword, 1, 100) AS keyword, round_even(n::DOUBLE / top, 4)::DOUBLE AS weight
FROM kws WHERE place <= 5
  AND article_id IN (SELECT id FROM url_ranked WHERE url_place = 1 AND url NOT IN (SELECT url FROM stored))""")
def _(spark, sf):
    inserted = dedup.insert_if_absent(X.incoming_articles(spark, sf), X.stored_articles(spark, sf))
    found = E.keywords(E.article_text(F.col("title"), F.col("body")))
    rows = X.articles(spark, sf).select("id", found.alias("keywords"))
    return maintenance.child_rows(rows, "keywords", inserted)


@query("entity_article_join", with_views(X.ARTICLES, WORDS, ENTITY_SQL, select="""
SELECT article_id, entity, entity_type, published_at FROM ents JOIN articles ON id = article_id
WHERE published_at IS NOT NULL"""))
def _(spark, sf):
    return trends.entity_article_join(_entities(spark, sf), X.articles(spark, sf))


@query("filter_by_entity", with_views(X.ARTICLES, WORDS, ENTITY_SQL, select="""
SELECT id, title FROM articles WHERE id IN (SELECT article_id FROM ents WHERE entity = 'FOR')"""))
def _(spark, sf):
    return A.filter_by_entity(X.articles(spark, sf), _entities(spark, sf), "FOR").select("id", "title")


@query("filter_by_sector", with_views(X.ARTICLES, WORDS, SECTOR_SQL, select="""
SELECT id, title FROM articles WHERE id IN (SELECT article_id FROM secs WHERE sector = 'Delta')"""))
def _(spark, sf):
    return A.filter_by_sector(X.articles(spark, sf), _sectors(spark, sf), "Delta").select("id", "title")


@query("filter_by_keyword", with_views(X.ARTICLES, WORDS, KEYWORD_SQL, select="""
SELECT id, title FROM articles WHERE id IN (SELECT article_id FROM kws WHERE place <= 5 AND keyword = 'der')"""))
def _(spark, sf):
    return A.filter_by_keyword(X.articles(spark, sf), _keywords(spark, sf), "der").select("id", "title")


def _raw_store(spark: SparkSession, sf: str) -> DataFrame:
    return X.raw_articles(spark, sf).select(
        F.col("seq").alias("id"), F.col("source_id").alias("run_id"), "raw_payload", F.col("created_at").alias("fetched_at"),
        urls.normalize_url(F.col("link")).alias("source_url"))


@query("lineage_join", with_views(X.ARTICLES, select="""
SELECT id AS canonical_id, id AS raw_id, source_name AS run_id, quality_score, created_at AS raw_collected_at
FROM articles WHERE url LIKE '%example.com/a/%'"""))
def _(spark, sf):
    return audit.lineage_join(X.articles(spark, sf), _raw_store(spark, sf), "%example.com/a/%")


@query("raw_vs_canonical", with_views(X.ARTICLES, X.RAW, select="""
SELECT a.id AS canonical_id, r.seq AS raw_id, r.raw_title, a.title AS canonical_title,
       r.published_at_raw AS raw_published, a.published_at AS canonical_published, a.quality_score
FROM articles a JOIN raw r ON r.url = a.url ORDER BY a.created_at DESC, a.id DESC LIMIT 5"""))
def _(spark, sf):
    return audit.raw_vs_canonical(X.articles(spark, sf), _raw_store(spark, sf))


def _runs_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    return X.outcomes(spark, sf).groupBy(F.col("source_id").alias("id")).agg(
        F.count_if("ok").alias("articles_ingested"), F.count_if(F.col("event_id") % 3 == 0).alias("duplicates_detected"))


@query("replay_reconcile", with_views(X.OUTCOMES, X.FAILURES, select="""
SELECT source_id AS run_id, count(*) AS raw_collected, count(*) FILTER (ok) AS canonical_saved,
       count(*) FILTER (event_id % 3 = 0) AS duplicates_skipped,
       (SELECT count(*) FROM failures f WHERE f.run_id = o.source_id AND f.failure_stage = 'error') AS failed_items
FROM outcomes o GROUP BY source_id"""))
def _(spark, sf):
    raw = X.outcomes(spark, sf).select(F.col("source_id").alias("run_id"))
    failed = X.failures(spark, sf).filter("failure_stage = 'error'")
    return audit.replay_reconcile(_runs_of_sources(spark, sf), raw, failed)


@query("orphan_check", with_views(X.ARTICLES, WORDS, ENTITY_SQL, select="""
SELECT article_id, entity, entity_type FROM ents WHERE article_id NOT IN (SELECT doc_id FROM labels)"""))
def _(spark, sf):
    parents = X.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return audit.orphan_check(_entities(spark, sf), parents).select("article_id", "entity", "entity_type")


# --- Table maintenance -------------------------------------------------------------------------


@query("upsert_by_key", with_views(X.SOURCES, select="""
, incoming AS (
  SELECT 1000000 + c_custkey AS id, c_name AS name, 'supplier-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS slug,
         'https://new.example.com/' || c_custkey AS url, true AS is_active FROM customer)
SELECT coalesce(s.id, i.id) AS id, coalesce(i.name, s.name) AS name, coalesce(s.slug, i.slug) AS slug,
       coalesce(i.url, s.url) AS url, coalesce(i.is_active, s.is_active) AS is_active, s.health_score
FROM sources s FULL JOIN incoming i ON i.slug = s.slug""".lstrip()))
def _(spark, sf):
    key = F.col("c_custkey")
    incoming = X.table(spark, sf, "customer").select(
        (key + 1_000_000).cast("bigint").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("supplier-"), F.lpad(key.cast("string"), 9, "0")).alias("slug"),
        F.concat(F.lit("https://new.example.com/"), key.cast("string")).alias("url"),
        F.lit(True).alias("is_active"))
    stored = X.sources(spark, sf).select("id", "name", "slug", "url", "is_active", "health_score")
    return maintenance.upsert_by_key(stored, incoming, "slug", ["name", "url", "is_active"])


@query("seed_if_absent", with_views(X.SOURCES, select="""
SELECT id, url FROM sources
UNION ALL SELECT 1000000 + c_custkey, 'https://feeds.example.com/' || c_custkey FROM customer
WHERE 'https://feeds.example.com/' || c_custkey NOT IN (SELECT url FROM sources)"""))
def _(spark, sf):
    key = F.col("c_custkey")
    incoming = X.table(spark, sf, "customer").select(
        key.alias("seq"), (key + 1_000_000).cast("bigint").alias("id"),
        F.concat(F.lit("https://feeds.example.com/"), key.cast("string")).alias("url"))
    return maintenance.seed_if_absent(X.sources(spark, sf).select("id", "url"), incoming)


@query("conditional_update", with_views(X.SOURCES, select="""
SELECT id, slug, CASE WHEN slug IN ('supplier-000000003', 'supplier-000000008') THEN false ELSE is_active END AS is_active
FROM sources"""))
def _(spark, sf):
    rows = X.sources(spark, sf).select("id", "slug", "is_active")
    off = F.col("slug").isin("supplier-000000003", "supplier-000000008")
    return maintenance.conditional_update(rows, off, is_active=F.lit(False))


@query("backfill_from_join", with_views(X.ARTICLES, X.SOURCES, select="""
SELECT a.id, coalesce(CASE WHEN a.summary IS NULL THEN NULL WHEN a.published_at IS NULL THEN NULL ELSE a.source_name END,
                      s.name, CASE WHEN a.published_at IS NULL AND a.summary IS NOT NULL THEN '' END) AS source_name
FROM articles a LEFT JOIN sources s ON s.id = a.feed_source_id"""))
def _(spark, sf):
    holes = F.when(F.col("summary").isNull(), F.lit(None)).when(
        F.col("published_at").isNull(), "").otherwise(F.col("source_name"))
    rows = X.articles(spark, sf).select("id", "feed_source_id", holes.alias("source_name"))
    return maintenance.backfill_from_join(rows, X.sources(spark, sf)).select("id", "source_name")


@query("cascade_delete", with_views(X.ARTICLES, X.SOURCES, WORDS, ENTITY_SQL, select="""
, kept AS (SELECT id FROM articles WHERE feed_source_id NOT IN (SELECT id FROM sources WHERE NOT is_active))
SELECT 'sources' AS kind, CAST(id AS VARCHAR) AS row_key FROM sources WHERE is_active
UNION ALL SELECT 'articles', CAST(id AS VARCHAR) FROM kept
UNION ALL SELECT 'entities', article_id || ':' || entity FROM ents WHERE article_id IN (SELECT id FROM kept)""".lstrip()))
def _(spark, sf):
    known = X.sources(spark, sf)
    left = maintenance.cascade_delete(
        known, known.filter(~F.col("is_active")), X.articles(spark, sf), {"entities": _entities(spark, sf)})
    row = lambda kind, key: left[kind].select(F.lit(kind).alias("kind"), key.alias("row_key"))
    key = F.col("id").cast("string")
    children = F.concat(F.col("article_id").cast("string"), F.lit(":"), "entity")
    return row("sources", key).unionAll(row("articles", key)).unionAll(row("entities", children))


def _store(spark: SparkSession) -> tables.NewsStore:
    return tables.NewsStore(spark, scratch_dir(spark, "store"))


# --- The same changes on stored tables: only the folders that hold a change are written again ----------

SOURCE_SCHEMA = (
    "id bigint, name string, slug string, url string, is_active boolean, health_score double, published_date date, run_id string")


def _stored_sources(spark: SparkSession, sf: str) -> SegmentedTable:
    """The sources in four folders, by the runs that have written them."""
    held = SegmentedTable(spark, scratch_dir(spark, "sources"), SOURCE_SCHEMA)
    rows = X.sources(spark, sf).withColumn("published_date", F.lit(None))
    for part in range(4):
        held.write_run(f"run-{part}", rows.filter(F.col("id") % 4 == part))
    return held


def _stored_articles(spark: SparkSession, sf: str, **changes: Column) -> tables.NewsStore:
    """The articles of two runs, the second written twice."""
    store = _store(spark)
    rows = X.articles(spark, sf).withColumns({
        "feed_source_id": F.col("feed_source_id").cast("string"), "collected_at": now(), "tags": F.array("category"),
        "sentiment_score": F.lit(0.0), "generated_summary": F.lit(None), "published_date": F.to_date("published_at"), **changes})
    rows = written(rows.withColumn("id", F.format_string("%012d", "id")), "rows")
    store.write_run("articles", rows.filter("cast(id as bigint) % 2 = 0"), "run-0")
    for _ in range(2):
        store.write_run("articles", rows.filter("cast(id as bigint) % 2 = 1"), "run-1")
    return store


@query("stored_upsert", ORACLES["upsert_by_key"])
def _(spark, sf):
    key = F.col("c_custkey")
    incoming = X.table(spark, sf, "customer").select(
        (key + 1_000_000).cast("bigint").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("supplier-"), F.lpad(key.cast("string"), 9, "0")).alias("slug"),
        F.concat(F.lit("https://new.example.com/"), key.cast("string")).alias("url"), F.lit(True).alias("is_active"),
        F.lit(None).cast("date").alias("published_date"), F.lit("run-9").alias("run_id"))
    held = _stored_sources(spark, sf)
    held.upsert(incoming, "slug", ["name", "url", "is_active"])
    return held.read().select("id", "name", "slug", "url", "is_active", "health_score")


@query("stored_update", ORACLES["conditional_update"])
def _(spark, sf):
    held = _stored_sources(spark, sf)
    held.update(F.col("slug").isin("supplier-000000003", "supplier-000000008"), is_active=F.lit(False))
    return held.read().select("id", "slug", "is_active")


@query("stored_backfill", with_views(X.ARTICLES, X.SOURCES, select="""
SELECT a.id, CASE WHEN a.summary IS NULL OR a.published_at IS NULL THEN coalesce(s.name, CASE WHEN a.summary IS NOT NULL THEN '' END)
                  ELSE a.source_name END AS source_name
FROM articles a LEFT JOIN sources s ON s.id = a.feed_source_id"""))
def _(spark, sf):
    holes = F.when(F.col("summary").isNull(), F.lit(None)).when(F.col("published_at").isNull(), "").otherwise(F.col("source_name"))
    held = _stored_articles(spark, sf, source_name=holes).table("articles")
    held.backfill(X.sources(spark, sf).withColumn("id", F.col("id").cast("string")))
    return held.read().select(F.col("id").cast("bigint").alias("id"), "source_name")


@query("stored_cascade", with_views(X.ARTICLES, X.SOURCES, WORDS, ENTITY_SQL, select="""
, kept AS (SELECT id FROM articles WHERE feed_source_id NOT IN (SELECT id FROM sources WHERE NOT is_active))
SELECT 'articles' AS kind, CAST(id AS VARCHAR) AS row_key FROM kept
UNION ALL SELECT 'entities', article_id || ':' || entity FROM ents WHERE article_id IN (SELECT id FROM kept)""".lstrip()))
def _(spark, sf):
    store = _stored_articles(spark, sf)
    found = E.entities(E.article_text(F.col("title"), F.col("body")), X.ENTITY_WORDS)
    dated = store.read("articles").select("id", "published_date", found.alias("entities"))
    store.write_run("entities", maintenance.child_rows(dated, "entities", carry=["published_date"]), "run-1")
    off = X.sources(spark, sf).filter(~F.col("is_active")).select(F.col("id").cast("string").alias("id"))
    cascade_delete(store.table("articles"), [store.table("entities")], off)
    number = lambda c: F.col(c).cast("bigint").cast("string")
    return store.read("articles").select(F.lit("articles").alias("kind"), number("id").alias("row_key")).unionAll(
        store.read("entities").select(F.lit("entities"), F.concat(number("article_id"), F.lit(":"), "entity")))


@query("stored_page", with_views(X.ARTICLES, select="""
SELECT id, title, published_at FROM articles
WHERE published_at < TIMESTAMP '2024-01-16' OR (published_at = TIMESTAMP '2024-01-16' AND id < 500) OR published_at IS NULL
ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 51"""))
def _(spark, sf):
    held = _stored_articles(spark, sf).table("articles")
    held.merge(fan_in=2)  # the two runs of each date in one folder
    page = held.latest_page(50, (datetime(2024, 1, 16), f"{500:012d}"))
    return page.select(F.col("id").cast("bigint").alias("id"), "title", "published_at")


@query("stored_lookup", with_views(X.ARTICLES, select="SELECT id, title, url, content_hash FROM articles WHERE id = 42"))
def _(spark, sf):
    held = _stored_articles(spark, sf).table("articles")
    return held.lookup(f"{42:012d}").select(F.col("id").cast("bigint").alias("id"), "title", "url", "content_hash")


@query("merged_runs", with_views(X.ARTICLES, select="""
SELECT id, title, 'run-' || CASE WHEN id % 2 = 0 THEN 0 WHEN id % 3 = 0 THEN 1 ELSE 2 END AS run_id FROM articles WHERE id % 6 <> 5"""))
def _(spark, sf):
    store = _stored_articles(spark, sf)
    rows = written(store.read("articles"), "rows")
    store.table("articles").merge(fan_in=2)
    # A run whose rows lie in merged folders is repeated over a part of its rows; another one follows.
    odd = rows.filter("cast(id as bigint) % 2 = 1")
    store.write_run("articles", odd.filter("cast(id as bigint) % 3 = 0"), "run-1")
    store.write_run("articles", odd.filter("cast(id as bigint) % 3 = 1"), "run-2")
    store.table("articles").merge(fan_in=3)
    store.table("articles").vacuum()
    return store.read("articles").select(F.col("id").cast("bigint").alias("id"), "title", "run_id")


@query("raw_append", with_views(X.ARTICLES, X.RAW, select="""
SELECT source_id, url AS source_url, published_at_raw, link FROM raw"""))
def _(spark, sf):
    store = _store(spark)
    raw = X.raw_articles(spark, sf).withColumn("url", urls.normalize_url(F.col("link")))
    tables.raw_append(store, raw, "run-1", now())
    tables.raw_append(store, raw, "run-1", now())  # written again: nothing doubles
    return store.read("raw_articles").select(
        "source_id", "source_url", "published_at_raw", F.get_json_object("raw_payload", "$.link").alias("link"))


@query("dead_letter", with_views(X.FAILURES, select="""
SELECT source_id, failure_stage, coalesce(nullif(substr(error_type, 1, 256), ''), 'UNKNOWN') AS error_type,
       error_message, raw_payload FROM failures"""))
def _(spark, sf):
    store = _store(spark)
    tables.dead_letter(store, X.failures(spark, sf).drop("created_at", "run_id", "id"), "run-1", now())
    return store.read("failed_articles").select(
        "source_id", "failure_stage", "error_type", "error_message", "raw_payload")


@query("refresh_summaries", with_views(X.ARTICLES, WORDS, ENTITY_SQL, select="""
SELECT 'hourly' AS summary, entity || '/' || entity_type AS label, date_trunc('hour', published_at) AS bucket,
       count(*) AS article_count
FROM ents JOIN articles ON id = article_id WHERE published_at IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'daily', coalesce(sentiment_label, 'NEUTRAL'), date_trunc('day', published_at), count(*)
FROM articles WHERE published_at IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    store = _store(spark)
    rows = X.articles(spark, sf).withColumns({
        "feed_source_id": F.col("feed_source_id").cast("string"), "collected_at": now(),
        "tags": F.array("category"), "sentiment_score": F.lit(0.0), "generated_summary": F.lit(None),
        "published_date": F.to_date("published_at")})
    store.write_run("articles", rows, "run-1")
    found = E.entities(E.article_text(F.col("title"), F.col("body")), X.ENTITY_WORDS)
    dated = rows.select("id", "published_date", found.alias("entities"))
    store.write_run("entities", maintenance.child_rows(dated, "entities", carry=["published_date"]), "run-1")
    tables.refresh_summaries(store)
    hourly = store.read("hourly_trends").select(
        F.lit("hourly").alias("summary"), F.concat("entity", F.lit("/"), "entity_type").alias("label"),
        F.col("time_bucket").alias("bucket"), "article_count")
    daily = store.read("sentiment_summaries").select(
        F.lit("daily").alias("summary"), F.col("sentiment_label").alias("label"),
        F.col("date_bucket").alias("bucket"), "article_count")
    return hourly.unionAll(daily)


@query("export_csv", with_views(X.ARTICLES, select="""
SELECT CAST(id AS VARCHAR) AS id, title, source_name,
       coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00', '') AS published_at,
       author, coalesce(summary, '') AS summary, url FROM articles"""))
def _(spark, sf):
    path = scratch_dir(spark, "export")
    tables.export_csv(X.articles(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in A.EXPORT_COLUMNS)
    back = spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)
    return back.fillna("")


# --- Aggregates --------------------------------------------------------------------------------


@query("hourly_trends", with_views(X.MENTIONS, select="SELECT * FROM hourly"))
def _(spark, sf):
    return trends.hourly_trends(X.mentions(spark, sf))


DAILY_SQL = """
daily AS (
  SELECT date_trunc('day', published_at) AS date_bucket, coalesce(sentiment_label, 'NEUTRAL') AS sentiment_label,
         count(*) AS article_count
  FROM articles WHERE published_at IS NOT NULL GROUP BY ALL)"""


@query("sentiment_daily", with_views(X.ARTICLES, DAILY_SQL, select="SELECT * FROM daily"))
def _(spark, sf):
    return trends.sentiment_daily(X.articles(spark, sf))


@query("trending_entities", with_views(X.MENTIONS, select=f"""
SELECT entity, entity_type, CAST(sum(article_count) AS BIGINT) AS total_mentions,
       round(sum(article_count * exp(-0.1 * date_diff('second', time_bucket, {TS}) / 3600.0)), 6) AS trend_score
FROM hourly WHERE time_bucket >= {TS} - INTERVAL 168 HOUR
GROUP BY ALL ORDER BY trend_score DESC, entity, entity_type LIMIT 10"""))
def _(spark, sf):
    top = trends.trending_entities(trends.hourly_trends(X.mentions(spark, sf)), now(), hours=168)
    return top.withColumn("trend_score", F.round("trend_score", 6))


@query("sentiment_window", with_views(X.ARTICLES, DAILY_SQL, select=f"""
SELECT strftime(date_bucket, '%Y-%m-%d') AS date_bucket, sentiment_label, article_count
FROM daily WHERE date_bucket >= {TS} - INTERVAL 7 DAY"""))
def _(spark, sf):
    return trends.sentiment_window(trends.sentiment_daily(X.articles(spark, sf)), now())


@query("dashboard_stats", with_views(X.ARTICLES, X.SOURCES, X.RUNS, select="""
SELECT (SELECT count(*) FROM articles) AS total_articles,
       (SELECT count(*) FROM sources WHERE is_active) AS active_sources,
       (SELECT count(*) FROM articles WHERE published_at >= TIMESTAMP '2024-01-16') AS articles_today,
       (SELECT max(started_at) FROM runs WHERE status IN ('SUCCESS', 'PARTIAL_SUCCESS')) AS last_ingestion"""))
def _(spark, sf):
    return audit.dashboard_stats(
        X.articles(spark, sf), X.sources(spark, sf), X.runs(spark, sf), X.instant("2024-01-16 13:30:00"))


@query("enrichment_counts", with_views(X.ARTICLES, WORDS, ENTITY_SQL, SECTOR_SQL, KEYWORD_SQL, select="""
SELECT 'entities' AS table_name, count(*) AS rows FROM ents UNION ALL SELECT 'sectors', count(*) FROM secs
UNION ALL SELECT 'keywords', count(*) FROM kws WHERE place <= 5"""))
def _(spark, sf):
    return audit.enrichment_counts(_entities(spark, sf), _sectors(spark, sf), _keywords(spark, sf))


@query("summary_counts", with_views(X.ARTICLES, DAILY_SQL, X.MENTIONS, select="""
SELECT 'hourly_trends' AS table_name, count(*) AS rows FROM hourly
UNION ALL SELECT 'sentiment_summaries', count(*) FROM daily"""))
def _(spark, sf):
    return audit.summary_counts(
        trends.hourly_trends(X.mentions(spark, sf)), trends.sentiment_daily(X.articles(spark, sf)))


@query("table_counts", """
SELECT 'articles' AS table_name, count(*) AS rows FROM documents UNION ALL SELECT 'raw_articles', count(*) FROM documents
UNION ALL SELECT 'failed_articles', count(*) FROM events UNION ALL SELECT 'pipeline_runs', count(*) FROM events
UNION ALL SELECT 'feed_sources', count(*) FROM supplier""")
def _(spark, sf):
    return audit.table_counts({
        "articles": X.articles(spark, sf), "raw_articles": X.raw_articles(spark, sf),
        "failed_articles": X.failures(spark, sf), "pipeline_runs": X.runs(spark, sf),
        "feed_sources": X.sources(spark, sf)})


@query("count_filtered", with_views(X.ARTICLES, TOKENS, WORDS, ENTITY_SQL, select=f"""
SELECT count(*) AS matching FROM articles JOIN toks USING (id)
WHERE {LIST_SQL} AND list_contains(l, 'ing') AND id IN (SELECT article_id FROM ents WHERE entity = 'The')"""))
def _(spark, sf):
    return A.count_filtered(
        X.articles(spark, sf), _filters(search="ing", entity="The"), entities=_entities(spark, sf))


@query("dedup_ratio", with_views(X.RUNS, select="""
SELECT CAST(sum(articles_ingested) AS BIGINT) AS total_inserted, CAST(sum(duplicates_detected) AS BIGINT) AS total_duplicates,
       round(sum(duplicates_detected)::DOUBLE / nullif(sum(articles_ingested) + sum(duplicates_detected), 0) * 100, 2)
         AS duplicate_percentage FROM runs"""))
def _(spark, sf):
    return audit.dedup_ratio(X.runs(spark, sf))


@query("failure_breakdown", with_views(X.FAILURES, select="""
SELECT failure_stage, coalesce(substr(error_type, 1, 256), 'UNKNOWN') AS error_type, count(*) AS failure_count,
       max(created_at) AS latest_failure FROM failures GROUP BY ALL"""))
def _(spark, sf):
    letters = X.failures(spark, sf)
    return audit.failure_breakdown(tables.dead_letter_rows(letters, F.col("created_at")))


@query("run_summary", with_views(X.ARTICLES, X.STAGED + FAILED_SQL, select="""
, passed AS (SELECT * FROM staged WHERE stage = 'PASSED'),
known AS (SELECT url, content_hash FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)),
errors AS (SELECT count(*) AS n FROM events WHERE event_type = 'error' AND value > 95),
texts AS (
  SELECT 0 AS kind, event_id AS seq, 'transport: ' || user_id AS m FROM events WHERE event_type = 'error' AND value > 95
  UNION ALL SELECT 1, seq, failure_stage || ': ' || error_type FROM letters)
SELECT (SELECT count(*) FROM passed) AS articles_ingested,
       (SELECT count(*) FROM passed WHERE url IN (SELECT url FROM known)
          OR content_hash IN (SELECT content_hash FROM known)) AS duplicates_detected,
       (SELECT count(*) FROM letters) + (SELECT n FROM errors) AS failures,
       'PARTIAL_SUCCESS' AS status,
       (SELECT string_agg(m, '; ' ORDER BY kind, seq) FROM (SELECT * FROM texts ORDER BY kind, seq LIMIT 10)) AS error_summary
""".lstrip()))
def _(spark, sf):
    staged = _staged(spark, sf)
    marked = _marked(spark, sf, staged)
    bad = X.table(spark, sf, "events").filter("event_type = 'error' and value > 95")
    errors = bad.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("transport: "), F.col("user_id").cast("string")).alias("message"))
    return runs.run_summary(marked, quality.route_failures(staged), errors)


def _marked(spark: SparkSession, sf: str, staged: DataFrame) -> DataFrame:
    known = _known(spark, sf)
    labels = dedup.label_batch(quality.passed(staged).select("seq", "url", "content_hash"), known)
    return staged.select("seq", "source_id", "stage").join(labels.select("seq", "dup_method"), "seq", "left")


@query("run_metrics", with_views(X.ARTICLES, X.STAGED, select="""
, known AS (SELECT url, content_hash FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)),
marked AS (
  SELECT *, stage = 'PASSED' AND (url IN (SELECT url FROM known)
            OR content_hash IN (SELECT content_hash FROM known)) AS dup FROM staged),
fresh AS (
  SELECT source_id, seq, row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS r
  FROM marked WHERE stage = 'PASSED' AND NOT dup)
SELECT source_id, count(*) AS fetched, count(*) FILTER (stage = 'NORMALIZATION') AS failed_normalization,
       count(*) FILTER (stage = 'VALIDATION') AS failed_validation, count(*) FILTER (dup) AS deduplicated,
       (SELECT count(*) FROM fresh f WHERE f.source_id = marked.source_id AND f.r = 1) AS ingested
FROM marked GROUP BY source_id""".lstrip()))
def _(spark, sf):
    return runs.run_metrics(_marked(spark, sf, _staged(spark, sf)))


@query("duration_histogram", with_views(X.RUNS, select="""
SELECT le, (SELECT count(*) FROM runs WHERE duration_sec <= bound) AS runs
FROM (VALUES ('1.0', 1.0::DOUBLE), ('5.0', 5.0), ('15.0', 15.0), ('30.0', 30.0), ('60.0', 60.0), ('120.0', 120.0),
             ('300.0', 300.0), ('+Inf', 'infinity'::DOUBLE)) AS b(le, bound)"""))
def _(spark, sf):
    return runs.duration_histogram(X.runs(spark, sf), "duration_sec")


@query("duplicate_keys", "WITH " + X.BATCH + """
SELECT 'url' AS key_name, url AS key_value, count(*) AS frequency FROM incoming GROUP BY url HAVING count(*) > 1
UNION ALL SELECT 'content_hash', content_hash, count(*) FROM incoming GROUP BY content_hash HAVING count(*) > 1""")
def _(spark, sf):
    return audit.duplicate_keys(X.incoming_articles(spark, sf))


@query("source_distribution", "SELECT source AS source_name, count(*) AS article_count FROM documents GROUP BY source")
def _(spark, sf):
    return audit.source_distribution(X.articles(spark, sf))


@query("source_health", with_views(X.OUTCOMES, select="""
SELECT source_id, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count,
       max(ts) FILTER (ok) AS last_success_at, max(ts) FILTER (NOT ok) AS last_failure_at,
       arg_max_null(error, (ts, event_id)) AS last_error,
       count(*) FILTER (ok)::DOUBLE / count(*) * 100.0 AS health_score
FROM outcomes GROUP BY source_id"""))
def _(spark, sf):
    return health.source_health(X.outcomes(spark, sf))


@query("feed_audit", with_views(X.ARTICLES, X.SOURCES, select=f"""
SELECT s.id AS source_id, count(a.id) AS entries, max(a.published_at) AS latest,
       CASE WHEN count(a.id) = 0 THEN 'FAILED'
            WHEN {TS} - max(a.published_at) > INTERVAL 72 HOUR THEN 'STALE' ELSE 'VALID' END AS verdict
FROM sources s LEFT JOIN articles a ON a.feed_source_id = s.id GROUP BY s.id"""))
def _(spark, sf):
    entries = X.articles(spark, sf).select(F.col("feed_source_id").alias("source_id"), "published_at")
    return health.feed_audit(X.sources(spark, sf), entries, now())


BREAKER_ORACLE = with_views(X.OUTCOMES, select="""
, islands AS (
  SELECT *, count(*) FILTER (ok) OVER (PARTITION BY source_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
  FROM outcomes),
failed AS (
  SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY source_id, island ORDER BY ts, event_id
                                           ROWS UNBOUNDED PRECEDING) AS n FROM islands)
SELECT source_id, event_id, CASE WHEN ok THEN 0 ELSE n END AS consecutive_failures,
       CASE WHEN NOT ok AND n >= 5 THEN 'OPEN' ELSE 'CLOSED' END AS circuit_breaker_state FROM failed""".lstrip())


@query("circuit_breaker", BREAKER_ORACLE)
def _(spark, sf):
    return health.circuit_breaker(X.outcomes(spark, sf)).select(
        "source_id", "event_id", "consecutive_failures", "circuit_breaker_state")


@query("top_n_per_article", with_views(X.ARTICLES, WORDS, KEYWORD_SQL, SECTOR_SQL, select="""
SELECT 'keyword' AS kind, article_id, keyword AS name FROM kws WHERE place <= 5
UNION ALL SELECT 'sector', article_id, sector FROM secs"""))
def _(spark, sf):
    pick = lambda rows, kind, name: rows.select(F.lit(kind).alias("kind"), "article_id", F.col(name).alias("name"))
    return pick(_keywords(spark, sf), "keyword", "keyword").unionAll(pick(_sectors(spark, sf), "sector", "sector"))


# --- Pages and orders --------------------------------------------------------------------------

PAGE = "ORDER BY published_at DESC NULLS LAST, id DESC"


@query("latest_page", with_views(X.ARTICLES, select=f"""
SELECT id, title, published_at FROM articles
WHERE published_at < TIMESTAMP '2024-01-16' OR (published_at = TIMESTAMP '2024-01-16' AND id < 500) OR published_at IS NULL
{PAGE} LIMIT 51"""))
def _(spark, sf):
    return A.latest_page(X.articles(spark, sf).select("id", "title", "published_at"), 50, (datetime(2024, 1, 16), 500))


@query("export_scan", with_views(X.ARTICLES, select=f"SELECT id, title, published_at FROM articles {PAGE}"))
def _(spark, sf):
    return A.export_scan(X.articles(spark, sf).select("id", "title", "published_at"))


@query("runs_page", with_views(X.RUNS, select="""
SELECT id, started_at, status FROM runs WHERE started_at < TIMESTAMP '2024-01-20'
ORDER BY started_at DESC, id DESC LIMIT 21"""))
def _(spark, sf):
    return runs.runs_page(X.runs(spark, sf).select("id", "started_at", "status"), 20, (datetime(2024, 1, 20), 0))


@query("latest_run", with_views(X.RUNS, select="""
SELECT id, started_at, status, lower(status) = 'running' AS is_running FROM runs ORDER BY started_at DESC, id DESC LIMIT 1"""))
def _(spark, sf):
    return runs.latest_run(X.runs(spark, sf)).select("id", "started_at", "status", "is_running")


@query("recent_runs", with_views(X.RUNS, select="""
SELECT id, started_at, status, date_diff('microsecond', started_at, completed_at) / 1e6 AS duration_sec
FROM runs ORDER BY started_at DESC, id DESC LIMIT 10"""))
def _(spark, sf):
    return runs.recent_runs(X.runs(spark, sf).drop("duration_sec")).select("id", "started_at", "status", "duration_sec")


@query("sources_by_name", with_views(X.SOURCES, select="SELECT id, name, slug FROM sources ORDER BY name, id"))
def _(spark, sf):
    return health.sources_by_name(X.sources(spark, sf)).select("id", "name", "slug")


@query("sources_by_health", with_views(X.SOURCES, select="""
SELECT id, name, health_score FROM sources ORDER BY health_score, id"""))
def _(spark, sf):
    return health.sources_by_health(X.sources(spark, sf)).select("id", "name", "health_score")


@query("recent_failures", with_views(X.FAILURES, select="""
SELECT id, failure_stage, created_at FROM failures ORDER BY created_at DESC, id DESC LIMIT 20"""))
def _(spark, sf):
    return audit.recent_failures(X.failures(spark, sf)).select("id", "failure_stage", "created_at")


# --- Search ------------------------------------------------------------------------------------

STOPS = sorted(set(search.SEARCH_STOP_WORDS))
POSTING_SQL = TOKENS + f""",
spread AS (SELECT id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM toks),
placed AS (SELECT *, count(*) OVER (PARTITION BY id) AS doc_len FROM spread WHERE term NOT IN {_in(STOPS)}),
postings AS (
  SELECT term, id, count(*) AS tf, max(doc_len) AS doc_len, min(pos) AS first_pos, max(pos) AS last_pos
  FROM placed GROUP BY term, id)"""


@query("build_postings", with_views(X.ARTICLES, POSTING_SQL, select="""
SELECT term, id, tf, CAST(doc_len AS INTEGER) AS doc_len, CAST(first_pos AS INTEGER) AS first_pos,
       CAST(last_pos AS INTEGER) AS last_pos FROM postings"""))
def _(spark, sf):
    return search.build_postings(X.articles(spark, sf)).select(
        "term", "id", "tf", "doc_len", F.array_min("positions").alias("first_pos"),
        F.array_max("positions").alias("last_pos"))


RANKED_SQL = POSTING_SQL + f""",
corpus AS (SELECT (SELECT count(*) FROM articles) AS n_docs,
                  (SELECT count(*) FROM placed) / (SELECT count(*) FROM articles)::DOUBLE AS mean_len),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
gains AS (
  SELECT id, ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
             / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / mean_len)) AS gain
  FROM postings JOIN df USING (term), corpus WHERE term IN ('der', 'die', 'thand', 'ing')),
ranked AS (
  SELECT id, round(sum(gain), 6) AS rank FROM gains JOIN toks USING (id) WHERE {SEARCH_SQL} GROUP BY id)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.articles(spark, sf)
    index = scratch_dir(spark, "postings")
    words = SEARCH
    search.write_postings(search.build_postings(rows), index)
    postings = search.read_postings(spark, index, words)
    hits = search.search_ranked(rows, postings, written(search.corpus_stats(rows), "corpus"), words)
    return hits.withColumn("rank", F.round("rank", 6))


@query("search_ranked", with_views(X.ARTICLES, RANKED_SQL, select="SELECT id, title, rank FROM ranked JOIN articles USING (id)"))
def _(spark, sf):
    return _ranked(spark, sf).select("id", "title", "rank")


@query("search_page", with_views(X.ARTICLES, RANKED_SQL, select="""
SELECT id, rank, published_at FROM ranked JOIN articles USING (id)
WHERE rank < 30 ORDER BY rank DESC, published_at DESC NULLS LAST, id DESC LIMIT 21"""))
def _(spark, sf):
    return A.search_page(_ranked(spark, sf).select("id", "rank", "published_at"), 20, (30.0, None, -1))


@query("search_two_runs", with_views(X.ARTICLES, RANKED_SQL, select="SELECT CAST(id AS VARCHAR) AS id, rank FROM ranked"))
def _(spark, sf):
    store, rows = _store(spark), X.articles(spark, sf).withColumn("id", F.col("id").cast("string"))
    for part in (0, 1):
        store.write_index(rows.filter(F.crc32(F.col("id").cast("binary")) % 2 == part), f"run-{part}")
    postings = search.needed_postings(store.read("postings"), SEARCH)
    stats = written(search.index_stats(store.read("doc_lengths")), "corpus")
    return search.search_ranked(rows, postings, stats, SEARCH).select("id", F.round("rank", 6).alias("rank"))


STEM_SQL = TOKENS.replace("toks AS", "plain AS") + """,
toks AS (SELECT id, list_transform(l, lambda w: regexp_replace(w, '(ed|s)$', '')) AS l FROM plain)"""


@query("search_stemmed", with_views(X.ARTICLES, STEM_SQL, select="""
SELECT CAST(id AS VARCHAR) AS id FROM toks WHERE list_contains(l, 'onth') AND NOT list_contains(l, 'thand')"""))
def _(spark, sf):
    stem = lambda w: F.regexp_replace(w, "(ed|s)$", "")
    store, rows = _store(spark), X.articles(spark, sf).withColumn("id", F.col("id").cast("string"))
    store.write_index(rows, "run-1", stem=stem)
    text = "onths -thanded"
    postings = search.needed_postings(store.read("postings"), text, stem=stem)
    return A.select_articles(
        rows, A.ArticleFilters(search=text), postings=postings, stem=stem).select("id")


@query("search_top", with_views(X.ARTICLES, RANKED_SQL, select="""
SELECT id, rank, published_at FROM ranked JOIN articles USING (id)
WHERE rank < 30 ORDER BY rank DESC, published_at DESC NULLS LAST, id DESC LIMIT 21"""))
def _(spark, sf):
    store, rows = _store(spark), X.articles(spark, sf)
    store.write_index(rows.withColumn("id", F.col("id").cast("string")), "run-1")
    keyed = rows.withColumn("number", F.col("id")).withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))
    store.write_index(keyed, "run-1")  # written again: the run's blocks are replaced with its postings
    stats = written(search.index_stats(store.read("doc_lengths")), "corpus")
    page = search.search_top(
        keyed, search.needed_postings(store.read("postings"), SEARCH), store.read("posting_blocks"), stats, SEARCH, 20, (30.0, None, ""))
    return page.select(F.col("number").alias("id"), F.round("rank", 6).alias("rank"), "published_at")


@query("english_stem", with_views(X.ARTICLES, TOKENS, """
vocabulary AS (SELECT DISTINCT unnest(l) AS word FROM toks)""", stems.ENGLISH_SQL, select="SELECT word, stem FROM stems"))
def _(spark, sf):
    words = X.articles(spark, sf).select(F.explode(search.tokens(F.concat_ws(" ", "title", "summary", "body"))).alias("word"))
    return words.distinct().select("word", stems.english(F.col("word")).alias("stem"))


@query("search_english", with_views(X.ARTICLES, TOKENS, """
vocabulary AS (SELECT DISTINCT unnest(l) AS word FROM toks)""", stems.ENGLISH_SQL, select=f"""
SELECT CAST(t.id AS VARCHAR) AS id FROM (SELECT id, unnest(l) AS word FROM toks) t JOIN stems USING (word)
WHERE word NOT IN {_in(STOPS)} GROUP BY t.id HAVING bool_or(stem = 'enher') AND bool_or(stem = 'onth') AND NOT bool_or(stem = 'thand')"""))
def _(spark, sf):
    rows = X.articles(spark, sf).withColumn("id", F.col("id").cast("string"))
    store = tables.NewsStore(spark, scratch_dir(spark, "store"), stem=stems.english)
    store.write_index(rows, "run-1")
    text = "enhering onths -thanded"
    postings = search.needed_postings(store.read("postings"), text, stem=store.stem)
    return A.select_articles(rows, A.ArticleFilters(search=text), postings=postings, stem=store.stem).select("id")


# --- Whole cycle and streams -------------------------------------------------------------------


def _arriving(shares: list[DataFrame], drain: Callable[[DataFrame], None]) -> None:
    """Let shares of a table land one after the other and drain the stream after each: a micro-batch per share, read and
    written with as many tasks as the table has."""
    spark = shares[0].sparkSession
    landed = scratch_dir(spark, "landed")
    for share in shares:
        share.write.mode("append").options(**LANDED).parquet(landed)
        drain(spark.readStream.schema(share.schema).parquet(landed))


def _feed_sources(spark: SparkSession, sf: str) -> DataFrame:
    return X.articles(spark, sf).select("source_name").distinct().select(
        F.col("source_name").alias("id"), F.col("source_name").alias("name"), F.lit("Asia/Kolkata").alias("timezone_hint"),
        F.lit(True).alias("is_active"), F.lit("CLOSED").alias("circuit_breaker_state"), F.lit("RSS").alias("source_type"))


# Articles of the cycle: dated ones carry GMT, a missing summary is the item's encoded content.
CYCLE_SQL = rf"""
cycle AS (
  SELECT id, url, source_name, trim(regexp_replace(title, '[{text.SPACE}]+', ' ', 'g')) AS title, published_at,
         trim(regexp_replace(coalesce(summary, body), '[{text.SPACE}]+', ' ', 'g')) AS clean_summary, id // 100 AS poll
  FROM articles),
fine AS (
  SELECT *, sha256('v2|' || {X._canon('title')} || '|' || {X._canon('clean_summary')}) AS content_hash
  FROM cycle WHERE length(title) >= 5
    AND (published_at IS NULL OR TIMESTAMP '{X.GATE_AS_OF}' - published_at <= INTERVAL 72 HOUR)),
saved AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY source_name, poll, id) AS r FROM fine)
  WHERE r = 1)"""


@query("ingest_cycle", with_views(X.ARTICLES, CYCLE_SQL, select="""
SELECT url, title, source_name, published_at, content_hash, clean_summary AS summary FROM saved"""))
def _(spark, sf):
    store = _store(spark)
    ingest_cycle(store, X.payloads(spark, sf), _feed_sources(spark, sf), "run-1", datetime.fromisoformat(X.GATE_AS_OF))
    return store.read("articles").select("url", "title", "source_name", "published_at", "content_hash", "summary")


@query("run_record", with_views(X.ARTICLES, CYCLE_SQL, select=f"""
SELECT 'run-1' AS id, TIMESTAMP '{X.GATE_AS_OF}' AS started_at, (SELECT count(*) FROM fine) AS articles_ingested,
       (SELECT count(*) FROM saved) AS articles_saved, 0::BIGINT AS duplicates_detected,
       (SELECT count(*) FROM articles) - (SELECT count(*) FROM fine) AS failures,
       (SELECT count(DISTINCT source_name) FROM articles) AS source_count, 'PARTIAL_SUCCESS' AS status,
       'SCHEDULED' AS trigger_type"""))
def _(spark, sf):
    run = ingest_cycle(
        _store(spark), X.payloads(spark, sf), _feed_sources(spark, sf), "run-1", datetime.fromisoformat(X.GATE_AS_OF))
    return run.select(
        "id", "started_at", "articles_ingested", "articles_saved", "duplicates_detected", "failures", "source_count",
        "status", "trigger_type")


@query("stream_ingest", with_views(X.ARTICLES, CYCLE_SQL.replace(
    "ORDER BY source_name, poll, id", "ORDER BY poll % 2, source_name, poll, id"), select="""
SELECT url, title, source_name, published_at, content_hash, clean_summary AS summary FROM saved"""))
def _(spark, sf):
    payloads, store, offsets = X.payloads(spark, sf), _store(spark), scratch_dir(spark, "offsets")
    poll = F.element_at(F.split("payload_id", "-"), -1).cast("bigint")
    _arriving([payloads.filter(poll % 2 == part) for part in (0, 1)], lambda stream: jobs.stream_ingest(
        store, stream, _feed_sources(spark, sf), offsets))
    return store.read("articles").select("url", "title", "source_name", "published_at", "content_hash", "summary")


def _breaker_cycle_sql(cycles: int) -> str:
    """Source state after each of some cycles in which every third source fails."""
    steps = ["""c0 AS (
  SELECT id, id % 3 = 0 AS bad, circuit_breaker_state AS state, consecutive_failures AS n, 0 AS good, 0 AS failed
  FROM sources WHERE is_active AND source_type = 'RSS')"""]
    for k in range(1, cycles + 1):
        steps.append(f"""c{k} AS (
  SELECT id, bad, CASE WHEN state = 'OPEN' THEN state WHEN NOT bad THEN 'CLOSED' WHEN n + 1 >= {health.OPEN_AFTER} THEN 'OPEN'
                       WHEN state = 'HALF_OPEN' THEN 'OPEN' ELSE 'CLOSED' END AS state,
         CASE WHEN state = 'OPEN' THEN n WHEN bad THEN n + 1 ELSE 0 END AS n,
         good + CASE WHEN state <> 'OPEN' AND NOT bad THEN 1 ELSE 0 END AS good,
         failed + CASE WHEN state <> 'OPEN' AND bad THEN 1 ELSE 0 END AS failed
  FROM c{k - 1})""")
    return ",\n".join(steps)


@query("breaker_cycle", with_views(X.SOURCES, _breaker_cycle_sql(2), select="""
SELECT CAST(id AS VARCHAR) AS source_id, CAST(good AS BIGINT) AS success_count, CAST(failed AS BIGINT) AS failure_count,
       CASE WHEN good + failed = 0 THEN 100.0::DOUBLE ELSE good / (good + failed)::DOUBLE * 100 END AS health_score,
       state AS circuit_breaker_state, n AS consecutive_failures FROM c2"""))
def _(spark, sf):
    store = _store(spark)
    sources = X.sources(spark, sf).withColumn("id", F.col("id").cast("string")).filter(
        "is_active and source_type = 'RSS'").drop("health_score")
    page = F.when(F.col("id").cast("bigint") % 3 == 0, F.lit("<rss><channel>")).otherwise(F.concat(
        F.lit("<rss><channel><item><title>News of "), "name", F.lit("</title><link>"), "url", F.lit("</link></item></channel></rss>")))
    for cycle in (1, 2):
        payloads = sources.select(
            F.concat("id", F.lit(f"-{cycle}")).alias("payload_id"), F.col("id").alias("source_id"),
            now().alias("fetched_at"), page.alias("payload"))
        ingest_cycle(store, payloads, sources, f"run-{cycle}", datetime(2024, 1, 31, cycle))
    return health.with_health(sources, store.read("source_health")).select(
        F.col("id").alias("source_id"), "success_count", "failure_count", "health_score", "circuit_breaker_state",
        "consecutive_failures")


@query("stream_dedup", "SELECT DISTINCT 'https://' || source || '.example.com/a/' || doc_id AS url FROM documents")
def _(spark, sf):
    landed, out = scratch_dir(spark, "landed"), scratch_dir(spark, "unique")
    X.incoming_articles(spark, sf).select("seq", "url", now().alias("collected_at")).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    jobs.run_to_files(jobs.stream_dedup(stream), out, scratch_dir(spark, "offsets"))
    return spark.read.parquet(out).select("url")


def _weeks(rows: DataFrame, day: Column) -> list[DataFrame]:
    """The rows in time order as four shares."""
    week = F.coalesce(F.least(F.floor(day / 8), F.lit(3)), F.lit(0))
    return [rows.filter(week == part) for part in range(4)]


@query("stream_hourly_trends", with_views(X.MENTIONS, select="SELECT * FROM hourly"))
def _(spark, sf):
    out, offsets = scratch_dir(spark, "trends"), scratch_dir(spark, "offsets")
    events = X.table(spark, sf, "events")
    _arriving(_weeks(events, F.day("ts")), lambda stream: jobs.run_updates(jobs.stream_hourly_trends(stream.select(
        F.col("event_type").alias("entity"), F.pmod("user_id", F.lit(4)).cast("string").alias("entity_type"),
        F.col("ts").cast("timestamp").alias("published_at"), F.col("ts").cast("timestamp").alias("collected_at"))), out, offsets))
    return jobs.latest_counts(spark, out, ["entity", "entity_type", "time_bucket"])


@query("stream_sentiment_daily", with_views(X.ARTICLES, DAILY_SQL, select="SELECT * FROM daily"))
def _(spark, sf):
    out, offsets = scratch_dir(spark, "moods"), scratch_dir(spark, "offsets")
    rows = X.articles(spark, sf).select("id", "published_at", "sentiment_label", F.col("published_at").alias("collected_at"))
    _arriving(_weeks(rows, F.day("published_at")), lambda stream: jobs.run_updates(
        jobs.stream_sentiment_daily(stream), out, offsets, fold_every=2))
    return jobs.latest_counts(spark, out, ["date_bucket", "sentiment_label"])


@query("stream_breaker", BREAKER_ORACLE)
def _(spark, sf):
    out, offsets = scratch_dir(spark, "breaker"), scratch_dir(spark, "offsets")
    _arriving(_weeks(X.table(spark, sf, "events"), F.day("ts")), lambda stream: jobs.stream_breaker(stream.select(
        F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (F.col("event_type") != "error").alias("ok")), out, offsets))
    return jobs.breaker_history(spark, out).select(
        "source_id", "event_id", "consecutive_failures", "circuit_breaker_state")
