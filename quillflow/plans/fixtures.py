"""Views of the model's tables over the given benchmark tables.

Each view has a Spark form and the same definition as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, content_hash

EPOCH = 1704067200  # 2024-01-01 00:00 UTC
AS_OF = "2024-01-31 00:00:00"
GATE_AS_OF = "2024-01-16 00:00:00"


def instant(text: str) -> Column:
    return F.lit(text + " UTC").cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles from `documents`: first line title, second line summary, whole text body."""
    n = F.col("doc_id")
    minute = F.pmod(n * 7919, F.lit(43200))
    rows = table(spark, sf, "documents").select(
        n.alias("id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 512).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), n.cast("string")).alias("url"),
        F.concat(F.lit("desk-"), "lang").alias("author"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("https://img.example.com/"), n.cast("string")).alias("image_url"),
        F.when(n % 17 != 0, F.timestamp_seconds(F.lit(EPOCH) + minute * 60)).alias("published_at"),
        F.col("lang").alias("category"),
        F.when(F.col("n_chars") > 2000, "positive").when(F.col("n_chars") > 1000, "negative").alias("sentiment_label"),
        F.nullif(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit("")).alias("summary"),
        F.col("text").alias("body"),
        F.substring("source", 4, 10).cast("bigint").alias("feed_source_id"),
        F.timestamp_seconds(F.lit(EPOCH) + n * 60).alias("created_at"),
    )
    return rows.withColumns({
        "content_hash": content_hash(F.col("title"), F.col("summary")),
        "sentiment": F.col("sentiment_label"),
        "quality_score": F.when(F.col("summary").isNull(), F.lit(0.7)).otherwise(F.lit(1.0)),
    })


def _canon(x: str) -> str:
    return (
        f"coalesce(trim(regexp_replace(regexp_replace(lower({x}), '[^{WORD}{SPACE}]', '', 'g'), "
        f"'[{SPACE}]+', ' ', 'g')), '')")


ARTICLES = f"""
base AS (
  SELECT *, substr(split_part(text, chr(10), 1), 1, 512) AS title,
         nullif(split_part(text, chr(10), 2), '') AS summary
  FROM documents),
articles AS (
  SELECT doc_id AS id, title, 'https://' || source || '.example.com/a/' || doc_id AS url,
         'desk-' || lang AS author, source AS source_name,
         'https://img.example.com/' || doc_id AS image_url,
         CASE WHEN doc_id % 17 <> 0
              THEN TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) END AS published_at,
         lang AS category,
         CASE WHEN n_chars > 2000 THEN 'positive' WHEN n_chars > 1000 THEN 'negative' END AS sentiment_label,
         CASE WHEN n_chars > 2000 THEN 'positive' WHEN n_chars > 1000 THEN 'negative' END AS sentiment,
         summary, text AS body, CAST(substr(source, 4) AS BIGINT) AS feed_source_id,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
         sha256('v2|' || {_canon('title')} || '|' || {_canon('summary')}) AS content_hash,
         CASE WHEN summary IS NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS quality_score
  FROM base)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Feed sources from `supplier`."""
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("id"),
        F.col("s_name").alias("name"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"),
        F.concat(F.lit("https://feeds.example.com/"), F.col("s_suppkey").cast("string")).alias("url"),
        F.when(nation < 20, "RSS").when(nation < 23, "API").otherwise("SCRAPER").alias("source_type"),
        F.when(nation < 12, "Asia/Kolkata").otherwise("UTC").alias("timezone_hint"),
        (balance >= 0).alias("is_active"),
        F.when(balance > 9000, "OPEN").when(balance > 8000, "HALF_OPEN").otherwise("CLOSED").alias("circuit_breaker_state"),
        F.greatest(nation - 15, F.lit(0)).cast("bigint").alias("consecutive_failures"),
        F.when(balance > 5000, F.lit(100.0)).otherwise(F.round(balance / 100, 2)).alias("health_score"),
    )


SOURCES = """
sources AS (
  SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug,
         'https://feeds.example.com/' || s_suppkey AS url,
         CASE WHEN s_nationkey < 20 THEN 'RSS' WHEN s_nationkey < 23 THEN 'API' ELSE 'SCRAPER' END AS source_type,
         CASE WHEN s_nationkey < 12 THEN 'Asia/Kolkata' ELSE 'UTC' END AS timezone_hint,
         s_acctbal >= 0 AS is_active,
         CASE WHEN s_acctbal > 9000 THEN 'OPEN' WHEN s_acctbal > 8000 THEN 'HALF_OPEN' ELSE 'CLOSED' END
           AS circuit_breaker_state,
         CAST(greatest(s_nationkey - 15, 0) AS BIGINT) AS consecutive_failures,
         CASE WHEN s_acctbal > 5000 THEN 100.0::DOUBLE ELSE round(s_acctbal / 100, 2) END AS health_score
  FROM supplier)"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Entity mentions from `events`."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("article_id"),
        F.col("event_type").alias("entity"),
        F.pmod("user_id", F.lit(4)).cast("string").alias("entity_type"),
        F.col("ts").cast("timestamp").alias("published_at"),
    )


MENTIONS = """
mentions AS (
  SELECT event_id AS article_id, event_type AS entity, CAST(user_id % 4 AS VARCHAR) AS entity_type,
         ts AS published_at
  FROM events),
hourly AS (
  SELECT entity, entity_type, date_trunc('hour', published_at) AS time_bucket, count(*) AS article_count
  FROM mentions GROUP BY ALL)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch outcomes from `events`: a user is a source, an error event a failure."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), "props")).alias("error"),
    )


OUTCOMES = """
outcomes AS (
  SELECT user_id AS source_id, ts, event_id, event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN 'error ' || props END AS error
  FROM events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs from `events`: value seconds long, status by event type."""
    kind = F.col("event_type")
    start = F.col("ts").cast("timestamp")
    millis = F.round(F.col("value") * 1000).cast("bigint")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        start.alias("started_at"),
        F.timestamp_micros(F.unix_micros(start) + millis * 1000).alias("completed_at"),
        millis.alias("duration_ms"),
        (millis / 1000.0).alias("duration_sec"),
        F.pmod("user_id", F.lit(40)).alias("articles_ingested"),
        F.pmod("user_id", F.lit(7)).alias("duplicates_detected"),
        F.when(kind == "error", "FAILED").when(kind == "signup", "RUNNING")
        .when(kind == "click", "PARTIAL_SUCCESS").otherwise("SUCCESS").alias("status"),
    )


RUNS = """
runs AS (
  SELECT event_id AS id, ts AS started_at,
         ts + to_microseconds(CAST(round(value * 1000) AS BIGINT) * 1000) AS completed_at,
         CAST(round(value * 1000) AS BIGINT) AS duration_ms,
         CAST(round(value * 1000) AS BIGINT) / 1000.0::DOUBLE AS duration_sec,
         user_id % 40 AS articles_ingested, user_id % 7 AS duplicates_detected,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING'
              WHEN 'click' THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status
  FROM events)"""


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters from `events`."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("source_id"),
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("failure_stage"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, F.repeat(F.lit("x"), F.lit(300)))
        .when(F.pmod("user_id", F.lit(3)) == 1, "Drop").alias("error_type"),
        F.concat(F.lit("value "), F.col("user_id").cast("string")).alias("error_message"),
        F.col("props").alias("raw_payload"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


FAILURES = """
failures AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source_id, user_id AS run_id, event_type AS failure_stage,
         CASE user_id % 3 WHEN 0 THEN repeat('x', 300) WHEN 1 THEN 'Drop' END AS error_type,
         'value ' || user_id AS error_message, props AS raw_payload, ts AS created_at
  FROM events)"""


def raw_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Uncleaned rows from `documents`, with three spellings of the date."""
    n = F.col("id")
    shown = F.when(n % 3 == 0, F.concat(F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0530"))).when(
        n % 3 == 1, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    rows = articles(spark, sf).select(
        n.alias("seq"), F.col("source_name").alias("source_id"), "source_name",
        F.lit("Asia/Kolkata").alias("timezone_hint"),
        F.concat(F.lit("  "), "title").alias("title"),
        F.concat("url", F.lit("?utm_source=rss")).alias("link"),
        F.lit(None).cast("string").alias("content"), "summary",
        F.concat(F.lit(" "), "author", F.lit(" ")).alias("author"),
        shown.alias("published_at_raw"), "category",
        F.array("category").alias("tags"), "created_at")
    payload = F.to_json(F.struct("link", "title", F.col("published_at_raw").alias("published"), "summary"))
    return rows.withColumn("raw_payload", payload)


RAW = """
raw AS (
  SELECT id AS seq, source_name AS source_id, '  ' || title AS raw_title, url || '?utm_source=rss' AS link,
         url, title AS given_title, summary, author, category, created_at,
         CASE id % 3 WHEN 0 THEN strftime(published_at, '%d %b %Y %H:%M:%S') || ' +0530'
                     WHEN 1 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S')
                     ELSE strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT' END AS published_at_raw,
         CASE WHEN id % 3 = 2 THEN published_at ELSE published_at - to_minutes(330) END AS published_at
  FROM articles)"""

STAGED = RAW + f""",
cleaned AS (
  SELECT *, nullif(trim(regexp_replace(raw_title, '[{SPACE}]+', ' ', 'g')), '') AS title,
         nullif(trim(regexp_replace(summary, '[{SPACE}]+', ' ', 'g')), '') AS clean_summary,
         date_diff('microsecond', published_at, TIMESTAMP '{GATE_AS_OF}') / 3600000000.0::DOUBLE AS age
  FROM raw),
gated AS (
  SELECT *, title IS NULL OR coalesce(age > 72, false) AS dropped,
         length(coalesce(title, '')) < 5 AS short, clean_summary IS NULL AS no_summary,
         coalesce(age < -1, false) AS future, coalesce(age > 72, false) AS old
  FROM cleaned),
scored AS (
  SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN no_summary THEN 0.3::DOUBLE ELSE 0 END
                     - CASE WHEN short THEN 0.5::DOUBLE ELSE 0 END
                     - CASE WHEN old THEN 1.0::DOUBLE ELSE 0 END) AS quality_score,
         concat_ws(', ', CASE WHEN short THEN 'TITLE_TOO_SHORT' END, CASE WHEN no_summary THEN 'SUMMARY_EMPTY' END,
                   CASE WHEN old THEN 'TIMESTAMP_TOO_OLD' WHEN future THEN 'TIMESTAMP_IN_FUTURE' END) AS violations
  FROM gated),
staged AS (
  SELECT *, quality_score >= 0.5 AND NOT short AND NOT old AS is_valid,
         CASE WHEN dropped THEN 'NORMALIZATION'
              WHEN quality_score >= 0.5 AND NOT short AND NOT old THEN 'PASSED' ELSE 'VALIDATION' END AS stage,
         sha256('v2|' || {_canon('title')} || '|' || {_canon('clean_summary')}) AS content_hash
  FROM scored)"""


def stored_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles the store holds already: the ones labelled good."""
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return articles(spark, sf).join(good, "id", "left_semi")


def incoming_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Every article, and all labelled ones sent a second time."""
    every = articles(spark, sf).withColumn("seq", F.col("id"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    again = every.join(labelled, "id", "left_semi").withColumn("seq", F.col("id") + 1_000_000_000_000)
    return every.unionByName(again)


BATCH = ARTICLES + """,
stored AS (SELECT * FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)),
incoming AS (
  SELECT *, id AS seq FROM articles
  UNION ALL
  SELECT *, id + 1000000000000 AS seq FROM articles WHERE id IN (SELECT doc_id FROM labels)),
checked AS (
  SELECT *, CASE WHEN url IN (SELECT url FROM stored) THEN 'exact_url'
                 WHEN content_hash IN (SELECT content_hash FROM stored) THEN 'exact_hash' END AS store_method
  FROM incoming),
url_ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS url_place FROM incoming),
hash_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS hash_place
  FROM url_ranked WHERE url_place = 1)"""

# Common words of the given texts, since the finance terms hardly occur in them.
ENTITY_WORDS = {
    "Company": ["the", "and"], "Regulator": ["that", "for"], "Index": ["with"], "Currency": ["was", "this"],
}
SECTOR_WORDS = {"Alpha": ["the", "of"], "Beta": ["and", "to"], "Gamma": ["in", "que"], "Delta": ["der", "la"]}
MOOD_WORDS = {"the": 0.25, "and": -0.25, "of": 0.125, "der": 0.5, "la": -0.5, "que": -0.125}


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Feed documents built from `documents`: a poll of one source holds at most 100 items."""
    def xml(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(plain), F.lit(safe))
        return text

    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    item = F.concat(
        F.lit("<item>"), tag("title", xml("title")),
        tag("link", F.concat(xml("url"), F.lit("?utm_source=rss"))),
        F.when(F.col("published_at").isNotNull(), tag("pubDate", F.concat(
            F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))).otherwise(F.lit("")),
        F.when(F.col("summary").isNotNull(), tag("description", xml("summary"))).otherwise(F.lit("")),
        tag("category", xml("category")), tag("category", F.lit("news")),
        tag("content:encoded", xml("body")), F.lit("</item>"))
    polls = (
        articles(spark, sf).withColumn("poll", F.floor(F.col("id") / 100))
        .groupBy("source_name", "poll")
        .agg(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).alias("items")))
    body = F.array_join(F.transform("items", lambda i: i["x"]), "")
    return polls.select(
        F.concat("source_name", F.lit("-"), F.lpad(F.col("poll").cast("string"), 9, "0")).alias("payload_id"),
        F.col("source_name").alias("source_id"),
        instant(GATE_AS_OF).alias("fetched_at"),
        F.concat(
            F.lit('<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'),
            body, F.lit("</channel></rss>")).alias("payload"))


def rough_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One feed document per article in nine everyday shapes, most of them no strict XML; the last is unreadable."""
    def xml(c: Column) -> Column:
        for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(plain), F.lit(safe))
        return c

    title, link, shape = xml(F.col("title")), F.col("url"), F.col("id") % 9
    item = lambda t, k, more="": F.concat(
        F.lit("<item><title>"), t, F.lit("</title><link>"), k, F.lit(f"</link>{more}</item>"))
    with_end = F.concat(F.lit("<![CDATA["), "title", F.lit(" </item>]]>"))
    atom = F.concat(
        F.lit('<atom:entry><atom:title>'), title, F.lit('</atom:title><atom:link href="'), link, F.lit('"/></atom:entry>'))
    body = (
        F.when(shape == 1, item(F.concat(title, F.lit("&nbsp;&rsquo;s")), link))
        .when(shape == 2, item(F.concat(title, F.lit(" AT&T")), link))
        .when(shape == 3, item(title, F.concat(link, F.lit("?x=1&y=2"))))
        .when(shape == 4, item(title, link, "<description>one<br>two <b>three</description>"))
        .when(shape == 5, item(with_end, link))
        .when(shape == 6, F.concat(F.lit("<!-- <item><title>hidden</title></item> -->"), item(title, link)))
        .when(shape == 7, atom)
        .when(shape == 8, item(F.concat(title, F.lit(" <media:open>")), link))
        .otherwise(F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link>"))))
    return articles(spark, sf).select(
        F.col("id").cast("string").alias("payload_id"), F.col("source_name").alias("source_id"),
        instant(GATE_AS_OF).alias("fetched_at"),
        F.concat(F.lit("<rss><channel><title>all</title>"), body, F.lit("</channel></rss>")).alias("payload"))


def odd_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One feed document per article in six shapes that a scanner can trip over."""
    def xml(c: Column) -> Column:
        for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(plain), F.lit(safe))
        return c

    n, title, link = F.col("id"), xml(F.col("title")), F.col("url")

    def item(title: Column, description: str, link: Column = link) -> Column:
        return F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><description>"),
                        F.lit(description), F.lit("</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))

    feed = lambda *parts: F.concat(F.lit("<rss><channel>"), *parts, F.lit("</channel></rss>"))
    shapes = [
        feed(F.lit("<!-- see <![CDATA[ and <item> here -->"), item(title, "plain")),
        F.concat(F.lit("<RSS><CHANNEL><ITEM><TITLE>"), title, F.lit("</TITLE><LINK>"), link,
                 F.lit("</LINK><DESCRIPTION>loud</DESCRIPTION><PUBDATE>Mon, 01 Jan 2024 00:00:00 GMT</PUBDATE></ITEM></CHANNEL></RSS>")),
        feed(item(title, "one <source src='a.mp4'> two <link rel=x>")),
        feed(item(title, "a <title>b</title> c <description>d</description>")),
        feed(item(F.concat(title, F.lit(" \x01\x1f&#2;!")), "odd \x0b sign")),
        feed(item(title, "<![CDATA[<!-- kept]]>"), item(title, "after", F.concat(link, F.lit("/second"))))]
    payload = F.when(F.lit(False), "")
    for k, shape in enumerate(shapes):
        payload = payload.when(n % 6 == k, shape)
    return articles(spark, sf).select(
        n.cast("string").alias("payload_id"), F.col("source_name").alias("source_id"), instant(AS_OF).alias("fetched_at"),
        payload.alias("payload"))


ODD = f"""
odd AS (
  SELECT CAST(id AS VARCHAR) AS payload_id,
         trim(regexp_replace(title, '[{SPACE}]+', ' ', 'g')) || CASE WHEN id % 6 = 4 THEN ' !' ELSE '' END AS title,
         url || second AS link, 'Mon, 01 Jan 2024 00:00:00 GMT' AS published,
         CASE id % 6 WHEN 0 THEN 'plain' WHEN 1 THEN 'loud' WHEN 2 THEN 'one <source src=''a.mp4''> two <link rel=x>'
           WHEN 3 THEN 'a <title>b</title> c <description>d</description>' WHEN 4 THEN 'odd  sign'
           ELSE CASE second WHEN '' THEN '<!-- kept' ELSE 'after' END END AS description
  FROM articles, (VALUES (''), ('/second')) v(second) WHERE second = '' OR id % 6 = 5)"""


ROUGH = f"""
rough AS (
  SELECT CAST(id AS VARCHAR) AS payload_id,
         CASE WHEN id % 9 < 8 THEN substr(trim(regexp_replace(title, '[{SPACE}]+', ' ', 'g')) || CASE id % 9
           WHEN 1 THEN ' ' || chr(8217) || 's' WHEN 2 THEN ' AT&T' WHEN 5 THEN ' </item>' ELSE '' END, 1, 512) END AS title,
         CASE WHEN id % 9 < 8 THEN url || CASE id % 9 WHEN 3 THEN '?x=1&y=2' ELSE '' END END AS link,
         CASE WHEN id % 9 = 4 THEN 'one<br>two <b>three' END AS description,
         CASE WHEN id % 9 = 8 THEN 'UnreadableEntry' END AS error
  FROM articles)"""
