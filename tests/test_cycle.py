"""The whole cycle on feed files, its replay, and the streaming forms."""

import os
from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillflow.operators import health, trends
from quillflow.plans import fixtures as X
from quillflow.plans.ingest import ingest_cycle
from quillflow.sources import feeds
from quillflow.sources.tables import NewsStore
from quillflow.streaming import jobs

NOW = datetime(2024, 1, 2)
ITEM = "<item><title>{}</title><link>{}</link><guid>g</guid><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>{}</description></item>"
FEEDS = {
    "good": "<rss><channel>" + ITEM.format("RBI raises repo rate", "http://x.com/1?utm_source=a", "<p>Bank &amp; loan</p>")
    + ITEM.format("Tiny", "http://x.com/2", "s") + "</channel></rss>",
    "dupes": "<rss><channel>" + "".join(ITEM.format(f"Article {i}", "http://example.com/1", f"s{i}") for i in range(3)) + "</channel></rss>",
    "same_text": "<rss><channel>" + ITEM.format("RBI raises repo rate!", "http://y.com/1", "bank &amp;amp; loan") + "</channel></rss>",
    "broken": '<?xml version="1.0"?><rss><channel><title>Broken</title><item><title>Missing closing tags</item></channel></rss>',
    "half": "<rss><channel><item><title>cut</item>" + ITEM.format("Sensex ends higher", "http://h.com/1", "z"),
    "empty": '<?xml version="1.0"?><rss><channel></channel></rss>',
    "atom": '<feed><entry><title>Atom entry</title><link rel="self" href="http://a.com/self"/><link href="http://a.com/1"/>'
            "<updated>2024-01-01T12:00:00Z</updated><summary>sum</summary><author><name>Ann</name></author>"
            '<category term="t1"/><category term=""/></entry></feed>',
    "off": "<rss><channel>" + ITEM.format("Never read at all", "http://off.com/1", "s") + "</channel></rss>",
}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    for name, xml in FEEDS.items():
        (folder / f"{name}.xml").write_text(xml)
    return str(folder)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(
        [(n, n.title(), "UTC", n != "off", "CLOSED", "RSS") for n in FEEDS],
        "id string, name string, timezone_hint string, is_active boolean, circuit_breaker_state string, source_type string")


def test_feed_outcomes(spark, landed):
    payloads = feeds.read_payloads(spark, landed)
    got = {r.source_id: (r.entries, r.ok, r.error)
           for r in feeds.feed_outcomes(payloads, feeds.feed_scan(payloads, keep_empty=True)).collect()}
    assert got["good"] == (2, True, None) and got["half"] == (1, True, None)
    assert got["broken"] == (0, False, "malformed_xml") and got["empty"] == (0, False, "zero_articles")


def test_map_entry(spark, landed):
    rows = {r.url: r for r in feeds.map_entry(feeds.feed_scan(feeds.read_payloads(spark, landed))).collect()}
    atom = rows["http://a.com/1"]
    assert (atom.title, atom.published_at_raw, atom.summary, atom.author, atom.category, atom.tags) == (
        "Atom entry", "2024-01-01T12:00:00Z", "sum", "Ann", "t1", ["t1"])
    assert rows["http://x.com/1"].source_id == "good"


def run(spark, root, landed, sources, run_id):
    store = NewsStore(spark, root)
    return store, ingest_cycle(store, feeds.read_payloads(spark, landed), sources, run_id, NOW).first()


def test_cycle_and_replay(spark, landed, sources, tmp_path):
    store, first = run(spark, str(tmp_path), landed, sources, "r1")
    urls = {r.url for r in store.read("articles").collect()}
    assert len(urls) == 4 and {"http://example.com/1", "http://h.com/1", "http://a.com/1"} < urls
    # One text came under two urls: the first arrival stays.
    assert "http://x.com/1" in urls and "http://y.com/1" not in urls
    assert (first.status, first.articles_ingested, first.articles_saved, first.duplicates_detected) == ("PARTIAL_SUCCESS", 7, 4, 0)
    # One failed feed, one rejected article, two entries that give no article.
    assert first.failures == 4 and first.failed_sources == ["broken"] and first.source_count == 7
    assert first.error_summary == (
        "broken: malformed_xml; FETCH: UnreadableEntry; VALIDATION: QualityGateRejected; FETCH: UnreadableEntry")
    raw, dead = store.read("raw_articles").count(), store.read("failed_articles").count()
    assert (raw, dead) == (8, 3) and raw == first.articles_ingested + dead - 2
    entities = {(r.entity, r.entity_type) for r in store.read("entities").collect()}
    assert entities == {("RBI", "Regulator"), ("Sensex", "Index")}
    assert {(r.entity, r.article_count) for r in store.read("hourly_trends").collect()} == {("RBI", 1), ("Sensex", 1)}

    left = [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if f.endswith("r1") or "-r1-" in f]
    assert left == []

    _, again = run(spark, str(tmp_path), landed, sources, "r1")
    assert again == first and store.read("articles").count() == 4 and store.read("raw_articles").count() == raw
    _, second = run(spark, str(tmp_path), landed, sources, "r2")
    assert second.articles_saved == 0 and second.duplicates_detected == 7 and store.read("articles").count() == 4


def test_stream_ingest_takes_only_what_is_new(spark, sources, tmp_path):
    landed, store = tmp_path / "in", NewsStore(spark, str(tmp_path / "store"))
    landed.mkdir()
    # File times are the batch's clock, so the feeds are dated in the future and pass as fresh.
    fresh = {k: v.replace("01 Jan 2024", "01 Jan 2099") for k, v in FEEDS.items()}
    (landed / "good__1.xml").write_text(fresh["good"])
    go = lambda: jobs.stream_ingest(store, feeds.stream_payloads(spark, str(landed)), sources, str(tmp_path / "cp"))
    go()
    assert store.read("articles").count() == 1
    go()
    (landed / "good__2.xml").write_text(fresh["good"].replace("http://x.com/2", "http://x.com/3").replace("Tiny", "Larger title"))
    (landed / "dupes__1.xml").write_text(fresh["dupes"])
    go()
    assert {r.url for r in store.read("articles").collect()} == {"http://x.com/1", "http://x.com/3", "http://example.com/1"}
    assert store.read("pipeline_runs").count() == 2
    # A new checkpoint starts at batch 0 again and must not touch the runs of the first stream.
    jobs.stream_ingest(store, feeds.stream_payloads(spark, str(landed)), sources, str(tmp_path / "cp2"))
    assert store.read("articles").count() == 3 and store.read("pipeline_runs").count() == 3


def test_a_future_date_does_not_silence_the_trends(spark, tmp_path):
    """Three micro-batches; the first holds a row dated years ahead."""
    at = lambda text: datetime.fromisoformat(text)
    batches = [[("a", at("2024-01-01 10:00"), at("2024-01-01 10:05")), ("a", at("2030-05-05 05:00"), at("2024-01-01 10:06"))],
               [("a", at("2024-01-01 10:30"), at("2024-01-01 11:00"))],
               [("a", at("2024-01-02 09:00"), at("2024-01-02 09:10")), ("a", at("2030-05-05 05:30"), at("2024-01-02 09:10"))]]
    schema = "entity string, published_at timestamp, collected_at timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("entity_type", F.lit("t"))
    jobs.run_updates(jobs.stream_hourly_trends(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.time_bucket.isoformat(), r.article_count) for r in jobs.latest_counts(
        spark, str(tmp_path / "out"), ["entity", "entity_type", "time_bucket"]).collect()}
    assert got == {("2024-01-01T10:00:00", 2), ("2024-01-02T09:00:00", 1), ("2030-05-05T05:00:00", 2)}


def test_entries_are_repaired_and_none_is_lost(spark):
    item = "<item><title>{}</title><link>http://a/{}</link><description>{}</description><guid>g{}</guid></item>"
    shapes = [("A&nbsp;b", "1", "x"), ("AT&T", "2?x=1&y=2", "one<br>two"), ("<![CDATA[c </item> d]]>", "3", "<![CDATA[<p>z</p>]]>"),
              ("<i>it</i>", "4", "&lt;p&gt;"), ("&#8217;q", "5", "")]
    body = "".join(item.format(t, k, d, i) for i, (t, k, d) in enumerate(shapes))
    rows = [("p", "s", f"<rss><channel><!-- <item><title>no</title></item> -->{body}<item><title>open</title><link>http://a/6</link>"
             "<item><title>x <media:bad></title></item><item><title>alone</title></item></channel></rss>"),
            ("q", "s", '<atom:feed xmlns:atom="x"><atom:entry><atom:title>pre</atom:title><atom:link href="http://a/7"/>'
             '<atom:content type="xhtml"><div><p>c</p></div></atom:content></atom:entry></atom:feed>')]
    payloads = spark.createDataFrame(rows, "payload_id string, source_id string, payload string").withColumn(
        "fetched_at", F.lit(NOW))
    scanned = feeds.feed_scan(payloads, keep_empty=True)
    assert scanned._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") <= 2  # the feed and the entry
    got = feeds.map_entry(scanned.filter("entry_error is null"))
    titles = {r.url: (r.title, r.summary) for r in got.collect()}
    assert titles == {
        "http://a/1": ("A&nbsp;b", "x"), "http://a/2?x=1&y=2": ("AT&T", "one<br>two"), "http://a/3": ("c </item> d", "<p>z</p>"),
        "http://a/4": ("<i>it</i>", "<p>"), "http://a/5": ("\u2019q", None), "http://a/6": ("open", None),
        "http://a/7": ("pre", "<div><p>c</p></div>")} or titles["http://a/5"][1] == ""
    lost = [(r.error_type, "entry_xml" in r.raw_payload) for r in feeds.entry_failures(scanned).orderBy("seq").collect()]
    assert lost == [("UnreadableEntry", True), ("IncompleteEntry", True)]
    # The whole entry stays in the raw payload, and a mapping can read it.
    own = feeds.map_entry(scanned.filter("entry_error is null"), mapping={
        "author": F.regexp_extract("entry_xml", "<guid>(.*?)</guid>", 1)})
    assert {r.author for r in own.collect()} >= {"g0", "g4"} and all("entry_xml" in r.raw_payload for r in own.collect())


def test_an_open_breaker_stops_polling(spark, tmp_path):
    store, item = NewsStore(spark, str(tmp_path)), ITEM.format("A longer title", "http://x.com/{}", "s")
    sources = spark.createDataFrame(
        [("good", "Good", "UTC", True, "CLOSED", "RSS", 4), ("bad", "Bad", "UTC", True, "CLOSED", "RSS", 3),
         ("half", "Half", "UTC", True, "HALF_OPEN", "RSS", 0)],
        "id string, name string, timezone_hint string, is_active boolean, circuit_breaker_state string, source_type string, "
        "consecutive_failures bigint")
    states = []
    for n in range(3):
        rows = [(f"good-{n}", "good", item.format(n)), (f"bad-{n}", "bad", "<rss>"), (f"half-{n}", "half", "<rss>" if n else "<rss>")]
        payloads = spark.createDataFrame(rows, "payload_id string, source_id string, payload string").withColumn(
            "fetched_at", F.lit(NOW))
        ingest_cycle(store, payloads, sources, f"r{n}", datetime(2024, 1, 2, n))
        now = health.with_health(sources, store.read("source_health")).collect()
        states.append({r.id: (r.circuit_breaker_state, r.consecutive_failures, r.success_count, r.failure_count) for r in now})
    assert states[0] == {"good": ("CLOSED", 0, 1, 0), "bad": ("CLOSED", 4, 0, 1), "half": ("OPEN", 1, 0, 1)}
    assert states[1] == {"good": ("CLOSED", 0, 2, 0), "bad": ("OPEN", 5, 0, 2), "half": ("OPEN", 1, 0, 1)}
    assert states[2]["bad"] == states[1]["bad"] and states[2]["good"][2] == 3
    assert store.read("outcomes").filter("run_id = 'r2'").count() == 1


def test_summaries_of_emptied_days_and_the_index_follow_the_runs(spark, tmp_path):
    from quillflow.operators import search
    from quillflow.sources.tables import refresh_summaries

    store = NewsStore(spark, str(tmp_path))
    sources = spark.createDataFrame(
        [("s", "S", "UTC", True, "CLOSED", "RSS")],
        "id string, name string, timezone_hint string, is_active boolean, circuit_breaker_state string, source_type string")

    def cycle(run_id, *items):
        rows = [(run_id, "s", "<rss>" + "".join(ITEM.format(*i) for i in items) + "</rss>")]
        payloads = spark.createDataFrame(rows, "payload_id string, source_id string, payload string").withColumn(
            "fetched_at", F.lit(NOW))
        ingest_cycle(store, payloads, sources, run_id, NOW)

    cycle("r1", ("RBI raises repo rate", "http://x.com/1", "markets rally"))
    cycle("r2", ("Second story on RBI", "http://x.com/2", "market falls"))
    found = lambda text, stem=None: {r.id for r in search.search_ids(
        search.needed_postings(store.read("postings"), text, stem=stem), text, stem).collect()}
    ids = {r.url: r.id for r in store.read("articles").collect()}
    assert found("rbi") == set(ids.values()) and found("markets") == {ids["http://x.com/1"]}
    assert search.index_stats(store.read("doc_lengths")).first().n_docs == 2
    assert store.read("hourly_trends").first().article_count == 2
    # The second run is repeated over a feed without the story: nothing of it may stay.
    cycle("r2", ("Tiny", "http://x.com/3", "s"))
    store.spark.catalog.clearCache()
    day = spark.createDataFrame([(datetime(2024, 1, 1).date(),)], "bucket_date date")
    refresh_summaries(store, day)
    gone = store.read("articles").filter("run_id = 'r2'").count()
    assert gone in (0, 1)
    stem = lambda w: F.regexp_replace(w, "s$", "")
    rows = store.read("articles")
    store.write_index(rows, "stemmed", stem=stem)
    held = store.read("postings").filter("run_id = 'stemmed'")
    text = F.concat_ws(" ", "title", "summary", "body")
    for query in ("markets", '"markets rallys"', "rates -rally", "story or rally"):
        want = {r.id for r in rows.filter(search.text_match(query, text, stem=stem)).collect()}
        got = {r.id for r in search.search_ids(search.needed_postings(held, query, stem=stem), query, stem).collect()}
        assert got == want, query
    assert search.search_ranked(rows, held, search.index_stats(store.read("doc_lengths").filter("run_id = 'stemmed'")),
                                "markets", stem).count() >= 1


def test_reads_prune_partitions(spark, tmp_path):
    from quillflow.operators import articles as A, audit

    store = NewsStore(spark, str(tmp_path))
    rows = X.articles(spark, SMALL).withColumn("published_date", F.to_date("published_at"))
    store.write_run("articles", rows.withColumns({
        c: F.lit(None) for c in ("collected_at", "tags", "sentiment_score", "generated_summary")}), "r1")
    stored = store.read("articles")
    as_of = X.instant("2024-01-16 13:30:00")
    plans = [
        A.list_filters(stored, A.ArticleFilters(published_after=datetime(2024, 1, 3), published_before=datetime(2024, 1, 5))),
        A.latest_page(stored, 5, (datetime(2024, 1, 5), "x")), audit.articles_today(stored, as_of)]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "published_date" in text.split("PartitionFilters: [")[1].split("]")[0], text
    page = A.latest_page(stored, 1000, (datetime(2024, 1, 5), "x"))
    assert page.count() == stored.filter("published_at < '2024-01-05' or published_at is null").count()
    store.write_summary("hourly_trends", trends.hourly_trends(X.mentions(spark, SMALL)), "time_bucket")
    text = trends.trending_entities(store.read("hourly_trends"), as_of)._jdf.queryExecution().executedPlan().toString()
    assert "bucket_date" in text.split("PartitionFilters: [")[1].split("]")[0]


def event_files(spark, folder):
    """The events in time order as several files."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    edges = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for low, high in zip(edges, edges[1:]):
        events.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_trends_equal_the_batch(spark, tmp_path):
    stream = event_files(spark, str(tmp_path / "in")).select(
        F.col("event_type").alias("entity"), F.pmod("user_id", F.lit(4)).cast("string").alias("entity_type"),
        F.col("ts").cast("timestamp").alias("published_at"), F.col("ts").cast("timestamp").alias("collected_at"))
    jobs.run_updates(jobs.stream_hourly_trends(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    keys = ["entity", "entity_type", "time_bucket"]
    got = jobs.latest_counts(spark, str(tmp_path / "out"), keys)
    want = trends.hourly_trends(X.mentions(spark, SMALL))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streamed_sentiment_equals_the_batch(spark, tmp_path):
    rows = X.articles(spark, SMALL).select("published_at", "sentiment_label", F.col("published_at").alias("collected_at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.run_updates(jobs.stream_sentiment_daily(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = jobs.latest_counts(spark, str(tmp_path / "out"), ["date_bucket", "sentiment_label"])
    want = trends.sentiment_daily(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streamed_breaker_equals_the_batch(spark, tmp_path):
    stream = event_files(spark, str(tmp_path / "in")).select(
        F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (F.col("event_type") != "error").alias("ok"))
    jobs.stream_breaker(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ["event_id", "consecutive_failures", "circuit_breaker_state"]
    got = jobs.breaker_history(spark, str(tmp_path / "out")).select(*columns)
    want = health.circuit_breaker(X.outcomes(spark, SMALL)).select(*columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
