"""English stems and the ranked page that reads its best blocks only."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillflow.functions import stems
from quillflow.operators import search
from quillflow.plans.ingest import ingest_cycle
from quillflow.sources.tables import NewsStore

# Published examples of the rules.
STEMS = """consigned consign consignment consign consistency consist consistently consist consolations consol consolatory consolatori
consolidating consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir
constables constabl constancy constanc knackeries knackeri knaves knave knavish knavish kneeled kneel knightly knight knitting knit
knives knive generate generat generically generic communism communism arsenal arsenal hopping hop hoping hope falling fall ties tie
cries cri gas gas gaps gap skies sky dying die say say by by enjoy enjoy happily happili relational relat conditional condit
markets market rallies ralli theology theolog proceeding proceed news news yes yes youth youth boyish boyish innings inning
feed feed agreed agre bled bled hissing hiss abilities abil electricity electr adoption adopt""".split()


def test_known_stems(spark):
    rows = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2])), "word string, want string")
    assert rows.withColumn("got", stems.english(F.col("word"))).filter("got <> want").collect() == []
    odd = spark.createDataFrame([("",), (None,), ("é",), ("yy",), ("naïves",), ("日本",), ("x" * 5000 + "ing",)], "word string")
    got = [r[0] for r in odd.select(stems.english(F.col("word"))).collect()]
    assert got[:6] == ["", None, "é", "yy", "naïv", "日本"] and got[6] == "x" * 5000 + "ing"


def corpus(spark, n=3000):
    """Articles of many lengths; short ones say the searched words as often as long ones."""
    filler = lambda k: F.concat_ws(" ", F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(
        F.lit("w"), F.pmod(F.xxhash64("n", i), F.lit(400)).cast("string"))))
    n_words = F.pow(F.lit(1.6), F.pmod(F.col("n"), F.lit(14))).cast("int") + 2
    said = F.when(F.col("n") % 3 == 0, F.lit(" rally markets")).when(F.col("n") % 3 == 1, F.lit(" rallying of the market rally")).otherwise("")
    return spark.range(n).withColumnRenamed("id", "n").select(
        F.format_string("%06d", "n").alias("id"), F.concat(filler(n_words), said).alias("title"), F.lit(None).cast("string").alias("summary"),
        F.lit("").alias("body"), F.timestamp_seconds(F.lit(1704067200) + F.col("n") % 50).alias("published_at"))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    store = NewsStore(spark, str(tmp_path_factory.mktemp("search")), stem=stems.english)
    rows = corpus(spark)
    rows.write.parquet(store.path("rows"))
    rows = spark.read.parquet(store.path("rows"))
    store.write_index(rows.filter("id % 2 = 0"), "r0")
    store.write_index(rows.filter("id % 2 = 1"), "r1")
    stats = search.index_stats(store.read("doc_lengths"))
    return store, rows, spark.createDataFrame(stats.collect(), stats.schema)


@pytest.mark.parametrize("text", ["rally market", "rally -w7", '"market rally"', "rally w3 or market w5", "rallies"])
def test_the_page_is_the_one_of_all_matches(kept, text):
    store, rows, stats = kept
    postings = search.needed_postings(store.read("postings"), text, stem=store.stem)
    every = search.search_ranked(rows, postings, stats, text, store.stem)
    cursor = None
    for _ in range(2):
        want = [(r["id"], round(r["rank"], 9)) for r in search.search_page(every, 15, cursor).collect()]
        page = search.search_top(rows, postings, store.read("posting_blocks"), stats, text, 15, cursor, store.stem).collect()
        assert [(r["id"], round(r["rank"], 9)) for r in page] == want and want
        last = page[min(14, len(page) - 1)]
        cursor = (last["rank"], last["published_at"], last["id"])


def test_blocks_below_the_page_are_not_read(kept):
    store, rows, stats = kept
    postings = search.needed_postings(store.read("postings"), "rally market", stem=store.stem)
    waves = []
    page = search.search_top(
        rows, postings, store.read("posting_blocks"), stats, "rally market", 10, stem=store.stem, told=waves.append).collect()
    bounds = dict(search.block_bounds(store.read("posting_blocks"), stats, "rally market", store.stem))
    read = [b for wave in waves for b in wave]
    assert len(page) == 11 and len(read) == len(set(read)) and len(read) * 4 < len(bounds)
    rank = page[10]["rank"]
    assert all(bounds[b] < rank for b in set(bounds) - set(read))
    # No article ranks above the bound of its block.
    blocks = {r["id"]: r["doc_block"] for r in postings.select("id", "doc_block").distinct().collect()}
    every = search.search_ranked(rows, postings, stats, "rally market", store.stem).select("id", "rank").collect()
    assert len(every) > 1500 and all(r["rank"] <= bounds[blocks[r["id"]]] for r in every)


def test_searches_without_matches(kept):
    store, rows, stats = kept
    for text in ("nowhere", "the", "rally nowhere"):
        page = search.search_top(rows, store.read("postings"), store.read("posting_blocks"), stats, text, 5, stem=store.stem)
        assert page.count() == 0 and "rank" in page.columns


def test_the_cycle_keeps_a_stemmed_index(spark, tmp_path):
    store = NewsStore(spark, str(tmp_path), stem=stems.english)
    item = "<item><title>{}</title><link>http://x.com/{}</link><description>{}</description></item>"
    xml = "<rss>" + item.format("Markets rallied today", 1, "this has news") + item.format("A rally of the marketing", 2, "x") + "</rss>"
    payloads = spark.createDataFrame([("p", "s", xml)], "payload_id string, source_id string, payload string").withColumn(
        "fetched_at", F.lit(datetime(2024, 1, 2)))
    sources = spark.createDataFrame(
        [("s", "S", "UTC", True, "CLOSED", "RSS")],
        "id string, name string, timezone_hint string, is_active boolean, circuit_breaker_state string, source_type string")
    ingest_cycle(store, payloads, sources, "r1", datetime(2024, 1, 2))
    terms = {r["term"] for r in store.read("postings").collect()}
    assert {"market", "ralli", "today", "news"} <= terms and not terms & {"this", "thi", "ha", "has", "the", "markets"}
    text = F.concat_ws(" ", "title", "summary", "body")
    for query in ("rallies market", '"markets rallied"', "marketing -today", "his"):
        want = {r["id"] for r in store.read("articles").filter(search.text_match(query, text, stem=store.stem)).collect()}
        found = search.search_ids(search.needed_postings(store.read("postings"), query, stem=store.stem), query, store.stem)
        assert {r["id"] for r in found.collect()} == want, query
