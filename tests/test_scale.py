"""What keeps the work of the index, the landed stream and the cycle in bounds."""

import time
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillflow.functions import stems
from quillflow.functions.words import merged_terms, positions_by_word, run_starts
from quillflow.operators import search
from quillflow.operators.enrich import standard_enrichers
from quillflow.plans import catalog, ingest
from quillflow.session import bytes_read
from quillflow.sources import tables
from quillflow.sources.segments import SegmentedTable
from quillflow.sources.tables import NewsStore, raw_append


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_sorted_by_their_own_order(spark):
    rows = spark.createDataFrame([("b a b the c",), ("",), (None,), ("the",)], "t string")
    counted = positions_by_word(F.split("t", " "), lambda w: ~w.isin("the", ""))
    got = [r[0] for r in rows.select(counted.alias("p")).collect()]
    assert [tuple(x) for x in got[0]] == [("a", 1, [1]), ("b", 2, [0, 2]), ("c", 1, [4])]
    assert got[1:] == [[], None, []]
    merged = merged_terms(counted, lambda w: F.translate(w, "b", "a"))
    assert [tuple(x) for x in rows.select(merged.alias("p")).first()[0]] == [("a", 3, [0, 1, 2]), ("c", 1, [4])]
    # array_sort() evaluates an expression for every comparison.
    assert "array_sort" not in plan(rows.select(merged)) and "sort_array" in plan(rows.select(merged))


def test_run_starts_of_odd_arrays(spark):
    rows = spark.createDataFrame([([(1,), (1,), (2,), (3,), (3,)],), ([(7,)],), ([],), (None,)], "a array<struct<k:int>>")
    assert [r[0] for r in rows.select(run_starts(F.col("a"), "k")).collect()] == [[0, 2, 3], [0], [], None]


def test_words_that_no_step_changes_skip_them(spark):
    words = ["onth", "enher", "walked", "sky", "words", "thand", "only", "", None, "ied", "tied", "bass", "gas", "taxi", "hall", "joy", "yard"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", stems._may_change(F.col("w")).alias("may"), stems.english(F.col("w")).alias("stem")).collect()
    stem = {r["w"]: r["stem"] for r in got}
    assert all(r["stem"] == r["w"] for r in got if r["may"] is False and not r["w"].endswith("s"))
    assert {r["w"] for r in got if r["may"]} == {"enher", "walked", "sky", "only", "ied", "tied", "bass", "hall", "joy"}
    assert (stem["walked"], stem["words"], stem["only"], stem["tied"], stem["gas"], stem["yard"]) == ("walk", "word", "onli", "tie", "gas", "yard")


def test_waves_carry_no_bodies(spark, tmp_path, monkeypatch):
    ids = [f"{n:03d}" for n in range(40)] + ["007", "007"]  # one id three times
    rows = spark.createDataFrame(
        [(i, "rally " * (int(i) % 5 + 1), None, "text", datetime(2024, 1, 1 + k % 9)) for k, i in enumerate(ids)],
        "id string, title string, summary string, body string, published_at timestamp")
    store = NewsStore(spark, str(tmp_path))
    store.write_index(rows.dropDuplicates(["id"]), "r")
    stats = spark.createDataFrame(search.index_stats(store.read("doc_lengths")).collect(), "n_docs bigint, mean_len double")
    carried, write = [], search.written
    monkeypatch.setattr(search, "written", lambda page, label: (carried.append(page.columns), write(page, label))[1])
    for limit in (3, 12, 60):
        page = search.search_top(rows, store.read("postings"), store.read("posting_blocks"), stats, "rally", limit)
        every = search.search_ranked(rows, store.read("postings"), stats, "rally")
        want = search.search_page(every, limit)
        assert page.columns == want.columns and page.collect() == want.collect()
    assert carried and all("body" not in c for c in carried)


def test_landed_files_can_be_shared_by_tasks(spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = spark.range(0, 1000, 1, 1).select("id", F.concat_ws("", F.transform(
        F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256))).alias("payload"))
    rows.write.options(**catalog.LANDED).parquet(path)
    groups = [pq.ParquetFile(f).num_row_groups for f in map(str, (tmp_path / "landed").glob("*.parquet"))]
    assert len(groups) == 1 and groups[0] >= 5
    assert spark.read.parquet(path).exceptAll(rows).isEmpty()


@pytest.mark.parametrize("own", [False, True])
def test_passed_rows_leave_their_payload_behind(spark, tmp_path, monkeypatch, own):
    sources = spark.createDataFrame([("s", "S", "UTC", True, "CLOSED", "RSS")], (
        "id string, name string, timezone_hint string, is_active boolean, circuit_breaker_state string, source_type string"))
    item = "<item><title>{}</title><link>http://x.com/{}</link><description>d{}</description></item>"
    xml = "<rss><channel>" + "".join(item.format(t, k, k) for k, t in enumerate(["Long enough one", "Long enough two", "Tiny"])) + "</channel></rss>"
    payloads = spark.createDataFrame([("p", "s", datetime(2024, 1, 1), xml)], "payload_id string, source_id string, fetched_at timestamp, payload string")
    seen, write = {}, ingest.written
    monkeypatch.setattr(ingest, "written", lambda rows, label: (
        lambda kept: (seen.update({r["title"]: r["raw_payload"] for r in kept.collect()}) if label.startswith("staged") else None, kept)[1])(write(rows, label)))
    store = NewsStore(spark, str(tmp_path))
    ingest.ingest_cycle(store, payloads, sources, "r", datetime(2024, 1, 2), enrichers=[*standard_enrichers(), ("copy", F.col("raw_payload"))] if own else None)
    # Dead letters have their payload, and raw payloads are all kept; an enricher of the caller's own may read them.
    assert seen["Tiny"] and store.read("failed_articles").filter("raw_payload like '%Tiny%'").count() == 1
    assert store.read("raw_articles").filter("raw_payload like '%title%'").count() == 3
    assert (seen["Long enough one"] is not None) == own and store.read("articles").count() == 2


def test_raw_payloads_are_not_gathered_by_a_shuffle(spark, tmp_path):
    store = NewsStore(spark, str(tmp_path))
    rows = spark.range(0, 60, 1, 6).select(
        F.struct("id").alias("seq"), F.lit("s").alias("source_id"), F.col("id").cast("string").alias("url"),
        F.lit(None).cast("string").alias("published_at_raw"), F.lit("{}").alias("raw_payload"))
    raw_append(store, rows, "r", F.lit(datetime(2024, 1, 1)))
    assert len([*(tmp_path / "raw_articles" / "run_id=r").glob("*.parquet")]) == 6 and store.read("raw_articles").count() == 60
    assert all(".zstd." in f.name for f in (tmp_path / "raw_articles" / "run_id=r").glob("*.parquet"))


def index_rows(store) -> dict:
    """What an index holds, without the order."""
    columns = {"postings": ["term", "id", "tf", "doc_len", "positions", "doc_block", "term_bucket"],
               "posting_blocks": ["term", "doc_block", "df", "max_tf", "min_len", "term_bucket"], "doc_lengths": ["id", "doc_len"]}
    return {t: sorted(map(repr, store.read(t).select("run_id", *c).collect())) for t, c in columns.items()}


def test_an_index_in_shares_is_the_same(spark, tmp_path, monkeypatch):
    spark.range(120).select(
        F.when(F.col("id") != 7, F.concat(F.lit("a"), F.col("id") % 90)).alias("id"),  # some ids twice, one null
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 20), lambda i: F.concat(
            F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(9)).cast("string")))).alias("title"),
        F.when(F.col("id") % 3 == 0, "the rally").alias("summary"), F.lit(None).cast("string").alias("body")).write.parquet(
        str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert bytes_read(rows) < tables.SHARE_BYTES  # written at once
    monkeypatch.setattr(tables, "MOST_SHARES", 4)
    stores = [NewsStore(spark, str(tmp_path / name)) for name in ("whole", "parts")]
    for store, size in zip(stores, (1 << 40, 1)):
        monkeypatch.setattr(tables, "SHARE_BYTES", size)
        store.write_index(rows.filter("id like '%1'"), "r0")
        store.write_index(rows, "r1")
        for table in tables.INDEXED:
            assert store.table(table).merge(fan_in=2) > 2
        held = [s for s in store.table("postings").segments() if s.runs == ("r0", "r1")]
        assert held
        store.write_index(rows.filter("id like '%2' or id is null"), "r0")  # a run in merged folders, written again with other rows
    assert index_rows(stores[1]) == index_rows(stores[0]) and len(index_rows(stores[0])["doc_lengths"]) > 120
    new = [s for s in stores[1].table("postings").segments() if s.runs == ("r0",)]
    assert len({s.name for s in new}) == 3  # the first share lies with the rows of the other run
    # No block lies in two shares.
    in_share = stores[1].table("postings")._files(new).select("doc_block", F.regexp_extract(F.col("_metadata.file_path"), "seg=([^/]+)", 1).alias("share"))
    assert in_share.distinct().groupBy("doc_block").count().filter("count > 1").isEmpty()


def test_an_index_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    monkeypatch.setattr(tables, "SHARE_BYTES", 1)
    monkeypatch.setattr(tables, "MOST_SHARES", 2)
    words = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string")))
    rows = spark.range(100).select(
        F.col("id").cast("string").alias("id"), F.concat_ws(" ", words).alias("title"), F.lit("a").alias("summary"), F.lit("rally").alias("body"))
    store, before, left, stage = NewsStore(spark, str(tmp_path)), found(), [], SegmentedTable._stage

    def shuffled():
        end, size = time.time() + 20, 1e9
        while size > 100_000 and time.time() < end:  # the files are deleted in the background
            time.sleep(0.05)
            size = sum(f.stat().st_size for f in found() - before if f.exists())
        return size

    monkeypatch.setattr(SegmentedTable, "_stage", lambda self, *rows: (left.append(shuffled()), stage(self, *rows))[1])
    store.write_index(rows, "r")
    left.append(shuffled())
    # When a share begins, no postings and no blocks that the shares before it have shuffled are left.
    assert len(left) == 5 and max(left) < 100_000
    assert store.read("postings").count() == store.read("posting_blocks").agg(F.sum("df")).first()[0] > 100 * 200
