"""The key index: buckets read, joins without moving the store, repeated runs, merges."""

import pytest
from pyspark.sql import functions as F

from quillflow.operators import dedup
from quillflow.sources.keys import KeyIndex
from quillflow.sources.tables import NewsStore

PAIR = "url string, content_hash string"


def pairs(spark, prefix, n, start=0):
    name = F.concat(F.lit(prefix), F.col("id").cast("string"))
    return spark.range(start, start + n, 1, 4).select(name.alias("url"), F.sha2(name, 256).alias("content_hash"))


def files_read(rows):
    """Names of the files that the scans of a plan open."""
    leaves = rows._jdf.queryExecution().sparkPlan().collectLeaves()
    names = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName().startswith("Scan parquet"):
            parts = leaf.inputRDDs().head().partitions()
            names += [f.filePath().toString() for part in parts for f in part.files()]
    return names


@pytest.fixture
def index(spark, tmp_path):
    made = KeyIndex(spark, str(tmp_path / "keys"), 32)
    for run in range(3):
        made.write_run(f"run {run}/a", pairs(spark, f"u{run}-", 3000))
    return made


def test_a_small_batch_opens_its_buckets_only(spark, index):
    wanted = spark.createDataFrame([("u1-7",), ("u2-9",), ("none",), (None,)], "url string")
    found = index.matching("url", wanted)
    assert {(r.url, r.run) for r in found.collect()} == {("u1-7", "run 1/a"), ("u2-9", "run 2/a")}
    buckets = {r[0] for r in wanted.filter("url is not null").select(F.expr("pmod(hash(url), 32)")).collect()}
    opened = {int(n.split("_")[-1].split(".")[0]) for n in files_read(found)}
    assert opened and opened <= buckets and len(files_read(found)) <= 3 * len(buckets)
    assert len(files_read(index.rows())) >= 3 * 32


def test_a_large_batch_does_not_move_the_stored_rows(spark, index):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = pairs(spark, "u1-", 4000, 1000)
        found = index.without("run 2/a").matching("url", wanted)
        assert found.count() == 2000
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        stored_side = plan[:plan.index("Bucketed: true")]
        assert "Exchange" not in stored_side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_replace_themselves_before_and_after_a_merge(spark, index):
    index.write_run("run 1/a", pairs(spark, "x", 10))
    assert index.rows().count() == 6010 and index.rows("content_hash").count() == 6010
    assert index.merge(3) == 1 and index.rows().count() == 6010
    index.write_run("run 0/a", pairs(spark, "y", 5))
    index.write_run("run 2/a", pairs(spark, "z", 0))
    assert index.rows().groupBy("run").count().orderBy("run").collect() == [("run 0/a", 5), ("run 1/a", 10)]
    for k in range(3):
        index.write_run(f"new{k}", pairs(spark, f"n{k}-", 4))
    # The merged segment with rows of older tries goes with them, or those would come back.
    index.merge(3)
    assert index.rows().groupBy("run").count().orderBy("run").collect() == [
        ("new0", 4), ("new1", 4), ("new2", 4), ("run 0/a", 5), ("run 1/a", 10)]
    with pytest.raises(ValueError):
        index.write_run("~1-x", pairs(spark, "q", 1))


def test_a_merge_that_breaks_off_loses_nothing(spark, index, monkeypatch):
    done = []

    def drop(self, key, segment):
        if done:
            raise RuntimeError("lost")
        done.append(segment)
        KeyIndex.__dict__["_really_drop"](self, key, segment)

    monkeypatch.setattr(KeyIndex, "_really_drop", KeyIndex._drop, raising=False)
    monkeypatch.setattr(KeyIndex, "_drop", drop)
    with pytest.raises(RuntimeError):
        index.merge(3)
    monkeypatch.undo()
    want = {(f"u{run}-5", f"run {run}/a") for run in range(3)}
    wanted = spark.createDataFrame([(f"u{run}-5",) for run in range(3)], "url string")
    assert {(r.url, r.run) for r in index.matching("url", wanted).collect()} == want
    assert index.rows().distinct().count() == 9000
    for k in range(3):
        index.write_run(f"more{k}", pairs(spark, f"m{k}-", 3))
    index.merge(3)
    assert index.rows().distinct().count() == 9009


def test_an_index_labels_as_the_stored_rows_do(spark, tmp_path):
    """One hash with half of the batch's urls and half of the stored ones."""
    hot = lambda p: F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit(p), F.col("id").cast("string")))
    stored = spark.range(0, 6000, 1, 4).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("url"), hot("h").alias("content_hash"))
    batch = spark.range(0, 6000, 1, 4).select(
        F.col("id").alias("seq"), F.concat(F.when(F.col("id") % 5 == 0, "s").otherwise("b"), F.col("id").cast("string")).alias("url"),
        hot("n").alias("content_hash"))
    index = KeyIndex(spark, str(tmp_path / "keys"), 8)
    assert not index.exists() and index.segments() == []
    index.write_run("r", stored)
    one, two = dedup.label_batch(batch, stored), dedup.label_batch(batch, index)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert dedup.insert_if_absent(batch, index).count() == dedup.insert_if_absent(batch, stored).count()
    got, want = dedup.existing_candidates(index, batch), dedup.existing_candidates(stored, batch)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_store_without_an_index_gets_one(spark, tmp_path):
    store = NewsStore(spark, str(tmp_path))
    assert not store.keys().exists()
    rows = pairs(spark, "u", 20).withColumn("published_date", F.lit("2024-01-01").cast("date"))
    others = [f.name for f in store._schema("articles") if f.name not in (*rows.columns, "run_id")]
    store.write_run("articles", rows.withColumns({c: F.lit(None) for c in others}), "old")
    assert store.keys().rows().count() == 20 and store.keys().without("old").rows().count() == 0
