import pytest
from pyspark.sql import functions as F

from quillflow.operators import dedup, maintenance
from quillflow.session import scratch_dir

KEYS = "seq long, url string, content_hash string"


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([("u1", "h1"), ("u2", "h2"), ("u9", "h9")], "url string, content_hash string")


@pytest.fixture(scope="module")
def batch(spark):
    return spark.createDataFrame([
        (1, "u1", "new"), (2, "new", "h2"), (3, "u3", "h3"), (4, "u3", "h4"), (5, "u5", "h3"), (6, "u3", "h3"),
        (7, "u1", "h2"), (8, "u8", "h4")], KEYS)


def labels(rows, column="dup_method"):
    return {r.seq: r[column] for r in rows.collect()}


def test_against_store(batch, stored):
    got = dedup.dedup_against_store(batch, stored)
    assert labels(got) == {1: "exact_url", 2: "exact_hash", 3: None, 4: None, 5: None, 6: None, 7: "exact_url", 8: None}
    assert labels(got, "matched_url")[1] == "u1" and labels(got, "matched_url")[2] is None
    assert labels(got, "is_duplicate")[3] is False


def test_in_batch_first_per_url_then_first_per_hash(batch):
    got = labels(dedup.label_batch(batch, batch.limit(0).select("url", "content_hash")))
    assert got == {1: None, 2: None, 3: None, 4: "batch_url", 5: "batch_hash", 6: "batch_url", 7: "batch_url", 8: None}


def test_both(batch, stored):
    assert labels(dedup.label_batch(batch, stored)) == {
        1: "exact_url", 2: "exact_hash", 3: None, 4: "batch_url", 5: "batch_hash", 6: "batch_url", 7: "exact_url", 8: None}


def test_candidates(batch, stored):
    got = {tuple(r) for r in dedup.existing_candidates(stored, batch).collect()}
    assert got == {("u1", "h1"), ("u2", "h2")}


def test_insert_twice(spark, batch):
    first = dedup.insert_if_absent(batch, batch.limit(0))
    assert {r.seq for r in first.collect()} == {1, 2, 3, 5, 8}
    assert dedup.insert_if_absent(batch, first).count() == 0


def test_one_key_with_a_third_of_the_rows(spark):
    n = 30_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("content_hash"))
    got = dedup.label_batch(rows, rows.limit(0).select("url", "content_hash")).groupBy("dup_method").count()
    assert {r.dup_method: r["count"] for r in got.collect()} == {
        None: n // 3 + 2, "batch_url": n // 3 - 1, "batch_hash": n // 3 - 1}


def test_repeats_are_dropped_before_the_shuffle(batch):
    plan = dedup.first_wins(batch, ["url"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_no_join_compares_every_pair(batch, stored):
    for rows in (dedup.label_batch(batch, stored), dedup.existing_candidates(stored, batch)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_upsert_changes_only_named_columns(spark):
    schema = "slug string, name string, health double"
    old = spark.createDataFrame([("a", "A", 1.0), ("b", "B", 2.0)], schema)
    new = spark.createDataFrame([("b", None, 9.0), ("c", "C", 3.0)], schema)
    got = {tuple(r) for r in maintenance.upsert_by_key(old, new, "slug", ["name"]).collect()}
    assert got == {("a", "A", 1.0), ("b", None, 2.0), ("c", "C", 3.0)}


def test_a_hot_key_is_split_in_the_join(spark):
    """With thresholds as low as the test data, adaptive execution divides the hot url's rows."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        n = 60_000
        rows = spark.range(0, n, 1, 8).select(
            F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("note"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("content_hash"))
        stored = rows.filter("url = 'hot'").limit(1).select("url", "content_hash")
        labelled = dedup.dedup_against_store(rows, stored)
        counts = {r.dup_method: r["count"] for r in labelled.groupBy("dup_method").count().collect()}
        assert counts == {"exact_url": n // 3, None: n - n // 3}
        labelled.collect()
        assert "skew=true" in labelled._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_hashes_are_split_in_every_store_join(spark, monkeypatch):
    """One hash with half of the batch's urls and half of the stored ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        def rows(prefix, n):
            hot = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id").cast("string")))
            return spark.range(0, n, 1, 8).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("url"), hot.alias("content_hash"))

        batch, stored = rows("b", 100_000), rows("s", 100_000)
        plans = []

        def seen(frame, label):
            plans.append((label, frame))
            path = scratch_dir(spark, label)
            frame.write.parquet(path)
            return spark.read.parquet(path)

        monkeypatch.setattr(dedup, "written", seen)
        assert dedup._store_hits(batch, stored).count() == 100_000
        assert dedup.existing_candidates(stored, batch).count() == 100_000
        for label, frame in plans:
            if label in ("matches", "candidates"):
                frame.collect()
                assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString(), label
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
