"""Kept stream summaries: folded batches, what a reader opens, folds that break off."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillflow.operators import audit
from quillflow.streaming import jobs

SCHEMA = "entity string, entity_type string, published_at timestamp, collected_at timestamp"
KEYS = ["entity", "entity_type", "time_bucket"]


def folders(path):
    return sorted(n for n in os.listdir(path) if n.startswith("batch_id=")), sorted(
        n for n in os.listdir(f"{path}/_base") if n.startswith("upto=")) if os.path.isdir(f"{path}/_base") else []


def test_a_reader_opens_a_bounded_number_of_batches(spark, tmp_path):
    start, rows = datetime(2024, 1, 1), []
    for k in range(14):
        at = start + timedelta(hours=k // 2)
        batch = [("a", "t", at, at), ("b", "t", at - timedelta(hours=5), at)] + [("a", "t", start, at)]
        rows += batch
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.run_updates(jobs.stream_hourly_trends(stream), out, str(tmp_path / "cp"), fold_every=3)
    batches, bases = folders(out)
    assert len(batches) <= 6 and 1 <= len(bases) <= 2
    want = spark.createDataFrame(rows, SCHEMA).groupBy(
        "entity", "entity_type", F.date_trunc("hour", "published_at").alias("time_bucket")).agg(F.count("*").alias("article_count"))
    got = jobs.latest_counts(spark, out, KEYS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert len(got.inputFiles()) <= 40
    # A fold that broke off before its base was complete is passed over.
    os.makedirs(f"{out}/_base/upto=99")
    assert sorted(map(tuple, jobs.latest_counts(spark, out, KEYS).collect())) == sorted(map(tuple, want.collect()))


def test_the_newest_pairs_read_payloads_for_a_few_articles(spark):
    articles = spark.range(200).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("t").alias("title"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit(1.0).alias("quality_score"),
        F.timestamp_seconds("id").alias("created_at"))
    raw = spark.range(0, 190).select(
        F.col("id"), F.concat(F.lit("u"), "id").alias("source_url"), F.concat(F.lit('{"title":"r'), "id", F.lit('"}')).alias("raw_payload"))
    raw = raw.unionByName(raw.filter("id = 189").withColumn("id", F.lit(1000).cast("bigint")))
    got = audit.raw_vs_canonical(articles, raw, 3).collect()
    assert [(r["canonical_id"], r["raw_id"], r["raw_title"]) for r in got] == [("189", 1000, "r189"), ("189", 189, "r189"), ("188", 188, "r188")]
