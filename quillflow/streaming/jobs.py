"""Streaming forms of the cycle. Every job drains what has landed and stops; timing is the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lexicons import MAX_ARTICLE_AGE_HOURS
from ..operators.health import breaker_now, circuit_breaker
from ..plans.ingest import ingest_cycle
from ..sources.feeds import feed_scan
from ..sources.tables import NewsStore

LATENESS = f"{MAX_ARTICLE_AGE_HOURS} hours"


def _drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    (stream.writeStream.foreachBatch(batch).outputMode(mode)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """A batch's own folder: writing it again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    _drain(stream, lambda rows, n: _write_batch(rows, path, n), checkpoint)


FOLD_EVERY = 16  # batches


def run_updates(stream: DataFrame, path: str, checkpoint: str, fold_every: int = FOLD_EVERY) -> None:
    """As `run_to_files` for a stream of changed aggregates, whose latest values are folded into a base now and then.

    Batches are numbered; the base says up to which batch it goes. It is complete before readers take it, and the
    batches in it go only with the next base, so a reader that began with the last one can end.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, n: int) -> None:
        _write_batch(rows, path, n)
        upto = _base(spark, path)
        if n - (-1 if upto is None else upto) >= fold_every:
            _fold(spark, path, upto, n)

    _drain(stream, keep, checkpoint, "update")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    place, files = _folder(spark, path)
    found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))


def _base(spark: SparkSession, path: str) -> int | None:
    """The batch up to which the newest complete base goes."""
    for upto in reversed(_numbers(spark, f"{path}/_base", "upto")):
        place, files = _folder(spark, f"{path}/_base/upto={upto}/_SUCCESS")
        if files.exists(place):
            return upto
    return None


def _latest(spark: SparkSession, path: str, upto: int | None) -> DataFrame:
    """Newest value of every key, out of the base and the batches after it."""
    batches = [n for n in _numbers(spark, path, "batch_id") if upto is None or n > upto]
    parts = [spark.read.parquet(f"{path}/batch_id={n}").withColumn("batch_id", F.lit(n)) for n in batches]
    if upto is not None:
        parts.insert(0, spark.read.parquet(f"{path}/_base/upto={upto}"))
    if not parts:
        return spark.read.parquet(path)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    keys = [c for c in rows.columns if c not in ("article_count", "batch_id")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch_id", "article_count")).alias("_last")).select(
        *keys, "_last.article_count", "_last.batch_id")


def _fold(spark: SparkSession, path: str, upto: int | None, n: int) -> None:
    _latest(spark, path, upto).write.mode("overwrite").parquet(f"{path}/_base/upto={n}")
    old = [f"{path}/_base/upto={k}" for k in _numbers(spark, f"{path}/_base", "upto") if upto is not None and k < upto]
    old += [f"{path}/batch_id={k}" for k in _numbers(spark, path, "batch_id") if upto is not None and k <= upto]
    for folder in old:
        place, files = _folder(spark, folder)
        files.delete(place, True)


def landing_stream(payloads: DataFrame, path: str, checkpoint: str) -> None:
    """Entries of every payload that has landed since the last call."""
    run_to_files(feed_scan(payloads), path, checkpoint)


def stream_ingest(
    store: NewsStore, payloads: DataFrame, sources: DataFrame, checkpoint: str, prefix: str = "stream", **options
) -> None:
    """The whole cycle per micro-batch. The run id is the prefix, the stream's own id and the batch number.

    The stream's id belongs to its checkpoint: a second stream, or a new checkpoint, on the same store
    never meets the runs of the first, and a repeated batch replaces its own rows. The newest fetch
    time is the batch's clock, so a repeated batch decides as it did before.
    """
    spark = store.spark

    def cycle(batch: DataFrame, batch_id: int) -> None:
        clock = batch.agg(F.max("fetched_at")).first()[0]
        if clock is not None:
            ingest_cycle(
                store, batch, sources, f"{prefix}-{_stream_id(spark, checkpoint)}-{batch_id:09d}", clock, **options)

    _drain(payloads, cycle, checkpoint)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint keeps from its first start on."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_dedup(rows: DataFrame, key: str = "url", seen_at: str = "collected_at", horizon: str = LATENESS) -> DataFrame:
    """First row per key within the horizon; its state is dropped as the watermark moves on.

    Articles can be undated, so the collection time drives the watermark. What the state has
    forgotten the store still knows: the permanent check is the one in the ingestion cycle. Every input partition
    hands on one row per key and batch, so a key that fills a batch reaches its state task as a few rows.
    """
    return first_of_partition(rows, key).withWatermark(seen_at, horizon).dropDuplicatesWithinWatermark([key])


def first_of_partition(rows: DataFrame, key: str) -> DataFrame:
    """The first row per key of every partition; rows without a key all count as one key. Holds a partition's distinct keys."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(key)).to_pylist()
            fresh = []
            for place, value in enumerate(values):
                if value not in seen:
                    seen.add(value)
                    fresh.append(place)
            yield batch.take(pa.array(fresh, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def _clocked(rows: DataFrame, collected_at: str, lateness: str) -> DataFrame:
    """Adds `clock`, the event time of the watermark: the publication time, but at most an hour behind collection.

    A wrong date in the future so can't move the watermark beyond what has really been collected.
    """
    latest = F.col(collected_at) + F.expr("INTERVAL 1 HOUR")
    return rows.withColumn("clock", F.least("published_at", latest)).withWatermark("clock", lateness)


def stream_hourly_trends(mentions: DataFrame, lateness: str = LATENESS, collected_at: str = "collected_at") -> DataFrame:
    """Mentions per entity, type and hour, later rows up to the lateness included.

    `clock_bucket` parts the counts of an hour: rows dated in the future have the hour of their
    collection there. `latest_counts` adds the parts.
    """
    counted = _clocked(mentions, collected_at, lateness).groupBy(
        F.window("clock", "1 hour"), F.date_trunc("hour", "published_at").alias("time_bucket"), "entity", "entity_type"
    ).agg(F.count("*").alias("article_count"))
    return counted.select(
        "entity", "entity_type", "time_bucket", F.col("window.start").alias("clock_bucket"), "article_count")


def stream_sentiment_daily(articles: DataFrame, lateness: str = LATENESS, collected_at: str = "collected_at") -> DataFrame:
    """Articles per day and label; `clock_bucket` as in the hourly counts."""
    label = F.coalesce("sentiment_label", F.lit("NEUTRAL"))
    dated = articles.filter(F.col("published_at").isNotNull()).withColumn("sentiment_label", label)
    counted = _clocked(dated, collected_at, lateness).groupBy(
        F.window("clock", "1 day"), F.date_trunc("day", "published_at").alias("date_bucket"), "sentiment_label"
    ).agg(F.count("*").alias("article_count"))
    return counted.select("date_bucket", "sentiment_label", F.col("window.start").alias("clock_bucket"), "article_count")


def latest_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest count per key of a `run_updates` folder: the base and at most `fold_every` batches after it are read."""
    return _latest(spark, path, _base(spark, path)).groupBy(*keys).agg(F.sum("article_count").alias("article_count"))


def stream_breaker(outcomes: DataFrame, path: str, checkpoint: str, chunk: str | None = None) -> None:
    """Breaker state after every outcome, kept per source across micro-batches.

    A micro-batch is the batch computation with the state of the last batch as its start. State is
    a small table per batch number, so a repeated batch starts from the same state again, and no
    source's outcomes have to fit one task.
    """
    spark = outcomes.sparkSession

    def advance(batch: DataFrame, batch_id: int) -> None:
        before = _state(spark, path, batch_id - 1)
        states = circuit_breaker(batch, initial=before, chunk=chunk)
        _write_batch(states, f"{path}/history", batch_id)
        written = spark.read.schema(states.schema).parquet(f"{path}/history/batch_id={batch_id}")
        now = breaker_now(written)
        if before is not None:
            now = now.unionByName(before.join(now.select("source_id"), "source_id", "left_anti"))
        now.write.mode("overwrite").parquet(f"{path}/state/{batch_id}")

    _drain(outcomes, advance, checkpoint)


def _state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    if batch_id < 0:
        return None
    return spark.read.parquet(f"{path}/state/{batch_id}")


def breaker_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/history")
