"""Run accounting and run listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicons import DURATION_BOUNDS
from .articles import after_cursor

ERRORS_SHOWN = 10


def run_summary(staged: DataFrame, failures: DataFrame, errors: DataFrame) -> DataFrame:
    """Totals and status of one run as a single row.

    `staged` has `stage` and `dup_method`; `failures` are the run's dead letters, `errors` its
    source errors as (seq, message). Errors come first in the summary text, then dead letters.
    Only the ten messages that are shown are brought together.
    """
    totals = staged.agg(
        F.count_if(F.col("stage") == "PASSED").alias("articles_ingested"),
        F.count_if(F.col("dup_method").isin("exact_url", "exact_hash")).alias("duplicates_detected"))
    letters = failures.select(
        F.lit(1).alias("kind"), F.col("seq"),
        F.concat("failure_stage", F.lit(": "), "error_type").alias("message"))
    source_errors = errors.select(F.lit(0).alias("kind"), F.col("seq"), "message")
    first = source_errors.unionByName(letters).orderBy("kind", "seq").limit(ERRORS_SHOWN)
    shown = first.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("kind", "seq", "message"))), lambda m: m["message"]).alias("m"))
    n_failed = failures.agg(F.count("*")).scalar()
    n_errors = errors.agg(F.count("*")).scalar()
    counted = totals.select("*", (n_failed + n_errors).alias("failures"))
    return counted.select(
        "articles_ingested", "duplicates_detected", "failures",
        F.when(F.col("failures") == 0, "SUCCESS")
        .when(F.col("articles_ingested") > 0, "PARTIAL_SUCCESS")
        .otherwise("FAILED").alias("status"),
        F.nullif(shown.select(F.array_join("m", "; ")).scalar(), F.lit("")).alias("error_summary"))


def run_metrics(staged: DataFrame) -> DataFrame:
    """Per source: fetched, failed by stage, deduplicated, ingested."""
    stage = F.col("stage")
    duplicate = F.col("dup_method").isin("exact_url", "exact_hash")
    return staged.groupBy("source_id").agg(
        F.count("*").alias("fetched"),
        F.count_if(stage == "NORMALIZATION").alias("failed_normalization"),
        F.count_if(stage == "VALIDATION").alias("failed_validation"),
        F.count_if(duplicate).alias("deduplicated"),
        F.count_if((stage == "PASSED") & F.col("dup_method").isNull()).alias("ingested"))


def duration_histogram(runs: DataFrame, column: str, bounds: Sequence[float] = tuple(DURATION_BOUNDS)) -> DataFrame:
    """Cumulative counts per upper bound, from one pass over the rows."""
    counts = runs.agg(*[F.count_if(F.col(column) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[
        F.struct(F.lit(_bound_name(b)).alias("le"), F.col(f"b{i}").alias("runs")) for i, b in enumerate(bounds)])
    return counts.select(F.inline(pairs))


def _bound_name(bound: float) -> str:
    return "+Inf" if bound == float("inf") else str(bound)


def runs_page(runs: DataFrame, limit: int, cursor: tuple[datetime, object] | None = None) -> DataFrame:
    rows = runs if cursor is None else runs.filter(after_cursor(*cursor, time_column="started_at"))
    return rows.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit + 1)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Newest runs with their duration in seconds."""
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return (
        runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)
        .withColumn("duration_sec", seconds))


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run and whether it is still going."""
    return (
        runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)
        .withColumn("is_running", F.lower("status") == "running"))
