"""Source health: outcome counts, circuit breaker, feed audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lexicons import MAX_ARTICLE_AGE_HOURS
from ..session import written

OPEN_AFTER = 5


def source_health(outcomes: DataFrame, at: str = "ts", order: str = "event_id") -> DataFrame:
    """Counts, last times, last error and score per source from (source_id, ok, error) rows.

    One partial aggregate: a source with a large part of the outcomes is reduced before the shuffle.
    """
    ok = F.col("ok")
    return (
        outcomes.groupBy("source_id")
        .agg(
            F.count_if(ok).alias("success_count"),
            F.count_if(~ok).alias("failure_count"),
            F.max(F.when(ok, F.col(at))).alias("last_success_at"),
            F.max(F.when(~ok, F.col(at))).alias("last_failure_at"),
            F.max(F.struct(F.col(at), F.col(order), F.when(~ok, F.col("error")).alias("error")))["error"].alias(
                "last_error"))
        .withColumn(
            "health_score",
            F.col("success_count") / (F.col("success_count") + F.col("failure_count")) * 100.0))


def circuit_breaker(
    outcomes: DataFrame,
    at: str = "ts",
    order: str = "event_id",
    initial: DataFrame | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """Consecutive failures and breaker state after every outcome.

    The history, sorted by source and time, is cut into ranges of about equal length, so no task has to hold a
    whole source or a busy day of one: failures are counted inside each range, one summary row per source and
    range carries the run of failures over to the next, and the two are added. `chunk` cuts by a calendar unit instead,
    which saves the sort. `initial` gives (source_id, circuit_breaker_state,
    consecutive_failures) from before the first outcome.
    """
    ok = F.col("ok")
    inside = Window.partitionBy("source_id", "_chunk").orderBy(at, order)
    if chunk is None:
        # Written: which range a row is in must not change between the readers of this column.
        cut = written(outcomes.repartitionByRange("source_id", at, order).withColumn("_chunk", F.spark_partition_id()), "ranges")
    else:
        cut = outcomes.withColumn("_chunk", F.date_trunc(chunk, F.col(at)))
    rows = (
        cut
        .withColumn("_place", F.row_number().over(inside))
        .withColumn("_last_ok", F.max(F.when(ok, F.col("_place"))).over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_local", F.col("_place") - F.coalesce("_last_ok", F.lit(0))))

    # Same partitioning as the windows above, so the summary needs no shuffle of its own.
    summary = rows.groupBy("source_id", "_chunk").agg(
        F.max("_last_ok").isNotNull().alias("_won"),
        F.max(F.struct("_place", "_local"))["_local"].alias("_tail"))
    line = Window.partitionBy("source_id").orderBy("_chunk")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_span", F.count_if("_won").over(so_far))
    span = Window.partitionBy("source_id", "_span").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_out", F.sum("_tail").over(span))
    carried = summary.select(
        "source_id", "_chunk",
        F.coalesce(F.lag("_out").over(line), F.lit(0)).alias("_carry"),
        # True while the source has had no success in an earlier chunk.
        (F.col("_span") - F.col("_won").cast("int") == 0).alias("_untouched"))

    joined = rows.join(carried, ["source_id", "_chunk"])
    no_win_yet = F.col("_last_ok").isNull()
    virgin = F.col("_untouched") & no_win_yet
    if initial is None:
        start_state, start_count = F.lit("CLOSED"), F.lit(0)
    else:
        before = initial.select(
            "source_id", F.col("circuit_breaker_state").alias("_state0"),
            F.col("consecutive_failures").alias("_count0"))
        joined = joined.join(before, "source_id", "left")
        start_state = F.coalesce("_state0", F.lit("CLOSED"))
        start_count = F.coalesce("_count0", F.lit(0))
    carry = F.when(no_win_yet, F.col("_carry")).otherwise(0) + F.when(virgin, start_count).otherwise(0)
    failures = F.when(ok, F.lit(0)).otherwise(F.col("_local") + carry).cast("bigint")
    state = (
        F.when(ok, "CLOSED")
        .when(failures >= OPEN_AFTER, "OPEN")
        .when(virgin & start_state.isin("OPEN", "HALF_OPEN"), "OPEN")
        .otherwise("CLOSED"))
    return joined.select(
        *outcomes.columns, failures.alias("consecutive_failures"), state.alias("circuit_breaker_state"))


def breaker_now(states: DataFrame, at: str = "ts", order: str = "event_id") -> DataFrame:
    """Latest breaker state per source."""
    last = F.max(F.struct(F.col(at), F.col(order), "circuit_breaker_state", "consecutive_failures"))
    return states.groupBy("source_id").agg(last.alias("l")).select(
        "source_id", "l.circuit_breaker_state", "l.consecutive_failures")


HEALTH = {
    "success_count": "bigint", "failure_count": "bigint", "last_success_at": "timestamp", "last_failure_at": "timestamp",
    "last_error": "string", "health_score": "double", "circuit_breaker_state": "string", "consecutive_failures": "bigint",
}


def with_health(sources: DataFrame, applied: DataFrame) -> DataFrame:
    """Sources with their latest stored health, where there is one; what a source never had is zero or null.

    `applied` has one row per source and run, with the time of the run in `applied_at`.
    """
    start = {"success_count": 0, "failure_count": 0, "health_score": 100.0, "circuit_breaker_state": "CLOSED",
             "consecutive_failures": 0}
    last = applied.groupBy(F.col("source_id").alias("id")).agg(
        F.max(F.struct("applied_at", "run_id", *HEALTH)).alias("_last"))
    joined = sources.join(last, "id", "left")
    own = lambda c: F.col(c).cast(HEALTH[c]) if c in sources.columns else F.lit(None).cast(HEALTH[c])
    known = F.col("_last").isNotNull()
    return joined.withColumns({
        c: F.coalesce(F.when(known, F.col("_last")[c]).otherwise(own(c)), F.lit(start.get(c)).cast(kind))
        for c, kind in HEALTH.items()}).drop("_last")


def apply_outcomes(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New health of the sources that have outcomes (source_id, fetched_at, payload_id, ok, error).

    `sources` are the rows of `with_health`: earlier counts are added to, and the breaker goes on from
    its state and run of failures.
    """
    at, order = "fetched_at", "payload_id"
    seen = source_health(outcomes, at, order).drop("health_score")
    before = sources.select(
        F.col("id").alias("source_id"), *[F.col(c).alias(f"_{c}") for c in HEALTH])
    initial = sources.select(F.col("id").alias("source_id"), "circuit_breaker_state", "consecutive_failures")
    now = breaker_now(circuit_breaker(outcomes, at, order, initial), at, order)
    joined = seen.join(now, "source_id").join(before, "source_id")
    good = F.col("success_count") + F.col("_success_count")
    bad = F.col("failure_count") + F.col("_failure_count")
    return joined.select(
        "source_id", good.alias("success_count"), bad.alias("failure_count"),
        F.coalesce("last_success_at", "_last_success_at").alias("last_success_at"),
        F.coalesce("last_failure_at", "_last_failure_at").alias("last_failure_at"), "last_error",
        (good / (good + bad) * 100.0).alias("health_score"), "circuit_breaker_state", "consecutive_failures")


def feed_audit(feeds: DataFrame, entries: DataFrame, as_of: Column, stale_hours: float = MAX_ARTICLE_AGE_HOURS) -> DataFrame:
    """Entries, newest time and verdict per feed: FAILED without entries, STALE or VALID."""
    seen = entries.groupBy("source_id").agg(
        F.count("*").alias("entries"), F.max("published_at").alias("latest"))
    age = (F.unix_micros(as_of) - F.unix_micros("latest")) / F.lit(3_600_000_000.0)
    return (
        feeds.select(F.col("id").alias("source_id")).join(seen, "source_id", "left")
        .select(
            "source_id",
            F.coalesce("entries", F.lit(0)).alias("entries"), "latest",
            F.when(F.col("entries").isNull(), "FAILED").when(age > stale_hours, "STALE")
            .otherwise("VALID").alias("verdict")))


def unhealthy_sources(sources: DataFrame) -> DataFrame:
    """Sources that are not closed and fully successful, worst first."""
    sick = (F.col("circuit_breaker_state") != "CLOSED") | (F.col("health_score") < 100.0)
    return sources.filter(sick).orderBy(F.col("consecutive_failures").desc(), "slug")


def sources_by_name(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name", "id")


def sources_by_health(sources: DataFrame) -> DataFrame:
    return sources.orderBy("health_score", "id")
