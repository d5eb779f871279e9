import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillflow.operators import health, runs
from quillflow.sources.tables import NewsStore
from quillflow.streaming import jobs


def brute(rows, start):
    state, count = dict((s, v[0]) for s, v in start.items()), dict((s, v[1]) for s, v in start.items())
    out = {}
    for source, ts, event, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if ok:
            state[source], count[source] = "CLOSED", 0
        else:
            count[source] = count.get(source, 0) + 1
            if count[source] >= 5 or state.get(source) == "HALF_OPEN":
                state[source] = "OPEN"
        out[event] = (count[source], state.get(source, "CLOSED"))
    return out


@pytest.mark.parametrize("chunk", ["hour", "day"])
@pytest.mark.parametrize("initial", [False, True])
def test_breaker_equals_a_plain_loop(spark, chunk, initial):
    rng = random.Random(7)
    start_at = datetime(2024, 1, 1)
    rows = [(rng.choice("abbbb"), start_at + timedelta(minutes=rng.randrange(6000)), i, rng.random() < 0.3) for i in range(900)]
    start = {"a": ("HALF_OPEN", 2), "b": ("OPEN", 6)} if initial else {}
    events = spark.createDataFrame(rows, "source_id string, ts timestamp, event_id long, ok boolean")
    before = spark.createDataFrame(
        [(s, *v) for s, v in start.items()],
        "source_id string, circuit_breaker_state string, consecutive_failures long") if initial else None
    got = {r.event_id: (r.consecutive_failures, r.circuit_breaker_state)
           for r in health.circuit_breaker(events, initial=before, chunk=chunk).collect()}
    assert got == brute(rows, start)


def test_last_error_is_cleared_by_success(spark):
    rows = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), 1, False, "boom"), ("a", datetime(2024, 1, 2), 2, True, None),
         ("b", datetime(2024, 1, 1), 3, True, None), ("b", datetime(2024, 1, 2), 4, False, "late")],
        "source_id string, ts timestamp, event_id long, ok boolean, error string")
    got = {r.source_id: (r.success_count, r.failure_count, r.last_error, r.health_score) for r in health.source_health(rows).collect()}
    assert got == {"a": (1, 1, None, 50.0), "b": (1, 1, "late", 50.0)}


def run_row(spark, staged, letters, errors):
    s = spark.createDataFrame(staged, "seq long, source_id string, stage string, dup_method string")
    f = spark.createDataFrame(letters, "seq long, failure_stage string, error_type string")
    e = spark.createDataFrame(errors, "seq long, message string")
    return runs.run_summary(s, f, e).first()


def test_run_status(spark):
    good = [(1, "a", "PASSED", None), (2, "a", "PASSED", "exact_url"), (3, "a", "PASSED", "batch_url")]
    clean = run_row(spark, good, [], [])
    assert tuple(clean) == (3, 1, 0, "SUCCESS", None)
    part = run_row(spark, good, [(i, "VALIDATION", f"e{i}") for i in range(20)], [(9, "src down")])
    assert part.status == "PARTIAL_SUCCESS" and part.failures == 21
    assert part.error_summary == "; ".join(["src down"] + [f"VALIDATION: e{i}" for i in range(9)])
    assert run_row(spark, [(1, "a", "VALIDATION", None)], [(1, "VALIDATION", "x")], []).status == "FAILED"


def test_one_busy_day_is_cut_into_equal_ranges(spark):
    """One source has 90 % of the outcomes, all on one day; a source's breaker is still the sequential one."""
    n = 40_000
    rows = spark.range(0, n, 1, 4).select(
        F.when(F.col("id") % 10 != 0, "busy").otherwise(F.concat(F.lit("s"), (F.col("id") % 70).cast("string"))).alias("source_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 80_000).alias("ts"), F.col("id").alias("event_id"),
        (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("ok"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = health.circuit_breaker(rows).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    state = {}
    for r in sorted(got, key=lambda r: (r["source_id"], r["ts"], r["event_id"])):
        failures = 0 if r["ok"] else state.get(r["source_id"], 0) + 1
        state[r["source_id"]] = failures
        assert r["consecutive_failures"] == failures and r["circuit_breaker_state"] == ("OPEN" if failures >= 5 else "CLOSED")
    root = spark.conf.get("spark.checkpoint.dir")
    newest = max(glob.glob(f"{root}/ranges-*"), key=os.path.getmtime)
    sizes = sorted(r["count"] for r in spark.read.parquet(newest).groupBy("source_id", "_chunk").count().filter("source_id = 'busy'").collect())
    whole = sorted(r["count"] for r in spark.read.parquet(newest).groupBy("_chunk").count().collect())
    assert len(sizes) >= 6 and whole[-1] <= 2 * whole[len(whole) // 2]


def test_health_is_read_from_a_snapshot_and_the_newest_runs(spark, tmp_path):
    store = NewsStore(spark, str(tmp_path))
    names = [f.name for f in store._schema("source_health").fields]
    want = {}
    for run in range(11):
        rows = [(f"s{k}", run + 1, 0, None, None, None, 100.0, "CLOSED", 0, datetime(2024, 1, 1, run)) for k in range(3) if (run + k) % 3]
        frame = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in store._schema("source_health").fields[:-1]))
        store.write_run("source_health", frame, f"r/{run:02d}")
        want.update({r[0]: r[1] for r in rows})
        store.fold_health(keep=3)
    assert len(names) == 11 and store.read("source_health").select("run_id").distinct().count() <= 6
    sources = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("new",)], "id string")
    got = {r["id"]: r["success_count"] for r in health.with_health(sources, store.health("none")).collect()}
    assert got == {**want, "new": 0}
    # A run that is written again does not see itself.
    last = {r["id"]: r["success_count"] for r in health.with_health(sources, store.health("r/10")).collect()}
    assert max(last.values()) == 10


def test_a_hot_url_reaches_its_state_task_once_per_partition(spark):
    rows = spark.range(0, 8000, 1, 4).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"), "id")
    got = jobs.first_of_partition(rows.unionByName(rows.limit(2).withColumn("url", F.lit(None))), "url").groupBy("url").count()
    counts = {r["url"]: r["count"] for r in got.filter("count > 1 or url is null").collect()}
    assert counts["hot"] <= 5 and got.count() == 4000 + 2
