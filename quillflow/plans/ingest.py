"""One ingestion cycle: landed payloads to stored, enriched articles."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import label_batch
from ..operators.enrich import Enricher, enrich
from ..operators.health import apply_outcomes, with_health
from ..operators.maintenance import CHILDREN, child_rows
from ..operators.quality import passed, route_failures, stage_articles
from ..operators.runs import run_summary
from ..session import TEXTS, passing_scratch
from ..session import written as kept_rows
from ..sources.feeds import active_sources, arrival, entry_failures, feed_outcomes, feed_scan, map_entry
from ..sources.tables import (
    NewsStore, article_id, dead_letter, open_run, raw_append, refresh_summaries, run_record,
)

STAGED = [
    "seq", "source_id", "source_name", "title", "url", "content_hash", "content", "summary", "author",
    "published_at", "collected_at", "category", "tags", "quality_score", "violations", "stage", "raw_payload",
]


def written(rows: DataFrame, label: str) -> DataFrame:
    return kept_rows(rows, label, **TEXTS)


def ingest_cycle(
    store: NewsStore,
    payloads: DataFrame,
    sources: DataFrame,
    run_id: str,
    as_of: datetime,
    completed_at: Callable[[], datetime] | None = None,
    enrichers: Sequence[Enricher] | None = None,
    summaries: bool = False,
    mapping: dict | None = None,
) -> DataFrame:
    """Run one cycle and give its stored run row.

    Running the same `run_id` again over the same payloads replaces what the first try wrote:
    rows of this run do not count as stored when duplicates are looked for. What the cycle keeps in
    scratch folders goes when it ends.
    """
    with passing_scratch(store.spark):
        _cycle(store, payloads, sources, run_id, as_of, completed_at, enrichers, summaries, mapping)
    return store.read("pipeline_runs").filter(F.col("run_id") == run_id)


def _cycle(
    store: NewsStore, payloads: DataFrame, sources: DataFrame, run_id: str, as_of: datetime,
    completed_at: Callable[[], datetime] | None, enrichers: Sequence[Enricher] | None, summaries: bool,
    mapping: dict | None,
) -> None:
    at = F.lit(as_of).cast("timestamp")
    before = written(store.read_run("articles", run_id).select(
        F.col("published_date").alias("bucket_date")).distinct(), f"days-{run_id}")
    # Health as other runs have left it: a source whose breaker is open is not polled again.
    current = with_health(sources, store.health(without=run_id))
    usable = written(active_sources(current), f"sources-{run_id}")
    open_run(store, run_id, at)
    fetched = payloads.join(usable.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    scanned = written(feed_scan(fetched, keep_empty=True), f"entries-{run_id}")
    store.write_run("outcomes", feed_outcomes(fetched, scanned), run_id)
    fetches = store.read("outcomes").filter(F.col("run_id") == run_id)
    store.write_run("source_health", apply_outcomes(usable, fetches).withColumn("applied_at", at), run_id)
    entries = scanned.filter("item_pos is not null and entry_error is null").drop("payload_error", "entry_error")
    raw = written(map_entry(entries, usable, mapping).withColumn("seq", arrival()), f"raw-{run_id}")
    raw_error = None
    try:
        raw_append(store, raw, run_id, at)
    except Exception as e:
        raw_error = f"raw payloads not kept: {type(e).__name__}"

    # The payload goes on with dead letters, and with articles where an enricher of the caller's own might read it.
    needed = (F.col("stage") != "PASSED") | F.lit(enrichers is not None)
    staged = written(stage_articles(raw, at).withColumn("raw_payload", F.when(needed, F.col("raw_payload"))).select(
        *STAGED), f"staged-{run_id}")
    failures = route_failures(staged).unionByName(entry_failures(scanned))
    dead_letter(store, failures, run_id, at)

    keys = store.keys()
    known = keys.without(run_id) if keys.exists() else staged.select("url", "content_hash").limit(0)
    labels = written(
        label_batch(passed(staged).select("seq", "url", "content_hash"), known)
        .select("seq", "dup_method", "matched_url"), f"labels-{run_id}")
    fresh = passed(staged).join(labels.filter(F.col("dup_method").isNull()).select("seq"), "seq", "left_semi")
    enriched = written(
        enrich(fresh.withColumn("id", article_id(F.col("url"))), enrichers, summaries), f"enriched-{run_id}")
    _store_articles(store, enriched, run_id)
    keys.write_run(run_id, enriched)
    store.maintain(as_of.date())

    marked = staged.select("seq", "source_id", "stage").join(labels, "seq", "left")
    bad = fetches.filter("not ok and error != 'zero_articles'")
    errors = bad.select(
        F.struct("source_id", "fetched_at", "payload_id", F.lit(0).alias("item_pos")).alias("seq"),
        F.concat("source_id", F.lit(": "), "error").alias("message"))
    if raw_error:
        note = store.spark.range(1).select(
            F.lit(None).cast(errors.schema["seq"].dataType).alias("seq"), F.lit(raw_error).alias("message"))
        errors = errors.unionByName(note)
    named = bad.select("source_id").distinct().agg(F.sort_array(F.collect_list("source_id")))
    result = run_summary(marked, failures, errors).withColumns({
        "articles_saved": enriched.agg(F.count("*")).scalar(),
        "source_count": usable.agg(F.count("*")).scalar(),
        "failed_sources": named.scalar(),
    })
    done = completed_at() if completed_at else as_of
    run_record(store, run_id, result, at, F.lit(done).cast("timestamp"))
    # The days of this run, and those that an earlier try of it had touched.
    days = enriched.select(F.to_date("published_at").alias("bucket_date")).unionByName(before).filter(
        "bucket_date is not null").distinct()
    try:
        refresh_summaries(store, days)
    except Exception as e:
        # The run itself is stored; the next refresh of these days makes up for this one.
        warnings.warn(f"summaries not refreshed: {e}", stacklevel=2)


def _store_articles(store: NewsStore, enriched: DataFrame, run_id: str) -> None:
    dated = enriched.withColumn("published_date", F.to_date("published_at"))
    articles = dated.withColumns({
        "feed_source_id": F.col("source_id"), "body": F.col("content"),
        "image_url": F.lit(None).cast("string"), "sentiment": F.lit(None).cast("string"),
    })
    store.write_run("articles", articles, run_id)
    store.write_index(articles, run_id)
    for kind in CHILDREN:
        store.write_run(kind, child_rows(dated, kind, carry=["published_date"]), run_id)
