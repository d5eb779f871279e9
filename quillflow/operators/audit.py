"""Counts, integrity checks and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .articles import on_dates


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, rows in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def enrichment_counts(entities: DataFrame, sectors: DataFrame, keywords: DataFrame) -> DataFrame:
    return table_counts({"entities": entities, "sectors": sectors, "keywords": keywords})


def summary_counts(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    return table_counts({"hourly_trends": hourly, "sentiment_summaries": daily})


def articles_today(articles: DataFrame, as_of: Column) -> DataFrame:
    """Articles dated today or later."""
    return on_dates(articles, as_of).filter(F.col("published_at") >= F.date_trunc("day", as_of))


def dashboard_stats(articles: DataFrame, sources: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Headline figures in one row; the article table is scanned once."""
    figures = articles.agg(
        F.count("*").alias("total_articles"),
        F.count_if(F.col("published_at") >= F.date_trunc("day", as_of)).alias("articles_today"))
    good = runs.filter(F.col("status").isin("SUCCESS", "PARTIAL_SUCCESS"))
    return figures.select(
        "total_articles",
        sources.filter("is_active").agg(F.count("*")).scalar().alias("active_sources"),
        "articles_today",
        good.agg(F.max("started_at")).scalar().alias("last_ingestion"))


def dedup_ratio(runs: DataFrame) -> DataFrame:
    inserted, duplicates = F.sum("articles_ingested"), F.sum("duplicates_detected")
    share = duplicates / F.nullif(inserted + duplicates, F.lit(0)) * 100
    return runs.agg(
        inserted.alias("total_inserted"), duplicates.alias("total_duplicates"),
        F.round(share, 2).alias("duplicate_percentage"))


def failure_breakdown(failed: DataFrame) -> DataFrame:
    return (
        failed.groupBy("failure_stage", "error_type")
        .agg(F.count("*").alias("failure_count"), F.max("created_at").alias("latest_failure"))
        .orderBy(F.col("failure_count").desc(), "failure_stage", "error_type"))


def recent_failures(failed: DataFrame, limit: int = 20) -> DataFrame:
    return failed.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def duplicate_keys(articles: DataFrame) -> DataFrame:
    """Urls and content hashes that occur more than once."""
    def repeats(column: str) -> DataFrame:
        return (
            articles.groupBy(F.col(column).alias("key_value")).agg(F.count("*").alias("frequency"))
            .filter("frequency > 1")
            .select(F.lit(column).alias("key_name"), "key_value", "frequency"))
    return repeats("url").unionAll(repeats("content_hash"))


def source_distribution(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_name").agg(F.count("*").alias("article_count"))


def _linked(articles: DataFrame, raw: DataFrame) -> DataFrame:
    """Articles with the raw rows of their canonical url."""
    return articles.alias("a").join(raw.alias("r"), F.col("a.url") == F.col("r.source_url"))


def lineage_join(articles: DataFrame, raw: DataFrame, url_like: str = "%") -> DataFrame:
    """Raw rows and run behind every article whose url matches the pattern."""
    return _linked(articles.filter(F.col("url").like(url_like)), raw).select(
        F.col("a.id").alias("canonical_id"), F.col("r.id").alias("raw_id"), "r.run_id", "a.quality_score",
        F.col("r.fetched_at").alias("raw_collected_at"))


def raw_vs_canonical(articles: DataFrame, raw: DataFrame, limit: int = 5) -> DataFrame:
    """Raw and cleaned values side by side for the newest articles.

    The newest linked articles are found on narrow columns; payloads are read for those few only.
    """
    field = lambda name: F.get_json_object("r.raw_payload", f"$.{name}")
    known = raw.select(F.col("source_url").alias("url"))
    newest = articles.select("id", "url", "title", "published_at", "quality_score", "created_at").join(
        known, "url", "left_semi").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return (
        _linked(F.broadcast(newest), raw)  # `limit` rows at most
        .select(
            F.col("a.id").alias("canonical_id"), F.col("r.id").alias("raw_id"),
            field("title").alias("raw_title"), F.col("a.title").alias("canonical_title"),
            field("published").alias("raw_published"), F.col("a.published_at").alias("canonical_published"),
            "a.quality_score", "a.created_at")
        .orderBy(F.col("created_at").desc(), F.col("canonical_id").desc(), F.col("raw_id").desc())
        .limit(limit)
        .drop("created_at"))


def replay_reconcile(runs: DataFrame, raw: DataFrame, failed: DataFrame, limit: int | None = None) -> DataFrame:
    """Per run: raw rows against saved, duplicate and failed ones. Both sides are counted first."""
    collected = raw.groupBy("run_id").agg(F.count("*").alias("raw_collected"))
    failures = failed.groupBy("run_id").agg(F.count("*").alias("failed_items"))
    report = (
        collected.join(runs.withColumnRenamed("id", "run_id"), "run_id")
        .join(failures, "run_id", "left")
        .select(
            "run_id", "raw_collected",
            F.col("articles_ingested").alias("canonical_saved"),
            F.col("duplicates_detected").alias("duplicates_skipped"),
            F.coalesce("failed_items", F.lit(0)).alias("failed_items"))
        .orderBy(F.col("run_id").desc()))
    return report if limit is None else report.limit(limit)


def orphan_check(children: DataFrame, parents: DataFrame, foreign_key: str = "article_id") -> DataFrame:
    """Child rows whose parent is missing."""
    return children.join(parents.select(F.col("id").alias(foreign_key)), foreign_key, "left_anti")
