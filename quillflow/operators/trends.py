"""Trend and sentiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .articles import on_dates

DECAY_PER_HOUR = 0.1


def entity_article_join(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Mentions with the time of their article; undated articles are left out."""
    dated = articles.filter(F.col("published_at").isNotNull()).select(
        F.col("id").alias("article_id"), "published_at")
    return entities.join(dated, "article_id").select("article_id", "entity", "entity_type", "published_at")


def hourly_trends(mentions: DataFrame) -> DataFrame:
    """Mentions per entity, type and hour. Partial counts keep a hot entity's shuffle small."""
    return (
        mentions.filter(F.col("published_at").isNotNull())
        .groupBy("entity", "entity_type", F.date_trunc("hour", "published_at").alias("time_bucket"))
        .agg(F.count("*").alias("article_count")))


def sentiment_daily(articles: DataFrame) -> DataFrame:
    """Articles per day and label; unlabelled ones get their own NEUTRAL bucket."""
    return (
        articles.filter(F.col("published_at").isNotNull())
        .groupBy(
            F.date_trunc("day", "published_at").alias("date_bucket"),
            F.coalesce("sentiment_label", F.lit("NEUTRAL")).alias("sentiment_label"))
        .agg(F.count("*").alias("article_count")))


def trending_entities(
    hourly: DataFrame, as_of: Column, hours: int = 24, entity_type: str | None = None, limit: int = 10
) -> DataFrame:
    """Most mentioned entities with recent hours weighted higher.

    Only buckets that start inside the window count.
    """
    start = as_of - F.expr(f"INTERVAL {int(hours)} HOURS")
    rows = on_dates(hourly, start, partition="bucket_date").filter(F.col("time_bucket") >= start)
    if entity_type:
        rows = rows.filter(F.col("entity_type") == entity_type)
    hours_ago = (F.unix_micros(as_of) - F.unix_micros("time_bucket")) / F.lit(3_600_000_000.0)
    return (
        rows.groupBy("entity", "entity_type")
        .agg(
            F.sum("article_count").alias("total_mentions"),
            F.sum(F.col("article_count") * F.exp(-DECAY_PER_HOUR * hours_ago)).alias("trend_score"))
        .orderBy(F.col("trend_score").desc(), "entity", "entity_type")
        .limit(limit))


def sentiment_window(daily: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Daily rows of the last `days` days, oldest first, the day as text."""
    start = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        on_dates(daily, start, partition="bucket_date").filter(F.col("date_bucket") >= start)
        .orderBy("date_bucket", "sentiment_label")
        .select(
            F.date_format("date_bucket", "yyyy-MM-dd").alias("date_bucket"),
            "sentiment_label", "article_count"))
