"""Canonical articles, the quality gate and failure routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_published
from ..functions.text import SPACE, clean_author, clean_title, content_hash, html_to_text
from ..functions.urls import strip_fragment
from ..lexicons import AUTHOR_LIMIT, MAX_ARTICLE_AGE_HOURS, TITLE_LIMIT
from .dedup import first_by_number

CRITICAL = ("TITLE_TOO_SHORT", "URL_INVALID", "TIMESTAMP_TOO_OLD", "TITLE_TOO_LONG", "AUTHOR_TOO_LONG")


def age_hours(published_at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(published_at)) / F.lit(3_600_000_000.0)


def is_fresh(published_at: Column, as_of: Column, max_hours: float = MAX_ARTICLE_AGE_HOURS) -> Column:
    """Undated articles count as fresh."""
    return published_at.isNull() | (age_hours(published_at, as_of) <= max_hours)


def freshness_filter(articles: DataFrame, as_of: Column, max_hours: float = MAX_ARTICLE_AGE_HOURS) -> DataFrame:
    return articles.filter(is_fresh(F.col("published_at"), as_of, max_hours))


def is_complete() -> Column:
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return present("title") & present("url") & F.col("published_at").isNotNull()


def normalize(raw: DataFrame, as_of: Column) -> DataFrame:
    """Canonical columns for every raw row, plus `dropped` where the row cannot be used."""
    clean = raw.withColumns({
        "title": clean_title(F.col("title")),
        "url": strip_fragment(F.col("url")),
        "summary": F.when(F.col("summary") != "", html_to_text(F.col("summary"))),
        "content": F.when(F.col("content") != "", html_to_text(F.col("content"))),
        "author": clean_author(F.col("author")),
        "published_at": parse_published(F.col("published_at_raw"), F.col("timezone_hint")),
    })
    unusable = F.col("title").isNull() | F.coalesce(F.col("url") == "", F.lit(True))
    return clean.withColumns({
        "content_hash": content_hash(F.col("title"), F.col("summary")),
        "collected_at": as_of,
        "dropped": unusable | ~is_fresh(F.col("published_at"), as_of),
    })


def violations(as_of: Column, max_hours: float = MAX_ARTICLE_AGE_HOURS) -> Column:
    """Names of the rules an article breaks, in rule order."""
    title, author = F.length("title"), F.length("author")
    age = age_hours(F.col("published_at"), as_of)
    blank = F.regexp_replace(F.coalesce(F.col("summary"), F.lit("")), f"[{SPACE}]+", "") == ""
    return F.array_compact(F.array(
        F.when(F.coalesce(title, F.lit(0)) < 5, "TITLE_TOO_SHORT").when(title > TITLE_LIMIT, "TITLE_TOO_LONG"),
        F.when(blank, "SUMMARY_EMPTY"),
        F.when(~F.coalesce(F.col("url").startswith("http"), F.lit(False)), "URL_INVALID"),
        F.when(age > max_hours, "TIMESTAMP_TOO_OLD").when(age < -1, "TIMESTAMP_IN_FUTURE"),
        F.when(author > AUTHOR_LIMIT, "AUTHOR_TOO_LONG"),
    ))


def quality_gate(articles: DataFrame, as_of: Column) -> DataFrame:
    """Adds `violations`, `quality_score` and `is_valid`."""
    broken = lambda rule: F.array_contains("violations", rule)
    penalty = lambda rule, cost: F.when(broken(rule), F.lit(cost)).otherwise(F.lit(0.0))
    score = F.lit(1.0) - penalty("SUMMARY_EMPTY", 0.3) - penalty("TITLE_TOO_SHORT", 0.5) - penalty(
        "TIMESTAMP_TOO_OLD", 1.0)
    critical = F.arrays_overlap("violations", F.array(*[F.lit(c) for c in CRITICAL]))
    return (
        articles.withColumn("violations", violations(as_of))
        .withColumn("quality_score", F.greatest(F.lit(0.0), score))
        .withColumn("is_valid", (F.col("quality_score") >= 0.5) & ~critical))


def stage_articles(raw: DataFrame, as_of: Column) -> DataFrame:
    """One pass over the raw rows: canonical columns and the `stage` each row reached.

    `stage` is PASSED, NORMALIZATION or VALIDATION; splitting it is two filters over one plan.
    """
    gated = quality_gate(normalize(raw, as_of), as_of)
    return gated.withColumn(
        "stage",
        F.when(F.col("dropped"), "NORMALIZATION")
        .when(F.col("is_valid"), "PASSED")
        .otherwise("VALIDATION"))


def passed(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("stage") == "PASSED")


def route_failures(staged: DataFrame, order_by: str = "seq") -> DataFrame:
    """Dead letters of a staged batch.

    Dropped rows that repeat a payload are written once, the first in `order_by`.
    """
    failed = staged.filter(F.col("stage") != "PASSED")
    text = F.concat(
        F.lit("Violations: "), F.array_join("violations", ", "),
        F.lit(" (Score: "), F.col("quality_score").cast("string"), F.lit(")"))
    drop = F.col("stage") == "NORMALIZATION"
    letters = failed.select(
        order_by, "source_id",
        F.col("stage").alias("failure_stage"),
        F.when(drop, "Drop").otherwise("QualityGateRejected").alias("error_type"),
        F.when(drop, "Normalizer rejected article").otherwise(text).alias("error_message"),
        "raw_payload",
    )
    dropped = letters.filter(F.col("failure_stage") == "NORMALIZATION")
    kept = first_by_number(dropped, [F.sha2("raw_payload", 256)], order_by)
    return letters.filter(F.col("failure_stage") == "VALIDATION").unionByName(kept)
