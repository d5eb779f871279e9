"""Article reads: projections, filters, pages and export order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_COLUMNS = [
    "id", "title", "url", "author", "source_name", "image_url", "published_at", "category", "sentiment",
]
DETAIL_COLUMNS = LIST_COLUMNS + ["summary", "body", "content_hash", "quality_score", "feed_source_id"]
EXPORT_COLUMNS = ["id", "title", "source_name", "published_at", "author", "summary", "url"]


def list_projection(articles: DataFrame, include_summary: bool = False) -> DataFrame:
    return articles.select(*LIST_COLUMNS, *(["summary"] if include_summary else []))


def detail_lookup(articles: DataFrame, article_id) -> DataFrame:
    return articles.filter(F.col("id") == article_id).select(*DETAIL_COLUMNS)


@dataclass
class ArticleFilters:
    """Optional filters, checked when made; all that are set must hold."""

    source_names: Sequence[str] = field(default_factory=tuple)
    published_after: datetime | None = None
    published_before: datetime | None = None
    keywords: str | None = None
    search: str | None = None
    sentiment: str | None = None
    entity: str | None = None
    sector: str | None = None
    extracted_keyword: str | None = None

    def __post_init__(self) -> None:
        if self.published_after and self.published_before and self.published_after > self.published_before:
            raise ValueError("published_after lies behind published_before")
        if self.search is not None:
            self.search = self.search.strip()
            if len(self.search) < 3:
                raise ValueError("a search needs at least 3 characters")
        self.keywords = (self.keywords or "").strip() or None


def on_dates(rows: DataFrame, low: Column | None = None, high: Column | None = None, undated: bool = False,
             partition: str = "published_date") -> DataFrame:
    """Only partitions of dates in low..high (days), and the undated one if wanted.

    The filter on the partition column repeats what the caller asks of the time itself, so that files
    of other dates are not read. Tables without that column are left alone.
    """
    if partition not in rows.columns or (low is None and high is None):
        return rows
    date = F.col(partition)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (date >= F.to_date(low))
    if high is not None:
        inside = inside & (date <= F.to_date(high))
    return rows.filter(inside | date.isNull() if undated else inside)


def title_contains(text: str) -> Column:
    """Case-blind substring test; `%` and `_` in the text stand for themselves."""
    return F.contains(F.lower("title"), F.lower(F.lit(text)))


def list_filters(articles: DataFrame, filters: ArticleFilters) -> DataFrame:
    """Row predicates on the article itself; all of them can reach the Parquet scan."""
    if filters.source_names:
        articles = articles.filter(F.col("source_name").isin(list(filters.source_names)))
    articles = on_dates(
        articles, F.lit(filters.published_after).cast("timestamp") if filters.published_after else None,
        F.lit(filters.published_before).cast("timestamp") if filters.published_before else None)
    if filters.published_after:
        articles = articles.filter(F.col("published_at") >= F.lit(filters.published_after))
    if filters.published_before:
        articles = articles.filter(F.col("published_at") <= F.lit(filters.published_before))
    if filters.keywords:
        articles = articles.filter(title_contains(filters.keywords))
    if filters.sentiment:
        articles = articles.filter(F.lower("sentiment_label") == filters.sentiment.lower())
    return articles


def _having(articles: DataFrame, children: DataFrame, column: str, value: str) -> DataFrame:
    wanted = children.filter(F.col(column) == value).select(F.col("article_id").alias("id"))
    return articles.join(wanted, "id", "left_semi")


def filter_by_entity(articles: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    return _having(articles, entities, "entity", entity)


def filter_by_sector(articles: DataFrame, sectors: DataFrame, sector: str) -> DataFrame:
    return _having(articles, sectors, "sector", sector)


def filter_by_keyword(articles: DataFrame, keywords: DataFrame, keyword: str) -> DataFrame:
    return _having(articles, keywords, "keyword", keyword)


def select_articles(
    articles: DataFrame,
    filters: ArticleFilters,
    entities: DataFrame | None = None,
    sectors: DataFrame | None = None,
    keywords: DataFrame | None = None,
    postings: DataFrame | None = None,
    stem=None,
) -> DataFrame:
    """Every filter at once, full text included.

    With `postings` a search goes through the index, else through a predicate over the texts.
    """
    from .search import search_ids, text_match

    rows = list_filters(articles, filters)
    if filters.search and postings is not None:
        rows = rows.join(search_ids(postings, filters.search, stem), "id", "left_semi")
    elif filters.search:
        rows = rows.filter(text_match(filters.search, F.concat_ws(" ", "title", "summary", "body"), stem=stem))
    for value, children, having in (
        (filters.entity, entities, filter_by_entity),
        (filters.sector, sectors, filter_by_sector),
        (filters.extracted_keyword, keywords, filter_by_keyword),
    ):
        if value:
            if children is None:
                raise ValueError("this filter needs its child table")
            rows = having(rows, children, value)
    return rows


def count_filtered(articles: DataFrame, filters: ArticleFilters, **more) -> DataFrame:
    return select_articles(articles, filters, **more).agg(F.count("*").alias("matching"))


def page_order() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("id").desc()]


def after_cursor(published_at: datetime | None, last_id, time_column: str = "published_at") -> Column:
    """Rows behind a page's last row in (time DESC NULLS LAST, id DESC)."""
    time = F.col(time_column)
    if published_at is None:
        return time.isNull() & (F.col("id") < last_id)
    at = F.lit(published_at)
    return (time < at) | ((time == at) & (F.col("id") < last_id)) | time.isNull()


def latest_page(articles: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """Next page, newest first, undated last. One row beyond `limit` tells that more follow."""
    if cursor is not None:
        if cursor[0] is not None:
            articles = on_dates(articles, high=F.lit(cursor[0]).cast("timestamp"), undated=True)
        elif "published_date" in articles.columns:
            articles = articles.filter(F.col("published_date").isNull())
        articles = articles.filter(after_cursor(*cursor))
    return articles.orderBy(*page_order()).limit(limit + 1)


def search_page(ranked: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """Next page of ranked hits; the cursor is (rank, published_at, id)."""
    rows = ranked
    if cursor is not None:
        rank, published_at, last_id = cursor
        rows = ranked.filter(
            (F.col("rank") < rank) | ((F.col("rank") == rank) & after_cursor(published_at, last_id)))
    return rows.orderBy(F.col("rank").desc(), *page_order()).limit(limit + 1)


def export_rows(articles: DataFrame) -> DataFrame:
    """Export columns as text: nulls empty, times ISO-8601 in UTC."""
    micros = F.pmod(F.unix_micros("published_at"), F.lit(1_000_000))
    iso = F.when(micros == 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    text = {c: F.col(c).cast("string") for c in EXPORT_COLUMNS}
    text["published_at"] = F.concat(iso, F.lit("+00:00"))
    return articles.select(*[F.coalesce(text[c], F.lit("")).alias(c) for c in EXPORT_COLUMNS])


def export_scan(articles: DataFrame) -> DataFrame:
    """The whole result in page order: one distributed sort, split by (time, id) ranges."""
    return articles.orderBy(*page_order())
