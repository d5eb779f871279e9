"""Changes to stored tables, each as a new DataFrame built from the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .dedup import insert_if_absent


def upsert_by_key(stored: DataFrame, incoming: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """Insert new keys; for known keys overwrite only the `update` columns.

    `incoming` must hold a key once, as a multi-row upsert demands.
    """
    new = incoming.select(F.struct(*incoming.columns).alias("n"), F.col(key).alias("_k"))
    both = stored.alias("s").join(new, F.col(f"s.{key}") == F.col("_k"), "full_outer")
    absent_old, absent_new = F.col(f"s.{key}").isNull(), F.col("_k").isNull()

    def merged(name: str) -> Column:
        old = F.col(f"s.{name}")
        if name not in incoming.columns:
            return old
        fresh = F.col(f"n.{name}")
        if name in update:
            return F.when(absent_new, old).otherwise(fresh).alias(name)
        return F.when(absent_old, fresh).otherwise(old).alias(name)

    return both.select(*[merged(c) for c in stored.columns])


def seed_if_absent(stored: DataFrame, incoming: DataFrame, key: str = "url", order_by: str = "seq") -> DataFrame:
    """Stored rows plus the incoming rows whose key is not there yet."""
    fresh = insert_if_absent(incoming, stored, key, order_by)
    return stored.unionByName(fresh.select(*stored.columns), allowMissingColumns=True)


def conditional_update(rows: DataFrame, condition: Column, **changes: Column) -> DataFrame:
    """Set columns where `condition` holds."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def backfill_from_join(
    articles: DataFrame, sources: DataFrame, column: str = "source_name",
    foreign_key: str = "feed_source_id", source_column: str = "name",
) -> DataFrame:
    """Fill null or empty `column` from the article's source; other rows keep theirs."""
    names = sources.select(F.col("id").alias(foreign_key), F.col(source_column).alias("_fill"))
    filled = F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("_fill"), F.col(column))
    return articles.join(names, foreign_key, "left").withColumn(column, filled).select(*articles.columns)


def cascade_delete(
    parents: DataFrame, doomed: DataFrame, articles: DataFrame, children: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """Remove sources with their articles and the articles' child rows."""
    gone = articles.join(
        doomed.select(F.col("id").alias("feed_source_id")), "feed_source_id", "left_semi")
    kept = {
        "sources": parents.join(doomed.select("id"), "id", "left_anti"),
        "articles": articles.join(
            doomed.select(F.col("id").alias("feed_source_id")), "feed_source_id", "left_anti"),
    }
    lost = gone.select(F.col("id").alias("article_id"))
    for name, rows in children.items():
        kept[name] = rows.join(lost, "article_id", "left_anti")
    return kept


# Child tables of an article: array column, key columns after the article id, width limits.
CHILDREN = {
    "entities": (["entity", "entity_type"], {"entity": 255, "entity_type": 50}),
    "sectors": (["sector"], {"sector": 100}),
    "keywords": (["keyword"], {"keyword": 100}),
}


def child_rows(
    enriched: DataFrame, kind: str, inserted: DataFrame | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Entity, sector or keyword rows of the inserted articles, each key once.

    An article's list is distinct in its row already, but two values may be equal once they are
    cut to the column width; that is settled inside the row, without a shuffle. `carry` names
    article columns to repeat on the child rows.
    """
    keys, limits = CHILDREN[kind]
    rows = enriched if inserted is None else enriched.join(inserted.select("id"), "id", "left_semi")
    field_names = [f.name for f in enriched.schema[kind].dataType.elementType]
    cut = lambda e, n: F.substring(e[n], 1, limits[n]) if n in limits else e[n]
    trimmed = F.transform(kind, lambda e: F.struct(*[cut(e, n).alias(n) for n in field_names]))
    key_of = lambda e: F.struct(*[e[k] for k in keys])

    def first_of_key(items):
        return bind(F.transform(items, key_of), lambda found: F.filter(
            items, lambda e, i: F.array_position(found, key_of(e)) == i + 1))

    # Outer, because an inner explode adds a size filter that would compute the list a second time.
    exploded = rows.select(
        F.col("id").alias("article_id"), *carry, F.explode_outer(bind(trimmed, first_of_key)).alias("c"))
    return exploded.filter(F.col("c").isNotNull()).select("article_id", "c.*", *carry)
