"""Duplicate detection inside a batch and against the stored articles.

Keys are narrow (url, hash, arrival number) and counted before they are shuffled, so a key that
holds a large part of a batch reaches the network as one row per input partition. Wide rows are
joined once, by their unique arrival number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def first_wins(rows: DataFrame, keys: Sequence[str], order_by: str = "seq") -> DataFrame:
    """First row per key in arrival order.

    Spark plans a rank filter of 1 as a limit inside every input partition before the shuffle, so
    repeats of a hot key are dropped where they are read.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def first_by_number(rows: DataFrame, keys: Sequence[Column | str], order_by: str = "seq") -> DataFrame:
    """As `first_wins` where `order_by` is unique: decided on the keys and that number alone, so wide
    rows are neither sorted nor shuffled by a key that may be hot."""
    narrow = rows.select(*[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)], order_by)
    winners = narrow.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min(order_by).alias(order_by))
    return rows.join(winners.select(order_by), order_by, "left_semi").select(*rows.columns)


def _held(stored, column: str, wanted: DataFrame) -> DataFrame:
    """Those of the distinct keys `wanted` that are stored: by a key index, or from the stored rows themselves."""
    if hasattr(stored, "held"):
        return stored.held(column, wanted)
    return stored.select(column).distinct().join(wanted, column, "left_semi")


def existing_candidates(stored, batch: DataFrame) -> DataFrame:
    """Stored (url, content_hash) pairs that share a url or a hash with the batch.

    Two equi-joins; one join on `url OR hash` would compare every pair of rows. `stored` is a
    DataFrame or a `KeyIndex`, of which only the buckets of the batch are read.
    """
    if hasattr(stored, "matching"):
        found = [stored.matching(c, written(batch.select(c).distinct(), "wanted")).select("url", "content_hash")
                 for c in ("url", "content_hash")]
        return written(found[0].unionByName(found[1]), "candidates").distinct()
    # Stored pairs are made distinct before they are shuffled. The batch's keys are written, so that
    # a hash that many stored urls share can be split: that does not happen beside an aggregate.
    keys = stored.select("url", "content_hash").distinct()
    wanted = {c: written(batch.select(c).distinct(), "wanted") for c in ("url", "content_hash")}
    by_url = keys.join(wanted["url"], "url", "left_semi")
    by_hash = keys.join(wanted["content_hash"], "content_hash", "left_semi")
    # Written before it is made distinct: an aggregate would hold the join to its partitioning.
    return written(by_url.unionByName(by_hash.select("url", "content_hash")), "candidates").distinct()


def dedup_against_store(batch: DataFrame, stored) -> DataFrame:
    """Adds `is_duplicate`, `dup_method` and `matched_url`; a url match beats a hash match. `stored` is a
    DataFrame of urls and hashes or a `KeyIndex`.

    The hits are written first. Their exact size then decides about a broadcast, and a join over
    files can split a hot key, which adaptive execution does not do right behind an aggregate.
    """
    pairs = batch.select("url", "content_hash").distinct()
    hits = written(_store_hits(pairs, stored), "hits")
    labelled = batch.join(hits, ["url", "content_hash"], "left")
    return labelled.withColumns({
        "is_duplicate": F.col("dup_method").isNotNull(),
        "matched_url": F.when(F.col("dup_method") == "exact_url", F.col("url")),
    })


def _store_hits(pairs: DataFrame, stored) -> DataFrame:
    """Distinct batch pairs known to the store, with the way they matched.

    Both sides of the first join have one row per key and input partition; the keys found are written,
    so that the second join can split a hash that many pairs of the batch share.
    """
    pairs = written(pairs, "pairs")

    def known(column: str) -> DataFrame:
        wanted = pairs.select(column).distinct()
        held = written(_held(stored, column, wanted), "held")
        return pairs.join(held, column, "left_semi").select("url", "content_hash")

    # Numbers, so that max() is the precedence and stays a hash aggregate.
    hits = written(known("url").withColumn("_how", F.lit(2)).unionByName(
        known("content_hash").withColumn("_how", F.lit(1))), "matches")
    best = hits.groupBy("url", "content_hash").agg(F.max("_how").alias("_how"))
    return best.select(
        "url", "content_hash", F.when(F.col("_how") == 2, "exact_url").otherwise("exact_hash").alias("dup_method"))


def dedup_in_batch(batch: DataFrame, order_by: str = "seq") -> DataFrame:
    """Adds `batch_method`: null for the kept row, else `batch_url` or `batch_hash`.

    First per url, then first per hash among those. Both minima are partial aggregates; the
    joins that mark the winners use (key, arrival number), which no hot key can skew.
    """
    keys = batch.select("url", "content_hash", F.col(order_by).alias("_at"))
    url_first = keys.groupBy("url").agg(F.min_by("content_hash", "_at").alias("content_hash"), F.min("_at").alias("_at"))
    hash_first = url_first.groupBy("content_hash").agg(F.min("_at").alias("_at"))
    # 1: first of its url only, 2: first of its hash as well.
    marks = (
        url_first.select("_at", F.lit(1).alias("_mark"))
        .unionByName(hash_first.select("_at", F.lit(2).alias("_mark")))
        .groupBy("_at").agg(F.max("_mark").alias("_mark")))
    marked = batch.join(marks, F.col(order_by) == F.col("_at"), "left")
    method = F.when(F.col("_mark").isNull(), "batch_url").when(F.col("_mark") == 1, "batch_hash")
    return marked.withColumn("batch_method", method).drop("_at", "_mark")


def label_batch(batch: DataFrame, stored, order_by: str = "seq") -> DataFrame:
    """Store check first, in-batch check among the rows the store does not know.

    Adds `dup_method` (null for new rows) and `matched_url`. The checked keys are written once, so
    the store is read once per key column however often they are used after that.
    """
    keys = [order_by, "url", "content_hash"]
    checked = written(dedup_against_store(batch.select(*keys), stored), "checked")
    known = checked.filter("is_duplicate").select(*keys, "dup_method", "matched_url")
    fresh = dedup_in_batch(checked.filter("not is_duplicate").select(*keys), order_by)
    labels = known.unionByName(fresh.select(
        *keys, F.col("batch_method").alias("dup_method"), F.lit(None).cast("string").alias("matched_url")))
    others = [c for c in batch.columns if c not in keys]
    return batch.select(order_by, *others).join(labels, order_by) if others else labels


def insert_if_absent(incoming: DataFrame, stored, key: str = "url", order_by: str = "seq") -> DataFrame:
    """Rows to insert: key not stored, first per key inside the batch. `stored` is a DataFrame or a `KeyIndex`."""
    fresh = first_by_number(incoming, [key], order_by)
    known = stored.select(key) if isinstance(stored, DataFrame) else written(
        _held(stored, key, incoming.select(key).distinct()), "held")
    return fresh.join(known, key, "left_anti").select(*incoming.columns)
