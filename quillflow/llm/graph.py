"""Connected components by alternating star contraction on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 60
PART_ROWS = 200_000  # rows of a written part, at least: a small graph is not cut into hundreds of files in every round


def _tidy(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, each once."""
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _kept(rows: DataFrame, label: str, most: int) -> DataFrame:
    """`rows`, of which there are `most` at most, written in parts of a useful size."""
    return written(rows.coalesce(max(1, -(-most // PART_ROWS))), label)


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the undirected edges (a, b) the smallest node that it reaches.

    Each round every node hands its larger neighbours to the smallest node it knows, then does the
    same with its smaller ones; both only group and join narrow rows. The smallest neighbours are written
    before they are joined, so that adaptive execution can split a much linked node. Rounds grow with
    the logarithm of a component's size. Every round is written, which cuts the lineage.
    """
    edges = written(_tidy(edges), "edges")
    state = _state(edges)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _kept(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")), "least", 2 * state[0])
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _kept(_tidy(large), "edges", 2 * state[0])
        least = _kept(large.groupBy("a").agg(F.min("b").alias("m")), "least", 2 * state[0])
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = _kept(_tidy(small), "edges", 4 * state[0])
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
