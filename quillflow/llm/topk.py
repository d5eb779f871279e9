"""Exact top-k search by inner product, score at a time over an impact-ordered index.

The index holds the components of all vectors as postings, grouped by quantised impact (the size
of the component) from high to low; vectors are kept in blocks. A block of queries works through a
block of vectors segment by segment. After each segment every score is known up to the product of
what is left of the query and of the vector, by the inequality of Cauchy and Schwarz. When this proves
that few vectors can be members of a result, these possible members are rescored exactly on
integers; nothing is given up without proof.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partition_number, written

K = 5
SCALE = 256
VECTORS = 4096  # vectors in a block of the index
QUERIES = 512  # queries in a block
BLOCK_WIDTH = 64  # components at which a block is full; of longer vectors it has fewer
# Lower ends of the impact segments as shares of a block's largest impact, from high to low.
SEGMENTS = (0.5, 0.35, 0.25, 0.15, 0.08, 0.0)
FEW = 64  # possible members of a query, on average, below which exact scoring takes over


def usable(vector: Column) -> Column:
    """The vector is no null and holds neither nulls nor NaN nor infinities."""
    wide = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(wide(x)) | (F.abs(wide(x)) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(256 * x) of every component, of the usable vectors."""
    return rows.where(usable(F.col(vector)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _blocks(vectors: DataFrame, most: int, index: bool) -> DataFrame:
    """Rows of up to `most` vectors of one task. An index block holds, per impact segment, the postings
    (dimension, vector, impact) of its vectors; both kinds hold the ids and the integer vectors."""
    schema = "task int, block int, width int, ids binary, rows binary, postings array<binary>"

    def block(task, number, ids, rows):
        width = max(map(len, rows))
        dense = np.zeros((len(rows), width), np.int64)
        for line, row in zip(dense, rows):
            line[:len(row)] = row
        postings = []
        if index:
            size = np.abs(dense)
            high, top = None, int(size.max()) if size.size else 0
            for share in SEGMENTS:
                low = int(np.ceil(share * top)) if share else 1  # zeros have no posting
                inside = (size >= max(low, 1)) & (size < high if high is not None else True)
                vector, dim = np.nonzero(inside)
                order = np.argsort(dim, kind="stable")
                postings.append(np.stack([dim[order], vector[order], dense[vector, dim][order]]).astype("<i8").tobytes())
                high = max(low, 1)
        return pa.record_batch(
            [pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([width], pa.int32()),
             pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
             pa.array([dense.astype("<i8").tobytes()], pa.binary()), pa.array([postings], pa.list_(pa.binary()))],
            ["task", "block", "width", "ids", "rows", "postings"])

    def run(batches):
        task, number, ids, rows = partition_number(), 0, [], []
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                ids.append(i)
                rows.append(v)
                if len(ids) == most or len(ids) * len(v) >= most * BLOCK_WIDTH:
                    yield block(task, number, ids, rows)
                    number, ids, rows = number + 1, [], []
        if ids:
            yield block(task, number, ids, rows)

    return vectors.select("id", "v").mapInArrow(run, schema)


def _search(query_ids, queries, ids, vectors, postings, k: int):
    """Top k of one block for every query: (query place, vector place, exact score) arrays."""
    width = max(queries.shape[1], vectors.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    q = queries.astype(np.float64)
    known = np.zeros((len(q), len(vectors)))
    left = (vectors.astype(np.float64)**2).sum(1)  # squared length of what has not been added yet
    own = query_ids[:, None] == ids[None, :]
    length = np.sqrt((q * q).sum(1))[:, None]
    take = min(k + int(own.sum(1).max(initial=0)), len(vectors))
    possible = ~own
    for raw in postings:
        dim, vector, impact = np.frombuffer(raw, "<i8").reshape(3, -1)
        slab = np.zeros((width, len(vectors)))
        slab[dim, vector] = impact
        known += q @ slab
        left -= (slab * slab).sum(0)
        spread = length * np.sqrt(np.maximum(left, 0))[None, :] * (1 + 1e-9) + 1e-6
        least = np.where(own, -np.inf, known - spread)
        bound = -np.partition(-least, take - 1, axis=1)[:, take - 1] if take else np.zeros(len(q))
        # Only what may still reach the k-th proven score can be a member.
        possible = ~own & (known + spread >= bound[:, None])
        if possible.sum() <= FEW * len(q):
            break
    # Exact scores of the possible members; what double precision can't hold is an overflow of long as well.
    at, place = np.nonzero(possible)
    score = np.empty(len(at), np.int64)
    for start in range(0, len(at), 100_000):
        part = slice(start, start + 100_000)
        score[part] = np.einsum("ij,ij->i", queries[at[part]], vectors[place[part]])
    order = np.lexsort((ids[place], -score, at))
    at, place, score = at[order], place[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], place[rank < k], score[rank < k]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of highest integer inner product for every query.

    Both are (id, v) with arrays of integers; shorter vectors count as padded with zeros. A vector of the
    query's own id is no candidate; equal scores go by smaller id. Repeated rows of an id are
    vectors of their own. No vectors or no queries give no rows.
    """
    index = written(_blocks(vectors, VECTORS, True), "index")
    asked = written(_blocks(queries, QUERIES, False).drop("postings"), "queries")
    # One number per block of queries; `_blocks` makes few blocks, and only their counts per task come here.
    counts = asked.groupBy("task").agg(F.count("*").alias("n")).orderBy("task").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["task"], total))
        total += row["n"]
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = F.broadcast(spark.createDataFrame(starts, "task int, first int"))  # a row per task
    asked = asked.join(first, "task").select(
        (F.col("first") + F.col("block")).alias("turn"), F.col("width").alias("q_width"),
        F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    pairs = index.select(
        "width", "ids", "rows", "postings", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("turn")).join(asked, "turn")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                at, place, score = _search(
                    query_ids, np.frombuffer(row["q_rows"], "<i8").reshape(len(query_ids), row["q_width"]),
                    ids, np.frombuffer(row["rows"], "<i8").reshape(len(ids), row["width"]), row["postings"], k)
                yield pa.record_batch(
                    [pa.array(query_ids[at]), pa.array(ids[place]), pa.array(score)], ["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digests(embeddings: DataFrame) -> DataFrame:
    vectors = integer_vectors(embeddings)
    return top_k(vectors.where(F.col("id") % 50 == 0), vectors)
