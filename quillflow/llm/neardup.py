"""Near duplicates by banded MinHash, odd sketches and exact confirmation.

1. Equal shingle sets are one class; the rest works on one representative of each class.
2. MinHash bands bring candidates together: every member of a bucket is tied to the bucket's
   smallest member. The connected pieces of these ties ("pools") hold every candidate pair.
3. Inside a pool documents are compared side by side. Odd sketches (the parity of MinHash samples
   over a bitmap) discard pairs by the population count of their XOR; the others are confirmed on
   the full sets. Only a spanning set of links is given out, at most one per document.
4. Pools larger than a block are cut into blocks, by set size first: sets of similar documents
   differ in size by a third at most, so only equal and neighbouring size classes meet.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes, written
from .graph import components
from .shingles import batch_shingles, distinct, mixed

BANDS, ROWS = 48, 5  # misses a pair of similarity 0.75 with a chance of 2e-6
SKETCH_BITS = 512
# At similarity 0.75 the estimate falls below this about twice in 10^12 pairs: far less than the bands miss.
LEAST_ESTIMATE = 0.42
COMMON, TOTAL = 75, 100  # TOTAL * intersection >= COMMON * union
BLOCK, BLOCK_SHINGLES = 256, 400_000  # documents of a block, and shingles of all of them, about
BATCH_BYTES = 1 << 20
DENSE_CELLS = 6_000_000

_K = BANDS * ROWS
_RNG = np.random.default_rng(20)
_LOW = _RNG.integers(0, 1 << 32, _K, dtype=np.uint32) | np.uint32(1)
_HIGH = _RNG.integers(0, 1 << 32, _K, dtype=np.uint32) | np.uint32(1)
_SALT = _RNG.integers(0, 1 << 63, _K, dtype=np.uint64)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes."""
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(_K, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(hashes), 256):
        part = low[start:start + 256, None] * _LOW
        part += high[start:start + 256, None] * _HIGH
        np.minimum(best, part.min(0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(documents, BANDS) 64-bit bucket keys; different bands never share a bucket but by chance."""
    salted = mixed(samples.astype(np.uint64) + _SALT)
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mixed(keys + salted[:, row::ROWS])
    return keys.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_BITS / 8) bytes: parity of the number of samples that fall on each bit."""
    place = (mixed(samples.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SALT)
             % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = place + np.arange(len(samples))[:, None] * SKETCH_BITS
    counts = np.bincount(flat.reshape(-1), minlength=len(samples) * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(samples), SKETCH_BITS), axis=1)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of every sketch of `a` with every one of `b`, from the bits in which they differ."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    odd = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        odd += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    share = np.minimum(2 * odd / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * _K) * np.log(1 - share)


def _batch_sets(column: pa.Array):
    hashes, before = distinct(*batch_shingles(*text_bytes(column)))
    return hashes, before


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def text_key() -> Column:
    return F.xxhash64("text")


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text as it is), n_shingles, set_key (digest of the whole set; null without words), bands."""
    schema = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"

    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            hashes, before = _batch_sets(batch.column("text"))
            sets = [hashes[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = [_set_key(s) if len(s) else None for s in sets]
            bands: list = [None] * len(sets)
            if full:
                samples = np.stack([minhash(sets[i]) for i in full])
                for i, line in zip(full, band_keys(samples)):
                    bands[i] = line
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(before), pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return documents.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, schema)


def full_sets(documents: DataFrame) -> DataFrame:
    """set_key, shingles (sorted 64-bit hashes), sketch of the texts that have words."""

    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            hashes, before = _batch_sets(batch.column("text"))
            sets = [hashes[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist()) if b > a]
            if not sets:
                continue
            sketches = odd_sketches(np.stack([minhash(s) for s in sets]))
            yield pa.record_batch(
                [pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sketches], pa.binary())], ["set_key", "shingles", "sketch"])

    return documents.select("text").mapInArrow(run, "set_key binary, shingles binary, sketch binary")


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return TOTAL * common >= COMMON * (a + b - common)


def _links(doc_ids: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Spanning links among the similar pairs of one document of `left` and one of `right` (places; if they
    are the same places, all pairs of them)."""
    size = np.array([len(s) for s in sets])
    close = estimates(sketches[left], sketches[right]) >= LEAST_ESTIMATE
    close &= left[:, None] != right[None, :]
    if left is right:
        close = np.triu(close)
    x, y = np.nonzero(close)
    if not len(x):
        return []
    x, y = left[x], right[y]
    used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    flat = np.concatenate([sets[i] for i in used])
    words, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    if len(shared) * len(used) <= DENSE_CELLS:  # all intersections as one product
        column = np.full(len(words), -1)
        column[shared] = np.arange(len(shared))
        cell = column[code]
        row = np.repeat(np.arange(len(used)), size[used])[cell >= 0]
        dense = np.zeros((len(used), len(shared)), np.float32)
        dense[row, cell[cell >= 0]] = 1
        product = dense @ dense.T
        common = product[place[:len(x)], place[len(x):]].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)])
    good = similar(common, size[x], size[y])
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(x[good].tolist(), y[good].tolist()):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((int(doc_ids[i]), int(doc_ids[j])))
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Links inside one meeting of a pool: side 0 with side 1, or, where there is but side 0, inside it."""
    rows = dict.fromkeys(zip(table.column("node").to_pylist(), table.column("shingles").to_pylist()))
    if len(rows) < table.num_rows:  # repeated rows
        place = {}
        for i, key in enumerate(zip(table.column("node").to_pylist(), table.column("shingles").to_pylist())):
            place.setdefault(key, i)
        table = table.take(pa.array(list(place.values())))
    sets = [np.frombuffer(s, np.uint64) for _, s in rows]
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8)
    side = table.column("side").to_numpy()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links = _links(table.column("node").to_numpy(), sets, np.ascontiguousarray(sketches), one, two if len(two) else one)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def meetings(pools: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pool, meeting, side, node) of (pool, node, n): who is compared with whom.

    A pool of up to two blocks is one meeting. A larger one is cut by size class and hash into blocks of
    about `block` documents that have about BLOCK_SHINGLES together; each block meets itself and every other block of
    its class (and of the next class).
    """
    weight = F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)
    total = written(pools.groupBy("pool").agg(weight.alias("n_blocks")), "pool-sizes")
    step = F.lit(math.log(TOTAL / COMMON) * (1 + 1e-9))  # so that rounding never puts partners two classes apart
    sized = pools.join(total, "pool").withColumn(
        "class", F.when(F.col("n_blocks") > 2, F.floor(F.log(F.col("n")) / step)).otherwise(0).cast("int"))
    small = sized.where("n_blocks <= 2").select(
        "pool", F.lit("").alias("meeting"), F.lit(0).alias("side"), "node")
    large = written(sized.where("n_blocks > 2"), "large-pools")
    count = large.groupBy("pool", "class").agg(F.ceil(weight).cast("int").alias("blocks"))
    around = count.select("pool", "class", "blocks", F.lit(None).cast("int").alias("up"), F.lit(None).cast("int").alias("down"))
    for shift, name in ((1, "up"), (-1, "down")):
        beside = count.select("pool", (F.col("class") - shift).alias("class"), F.col("blocks").alias("other"))
        around = around.join(beside, ["pool", "class"], "left").withColumn(name, F.coalesce("other", F.lit(0))).drop("other")
    placed = large.join(written(around, "blocks"), ["pool", "class"]).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def run(n):  # 0 .. n-1
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def meet(first_class, a, second_class, b, side):
        return F.struct(F.concat_ws(":", first_class.cast("string"), a.cast("string"), second_class.cast("string"),
                                    b.cast("string")).alias("meeting"), side.cast("int").alias("side"))

    here, own = F.col("class"), F.col("own")
    inside = F.transform(run(F.col("blocks")), lambda j: meet(
        here, F.least(own, j), here, F.greatest(own, j), own > j))
    upward = F.transform(run(F.col("up")), lambda j: meet(here, own, here + 1, j, F.lit(0)))
    downward = F.transform(run(F.col("down")), lambda j: meet(here - 1, j, here, own, F.lit(1)))
    many = placed.select("pool", "node", F.explode(F.concat(inside, upward, downward)).alias("m")).select(
        "pool", "m.meeting", "m.side", "node")
    return small.unionByName(many)


def verdicts(documents: DataFrame) -> DataFrame:
    """The columns of `near_duplicates`, and text_key, set_key and component (a number of its own), for every row.

    The unit is the class of rows with one shingle set, so two texts under one doc_id go their own ways. Classes are
    numbered in order of their smallest doc_id: a component's smallest number names its smallest doc_id.
    """
    signed = written(signatures(documents), "signatures")
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"))
    classes = written(classes.orderBy("doc_id", "set_key").withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = signed.join(classes, ["set_key", "doc_id"])
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    # Aggregates are written before they are joined: beside them a hot key of the join could not be split.
    hubs = written(banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where(
        "hub < last").select("bucket", "hub"), "hubs")
    ties = banded.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pools = written(components(ties).select("node", F.col("component").alias("pool")), "pools")

    members = written(nodes.select("node", "doc_id", "set_key", F.col("n_shingles").alias("n")).distinct().join(
        pools, "node").select("pool", "node", "n", "doc_id", "set_key"), "members")
    texts = documents.select("doc_id", "text").join(members.select("doc_id"), "doc_id", "left_semi")
    keys = members.select("node", "set_key")
    met = meetings(members.select("pool", "node", "n")).join(keys, "node").join(full_sets(texts), "set_key")
    links = met.groupBy("pool", "meeting").applyInArrow(_compare, "a long, b long")
    linked = components(links)

    firsts = classes.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    labels = written(classes.select("set_key", "node").join(linked, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component")).join(firsts, "component"), "labels")
    done = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(labels, "set_key", "left")
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return done.withColumn("component_id", named).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; shingles are five words. Null, empty and
    wordless texts have no shingles and are linked with nothing. Links go by text: rows of one doc_id with
    different texts may be in different components, each named after its smallest doc_id. A null doc_id can't
    be named in a link: such rows have a null component and are kept. `kept`: doc_id is the smallest of its component.
    """
    return verdicts(documents).select("doc_id", "n_shingles", "component_id", "kept")
