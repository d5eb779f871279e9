"""Token ids in entropy-coded blocks: a static range asymmetric numeral system.

Block format (little endian), one block per row of a Parquet table of blocks:

    magic 'QANS'  u8 version  u8 log2(steps between checkpoints)  u16 lanes
    u32 ids  u32 checkpoints  u32 words  u32 crc32 of the ids  u32 crc32 of all that follows
    per checkpoint: u32 words read before it, then `lanes` u64 states
    the words (u32) in the order in which decoding reads them

The ids of a block are dealt to the lanes in turn; every lane is a coder with a state in
[2^31, 2^63) that moves 32 bits at a time. All blocks share one table of frequencies, scaled to
2^20 and stored beside them, so that each block decodes alone, and inside it each checkpoint.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_starts, partition_number, scratch_dir, slices, text_bytes
from .pretokens import library_ids

END_ID = 2
SCALE_BITS = 20
LOWEST = 1 << 31
LANES = 512
CHECKPOINT_BITS = 7
BLOCK_IDS = 1 << 18
BATCH_BYTES = 6 << 20
MAGIC = b"QANS"
HEAD = struct.Struct("<4sBBHIIIII")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE_BITS; every id that occurs gets at least one."""
    total, scale = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * scale // total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    excess = int(freq.sum()) - scale
    if excess < 0:
        freq[order[0]] -= excess
    for number in order:  # take what the ones above added from the most frequent ids
        if excess <= 0:
            break
        take = min(excess, int(freq[number]) - max(1, int(freq[number]) // 2))
        freq[number] -= take
        excess -= take
    if excess > 0:
        raise ValueError("more distinct ids than the scale has room for")
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, checkpoint_bits: int = CHECKPOINT_BITS) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n))
        steps, every = -(-n // lanes), 1 << checkpoint_bits
        freq, start = self.freq[ids], self.start[ids]
        limit = freq << np.uint64(63 - SCALE_BITS)
        state = np.full(lanes, LOWEST, np.uint64)
        moved: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []  # step, states before decoding it
        low, wide, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE_BITS)
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x, f = state[:b - a], freq[a:b]
            # A frequency of 2^SCALE_BITS (a single symbol) never moves words: its limit is the whole range.
            full = (x >= limit[a:b]) & (f < np.uint64(1 << SCALE_BITS))
            moved.append((x[full] & low).astype(np.uint32))
            x = np.where(full, x >> wide, x)
            quotient, rest = np.divmod(x, f)
            state[:b - a] = (quotient << scale) + rest + start[a:b]
            if step % every == 0:
                marks.append((step, state.copy()))
        moved.reverse()
        marks.reverse()
        read = np.concatenate([[0], np.cumsum([len(w) for w in moved])]).astype(np.int64)
        words = np.concatenate(moved) if moved else np.zeros(0, np.uint32)
        body = b"".join(struct.pack("<I", int(read[step])) + s.astype("<u8").tobytes() for step, s in marks)
        body += words.astype("<u4").tobytes()
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        return HEAD.pack(MAGIC, 1, checkpoint_bits, lanes, n, len(marks), len(words), crc, zlib.crc32(body)) + body

    def decode(self, block: bytes) -> np.ndarray:
        """The ids of a block. All its checkpoints are decoded side by side."""
        magic, version, bits, lanes, n, marks, count, crc, body_crc = HEAD.unpack_from(block)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of token ids")
        if zlib.crc32(block[HEAD.size:]) != body_crc:
            raise ValueError("damaged block of token ids")
        one = 4 + 8 * lanes
        at = HEAD.size + marks * one
        words = np.frombuffer(block, "<u4", count, at)
        read = np.array([struct.unpack_from("<I", block, HEAD.size + k * one)[0] for k in range(marks)], np.int64)
        state = np.concatenate(
            [np.frombuffer(block, "<u8", lanes, HEAD.size + k * one + 4) for k in range(marks)] or [np.zeros(0, "<u8")]
        ).astype(np.uint64).reshape(marks, lanes)
        every = 1 << bits
        out = np.zeros((marks, every, lanes), np.uint32)
        mask, scale, wide = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
        left = n - (np.arange(marks) * every * lanes)[:, None] - np.arange(lanes)[None, :]
        words = np.append(words, np.uint32(0)).astype(np.uint64)
        for step in range(every):
            live = left > step * lanes
            if not live.any():
                break
            slot = state & mask
            symbol = self.symbol[slot]
            out[:, step] = symbol
            freq = self.freq[symbol]
            new = freq * (state >> scale) + slot - self.start[symbol]
            refill = live & (new < np.uint64(LOWEST))
            place = read[:, None] + np.cumsum(refill, 1) - 1
            new = np.where(refill, (new << wide) | words[np.where(refill, place, count)], new)
            read = read + refill.sum(1)
            state = np.where(live, new, state)
        ids = out.reshape(-1)[:n] if marks else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("decoded ids do not match their checksum")
        return ids


@lru_cache(4)
def _coder(freq: bytes) -> Coder:
    return Coder(np.frombuffer(freq, np.int64))


def _raw_blocks(documents: DataFrame, path: str, end_id: int, block_ids: int) -> DataFrame:
    """Runs of whole documents in id order: task, block, ids before it in the task, doc_ids, lengths, ids.
    The last row of a task has its counts of ids in place of a block."""
    schema = "task int, block int, task_start long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"
    names = ["task", "block", "task_start", "n_ids", "doc_ids", "lengths", "ids", "counts"]

    def run(batches):
        task, block, done = partition_number(), 0, 0
        counts = np.zeros(1 << 16, np.int64)
        doc_ids: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0

        def row(ids, counted=None):
            return pa.record_batch(
                [pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([done], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([ids], pa.binary()),
                 pa.array([counted], pa.binary())], names)

        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, before, *_ = library_ids(path).batch(*text_bytes(batch.column("text")))
            if len(ids) and int(ids.max()) >= len(counts):
                raise ValueError("ids of more than 16 bits")
            counts += np.bincount(ids, minlength=len(counts))
            counts[end_id] += batch.num_rows
            raw = ids.astype("<u4").tobytes()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                n = int(before[i + 1] - before[i]) + 1
                if size and size + n > block_ids:
                    yield row(_short(held))
                    block, done = block + 1, done + size
                    doc_ids, lengths, held, size = [], [], [], 0
                doc_ids.append(doc_id)
                lengths.append(n)
                held += [raw[4 * int(before[i]):4 * int(before[i + 1])], end]
                size += n
        if size:
            yield row(_short(held))
            doc_ids, lengths, held, size = [], [], [], 0
            yield row(None, counts.tobytes())

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _short(held: list[bytes]) -> bytes:
    return np.frombuffer(b"".join(held), "<u4").astype("<u2").tobytes()


def write(documents: DataFrame, path: str, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
          partitions: int | None = None) -> None:
    """Write the ids of all texts of (doc_id, text), each followed by `end_id`, in ascending doc_id order.

    `folder` gets `blocks` (block payloads with the doc_ids, lengths and global start of each) and
    `frequencies`. A null text is empty. Rows of equal doc_id all are written, next to each other;
    null doc_ids come first. A block holds whole documents; a longer one has a block of its own.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first())
    raw_path = scratch_dir(spark, "raw-blocks")
    _raw_blocks(ordered, path, end_id, block_ids).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.parquet(raw_path)

    def pairs(batches):
        for batch in batches:
            for counted in batch.column(0).to_pylist():
                n = np.frombuffer(counted, np.int64)
                ids = np.flatnonzero(n)
                yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(n[ids])], ["id", "n"])

    raw.where(F.col("counts").isNotNull()).select("counts").mapInArrow(pairs, "id int, n long").groupBy("id").agg(
        F.sum("n").alias("n")).coalesce(1).write.parquet(f"{folder}/frequencies")
    freq = frequencies(spark, folder)

    def pack(batches):
        for batch in batches:
            coder = _coder(freq)
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                payload = coder.encode(np.frombuffer(ids, "<u2").astype(np.uint32))
                yield pa.record_batch(
                    [*[batch.column(c).slice(i, 1) for c in ("block", "start", "n_ids", "doc_ids", "lengths")],
                     pa.array([payload], pa.binary())],
                    ["block", "start", "n_ids", "doc_ids", "lengths", "payload"])

    blocks = raw.where(F.col("counts").isNull())
    starts = part_starts(blocks.select("task", "n_ids"), "task", "n_ids")
    placed = blocks.join(F.broadcast(starts), "task").select(
        "block", (F.col("start") + F.col("task_start")).alias("start"), "n_ids", "doc_ids", "lengths", "ids")
    placed.mapInArrow(
        pack, "block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    ).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def frequencies(spark: SparkSession, folder: str) -> bytes:
    """The shared table: at most one row per id of the vocabulary."""
    counts = np.zeros(1 << 16, np.int64)
    for row in spark.read.parquet(f"{folder}/frequencies").collect():
        counts[row["id"]] = row["n"]
    return scaled(counts).tobytes()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a folder written by `write`, ids as unsigned
    32-bit little-endian integers. Damaged blocks raise."""
    return _documents(spark, folder, with_ids=True)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Like `read`, with the crc32 of the ids in their place."""
    return _documents(spark, folder, with_ids=False)


def _documents(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    freq = frequencies(spark, folder)

    def run(batches):
        for batch in batches:
            coder = _coder(freq)
            for start, doc_ids, lengths, payload in zip(*[batch.column(c).to_pylist() for c in (
                    "start", "doc_ids", "lengths", "payload")]):
                raw = coder.decode(payload).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                rows = [raw[4 * (b - n):4 * b] for b, n in zip(ends.tolist(), lengths)]
                last = pa.array(rows, pa.binary()) if with_ids else pa.array([zlib.crc32(r) for r in rows], pa.int64())
                yield pa.record_batch(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - np.array(lengths), pa.int64()),
                     pa.array(lengths, pa.int64()), last],
                    ["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("start", "doc_ids", "lengths", "payload")
    return blocks.mapInArrow(
        run, "doc_id long, start long, n_tokens long, " + ("ids binary" if with_ids else "ids_crc32 long"))
