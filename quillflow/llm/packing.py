"""Best-fit packing by bin completion.

All that packing has to know are the lengths of the pieces, of which there are at most `capacity`
different ones. So the search runs over the histogram of lengths, whatever the number of pieces,
and its answer is a list of fillings with the number of sequences that each is used for. It ends
when a plan meets the bound; beyond its node limits the best plan found stands. Pieces then find
their places by their rank among pieces of their length.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_number, slices, text_bytes, written
from .pretokens import library_ids

CAPACITY = 2048
END_ID = 0
BATCH_BYTES = 6 << 20
SEARCH_NODES = 20_000  # nodes of the search for one filling; its best-fit incumbent stands if they are used up
FILLING_NODES = 2_000  # nodes of one listing of a largest piece's fillings
PLAN_NODES = 60_000  # nodes of one search for a plan of a given number of sequences, listings included


@dataclass
class Filling:
    """Pieces that share a sequence, longest first, and how often this filling is used."""

    lengths: list[int]
    times: int


def complete(room: int, lengths: np.ndarray, counts: np.ndarray, nodes: int = SEARCH_NODES) -> list[int]:
    """Lengths that fill `room` with the least waste, `counts[l]` pieces of length l being left.

    Branch and bound over fillings in order of falling lengths. The incumbent is the best-fit
    filling (always the longest piece that fits). A branch is cut when even all pieces it may still
    take leave more waste than the incumbent. Of fillings with equal waste the first found stays:
    it has the longer pieces, which dominates, because shorter pieces fit wherever longer ones do.
    """
    sizes = lengths[lengths <= room]  # ascending
    if not len(sizes):
        return []
    weight = np.concatenate([[0], np.cumsum(sizes * counts[sizes])])

    best: list[int] = []
    left, used = room, 0
    i = len(sizes) - 1
    while left and i >= 0:
        i = min(i, int(np.searchsorted(sizes, left, "right")) - 1)
        if i < 0:
            break
        take = min(left // int(sizes[i]), int(counts[sizes[i]]))
        best += [int(sizes[i])] * take
        left -= take * int(sizes[i])
        i -= 1
    waste = left

    stack: list[tuple[int, int, list[int]]] = [(len(sizes) - 1, room, [])]
    while stack and waste and used < nodes:
        used += 1
        i, left, chosen = stack.pop()
        i = min(i, int(np.searchsorted(sizes, left, "right")) - 1)
        if left < waste:
            best, waste = chosen, left
        if i < 0 or left - weight[i + 1] >= waste:
            continue
        size = int(sizes[i])
        stack.append((i - 1, left, chosen))  # without any more of this length
        for take in range(1, min(left // size, int(counts[size])) + 1):  # the most of it is looked at first
            stack.append((i - 1, left - take * size, chosen + [size] * take))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Fillings that use every piece of the histogram {length: pieces} exactly once.

    The incumbent is the least of best-fit decreasing and of two plans that complete one bin after
    the other. While it needs more sequences than the bound, branch and bound looks for a plan of
    the bound's number, and where it finds none, of numbers halfway to the incumbent's.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plans = [best_fit(counts, capacity), *(_completed(counts, capacity, nodes) for nodes in (0, SEARCH_NODES))]
    best = min(plans, key=sequences)
    most = least_sequences(counts, capacity)
    failed = most - 1
    while failed + 1 < sequences(best):
        found = within(counts, capacity, most)
        if found is None:
            failed = most
        else:
            best = found
        most = failed + max(1, (sequences(best) - failed) // 2)
    return best


def sequences(fillings: list[Filling]) -> int:
    return sum(f.times for f in fillings)


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A bound: pieces over half a sequence share none, and pieces of at least `least` tokens only go into
    the room that the large ones leave, those over capacity - least leaving none. ceil(total / capacity) or more."""
    sizes = np.arange(capacity + 1)
    pieces = np.concatenate([[0], np.cumsum(counts)])  # of lengths below the index
    tokens = np.concatenate([[0], np.cumsum(counts * sizes)])
    half, least = capacity // 2 + 1, np.arange(capacity // 2 + 1)
    full = pieces[-1] - pieces[capacity - least + 1]
    large = pieces[capacity - least + 1] - pieces[half]
    rest = tokens[capacity - least + 1] - tokens[least] - large * capacity
    return int((full + large + np.maximum(0, -(-rest // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best-fit decreasing: each piece goes where it leaves the least room. Equal sequences are kept as one."""
    rooms: list[int] = []  # ascending, of the fillings in `open_`
    open_: dict[int, list[Filling]] = {}

    def put(filling: list[int], times: int, room: int) -> None:
        if times:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append(Filling(filling, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # none has room: as many new ones as are filled with this length
                put([], -(-n // (capacity // length)), capacity)
                continue
            room = rooms[at]
            old = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            fit = room // length
            whole = min(old.times, n // fit)
            part = n - whole * fit if whole < old.times else 0  # pieces of one more, not filled up
            put(old.lengths + [length] * fit, whole, room - length * fit)
            put(old.lengths + [length] * part, int(part > 0), room - length * part)
            put(old.lengths, old.times - whole - (part > 0), room)
            n -= whole * fit + part
    return [f for room in rooms for f in open_[room]]


def fillings(largest: int, capacity: int, lengths: np.ndarray, counts: np.ndarray, spare: int) -> tuple[list, int]:
    """Fillings of the largest piece that waste at most `spare` and that no swap dominates, least waste first,
    and the nodes used. At most FILLING_NODES nodes are looked at.

    A filling is dominated if another piece still fits, or if a piece left over can take the place
    of one shorter or of two together: what it replaces fits wherever that piece would lie.
    """
    left_over = counts.copy()
    left_over[largest] -= 1
    sizes = lengths[(left_over[lengths] > 0) & (lengths <= capacity - largest)]
    weight = np.concatenate([[0], np.cumsum(sizes * left_over[sizes])]).tolist()
    sizes, many = sizes.tolist(), left_over[sizes].tolist()
    found, used = [], 0
    stack: list[tuple[int, int, list[int]]] = [(len(sizes) - 1, capacity - largest, [])]
    while stack and used < FILLING_NODES:
        used += 1
        i, left, chosen = stack.pop()
        i = min(i, bisect_right(sizes, left) - 1)
        if i < 0:
            if left <= spare and not _dominated(chosen, left, left_over):
                found.append((left, [largest, *chosen]))
            continue
        if left - weight[i + 1] > spare:
            continue
        size = sizes[i]
        for take in range(min(left // size, many[i]) + 1):  # the most of it is looked at first
            stack.append((i - 1, left - take * size, chosen + [size] * take))
    found.sort(key=lambda f: f[0])  # stable: of equal waste, longer pieces stay first
    return found, used


def _dominated(chosen: list[int], waste: int, counts: np.ndarray) -> bool:
    left = counts.copy()
    for size in chosen:
        left[size] -= 1
    kinds = sorted(set(chosen))
    pairs = {a + b for k, a in enumerate(kinds) for b in kinds[k + 1:]} | {2 * a for a in kinds if chosen.count(a) > 1}
    return bool(left[1:waste + 1].any()) or any(left[a + 1:a + waste + 1].any() for a in kinds) or any(
        left[p:p + waste + 1].any() for p in pairs)


def within(counts: np.ndarray, capacity: int, most: int) -> list[Filling] | None:
    """A plan of at most `most` sequences; None if there is none, or none was found in PLAN_NODES nodes.

    Branch and bound: the largest piece left is in some sequence, so every filling of it is a
    branch, used as often as its pieces last, and then half as often, down to once. What the
    fillings of a branch waste together may not pass what `most` sequences have to spare.
    """
    nodes = PLAN_NODES

    def branches(counts: np.ndarray, spare: int):
        nonlocal nodes
        lengths = np.flatnonzero(counts)
        found, used = fillings(int(lengths[-1]), capacity, lengths, counts, spare)
        nodes -= used
        ways = []
        for waste, filling in found:
            need, each = np.unique(filling, return_counts=True)
            times = int((counts[need] // each).min())
            ways.append((waste, filling, need, each, min(times, spare // waste) if waste else times))
        while ways:
            for waste, filling, need, each, times in ways:
                rest = counts.copy()
                rest[need] -= each * times
                yield Filling(filling, times), rest, spare - waste * times
            ways = [(*way[:4], way[4] // 2) for way in ways if way[4] > 1]

    spare = most * capacity - int((counts * np.arange(capacity + 1)).sum())
    path: list[Filling] = []
    seen: dict[bytes, int] = {}  # pieces left -> the most to spare with which they were tried
    stack = [branches(counts, spare)] if spare >= 0 else []
    while stack and nodes > 0:
        nodes -= 1
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            if path:
                path.pop()
            continue
        filling, rest, spare = branch
        if not rest.any():
            return [*path, filling]
        key = hashlib.blake2b(rest.tobytes(), digest_size=16).digest()
        if seen.get(key, -1) < spare:
            seen[key] = spare
            path.append(filling)
            stack.append(branches(rest, spare))
    return None


def _completed(pieces: np.ndarray, capacity: int, nodes: int) -> list[Filling]:
    """Complete the bin of the largest piece left, as often as the pieces of that filling last, and go on."""
    counts = pieces.copy()
    out: list[Filling] = []
    while True:
        lengths = np.flatnonzero(counts)
        if not len(lengths):
            return out
        largest = int(lengths[-1])
        counts[largest] -= 1
        filling = [largest, *complete(capacity - largest, lengths[counts[lengths] > 0], counts, nodes)]
        counts[largest] += 1
        need = np.unique(filling, return_counts=True)
        times = int((counts[need[0]] // need[1]).min())
        counts[need[0]] -= need[1] * times
        out.append(Filling(filling, times))


def places(fillings: list[Filling]) -> dict[str, np.ndarray]:
    """Where the pieces go: those of one length with ranks first .. first+times-1 go to the same offset of
    sequences base .. base+times-1. Sorted by (length, first)."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for filling in fillings:
        offset = 0
        for length in filling.lengths:
            first = seen.get(length, 0)
            rows.append((length, first, base, offset))
            seen[length] = first + filling.times
            offset += length
        base += filling.times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": columns[:, 0], "first": columns[:, 1], "base": columns[:, 2], "offset": columns[:, 3]}


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Token pieces of every text: doc_id, piece, start, length, ids_crc32, task, task_rank (, ids).

    A text's ids and then `end_id` are one piece, or, if longer than `capacity`, pieces of that
    length after a first one that takes the remainder. A null text is empty: its only id is
    `end_id`. (task, task_rank) numbers the pieces of each length inside a task.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"]

    def run(batches):
        task, seen = partition_number(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, before, *_ = library_ids(path).batch(*text_bytes(batch.column("text")))
            doc_ids = batch.column("doc_id").to_pylist()
            rows, raw = [], ids.astype("<u4").tobytes()
            end = np.array([end_id], "<u4").tobytes()
            for i, doc_id in enumerate(doc_ids):
                own = raw[4 * int(before[i]):4 * int(before[i + 1])] + end
                n = len(own) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if k == 0 else capacity
                    part = own[4 * start:4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part), task, int(seen[length]), part))
                    seen[length] += 1
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            if with_ids:
                yield pa.record_batch([*arrays, pa.array(columns[7], pa.binary())], [*names, "ids"])
            else:
                yield pa.record_batch(arrays, names)

    return documents.select("doc_id", "text").mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Pack all texts of (doc_id, text) into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids). Rows
    may repeat and doc_id may be null: every row is packed. No rows give no rows.
    """
    cut = written(pieces(documents, path, capacity, end_id, with_ids), "pieces")
    counts = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity))

    from pyspark.sql import Window

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = cut.join(ranks, ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("task_rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    # At most a few rows per length: bounded by the capacity, not by the data.
    table = cut.sparkSession.sparkContext.broadcast(where)

    def put(batches):
        rows = table.value
        shift = 1 << 44
        keys = rows["length"] * shift + rows["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            sequence = rows["base"][at] + rank - rows["first"][at]
            yield pa.record_batch(
                [*[batch.column(n) for n in names[:5]], pa.array(sequence), pa.array(rows["offset"][at]),
                 *[batch.column(n) for n in names[5:]]],
                [*names[:5], "sequence_id", "offset", *names[5:]])

    return ranked.select(*names, "rank").mapInArrow(put, out + (", ids binary" if with_ids else ""))
