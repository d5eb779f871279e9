"""Spelling variants: words of a corpus with the more frequent words that are one edit away.

1. Runs of letters are cut out, counted per batch and added up by word.
2. Two words one edit apart differ first at one place; before it and after it they agree. A word goes into
   groups (m, a, b): m is the smaller length of a pair, its first difference lies at a place from a to m - b, so
   all members share their first a and last b letters. The places 0..m are halved to begin with; a group with
   more than `GROUP` words is halved again, down to single places, where only the alphabet is left. Every pair
   meets in exactly one group.
3. A group is a sorted list of what its members do not share. It is scanned by dynamic programming: a range
   of neighbours with a common prefix has one row of the edit matrix (three cells around the diagonal) for
   every word it is compared with; adjacent longest common prefixes tell where ranges split, rows are handed
   on to the parts of a range, and a range whose row exceeds one edit is left out with all its words.
   Rows of all ranges of one prefix length are computed together as arrays.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .shingles import BASE, INVERSE, mixed, powers

LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5  # a form is at least so many times as frequent
TYPO_EVERY = 199
GROUP = 1024
LIST_ROWS = 4096
PAIRS = 1 << 19  # compared at once
BATCH_BYTES = 2 << 20
ROUNDS = 64

# --- Words -----------------------------------------------------------------------------------------

# Texts are seen as one byte per code point; all but U+0000 to U+00FF become a question mark.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0xC0, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_CODE = mixed(np.arange(1, 257, dtype=np.uint64))


def _crc(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of each word as UTF-8, carried on from `start`."""
    state = start.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    begins, left, value = begins[order], sizes[order], state[order]
    step = lambda crc, byte: _CRC[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    count = len(order)
    for place in range(int(left[0]) if count else 0):
        while left[count - 1] <= place:  # the shortest are through
            count = int(np.searchsorted(-left, -place, "left"))
        byte = flat[begins[:count] + place].astype(np.uint32)
        wide = byte >= 0xC0
        crc = np.where(wide, step(value[:count], np.uint32(0xC3)), value[:count])
        value[:count] = step(crc, np.where(wide, byte - np.uint32(0x40), byte))
    out = np.empty(len(order), np.uint32)
    out[order] = value
    return out ^ np.uint32(0xFFFFFFFF)


def _batch_words(ids: list, texts: list, least: int, every: int) -> Counter:
    """Words of a batch and how often they occur."""
    raw = [(t or "").encode("latin-1", "replace") for t in texts]
    flat = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    letter = _LETTER[flat]
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        change = np.concatenate([[0], change])
    begins, ends = change[0::2], change[1::2]
    long = ends - begins >= least
    begins, ends = begins[long], ends[long]
    found: Counter = Counter()
    if not len(begins):
        return found
    sizes = ends - begins
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    starts = np.array([zlib.crc32(("" if i is None else str(i)).encode() + b":") for i in ids], np.uint32)
    crc = _crc(flat, begins, sizes, starts[np.searchsorted(text_ends, begins, "right")])
    typed = crc % np.uint32(every) == 0 if every else np.zeros(len(crc), bool)
    for begin, size, h in zip(begins[typed].tolist(), sizes[typed].tolist(), crc[typed].tolist()):
        word = flat[begin:begin + size].tobytes()
        word = word[:h % size] + word[h % size + 1:]
        if len(word) >= least:
            found[word.decode("latin-1")] += 1
    begins, ends = begins[~typed], ends[~typed]
    value = _CODE[flat]
    value *= powers(BASE, len(flat))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    keys = mixed((total[ends] - total[begins]) * powers(INVERSE, len(flat))[begins] + (ends - begins).astype(np.uint64))
    _, first, times = np.unique(keys, return_index=True, return_counts=True)
    for i, n in zip(first.tolist(), times.tolist()):
        found[flat[begins[i]:ends[i]].tobytes().decode("latin-1")] += n
    return found


def words(documents: DataFrame, least: int = LEAST_LENGTH, every: int = 0) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF of at least `least` code points, A-Z lower-cased.

    With `every`, a run whose crc32(`<doc_id>:<run>`) it divides loses one letter, which stands for a slip of the pen.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", BATCH_BYTES):
            found = _batch_words(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), least, every)
            if found:
                yield pa.record_batch(
                    [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counted = documents.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# --- Groups ----------------------------------------------------------------------------------------


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b) in both halves of their places: the later one first."""
    rest = F.col("m") - F.col("a") - F.col("b")
    half = F.floor(rest / 2).cast("int")
    later = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    former = F.struct(F.col("a").alias("a"), (F.col("b") + rest - half).alias("b"))
    return rows.select("word", "n", "m", F.explode(F.array(later, former)).alias("_h")).select(
        "word", "n", "m", "_h.a", "_h.b")


def _keyed(rows: DataFrame) -> DataFrame:
    size = F.char_length("word")
    front, back = F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(
        F.col("word"), size - F.col("b") + 1, F.col("b"))
    return rows.withColumns({
        "group": F.concat_ws(":", "m", "a", "b", front, back),
        "rest": F.substring(F.col("word"), F.col("a") + 1, size - F.col("a") - F.col("b"))})


def groups(vocabulary: DataFrame, most: int = GROUP, least: int = LEAST_LENGTH) -> DataFrame:
    """(group, rest, word, n, m, b): every pair of words one edit apart is together in exactly one group.

    Groups above `most` words are halved until they are small enough or have one place left.
    """
    size = F.char_length("word")
    sized = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= least)
    rows = written(_keyed(_halves(sized.select("*", F.lit(0).alias("a"), F.lit(0).alias("b")))), "groups")
    done = None
    while True:
        big = written(rows.where("m - a - b > 1").groupBy("group").count().where(F.col("count") > most)
                      .select("group", F.lit(True).alias("_big")), "big")
        if big.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = written(rows.join(big, "group", "left"), "marked")
        small = marked.where("_big is null").drop("_big")
        done = small if done is None else done.unionByName(small)
        rows = written(_keyed(_halves(marked.where("_big").select("word", "n", "m", "a", "b"))), "halves")


# --- Sorted lists ----------------------------------------------------------------------------------


def _flat(rests: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rests], np.int64)
    flat = np.frombuffer("".join(rests).encode("latin-1") + b"\0\0", np.uint8)
    return flat, np.cumsum(sizes) - sizes, sizes


def shared_prefixes(list_of: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Letters that each entry shares with the one before it; -1 at the start of a list."""
    lcp = np.where(np.concatenate([[False], list_of[1:] == list_of[:-1]]), 0, -1)
    alive, depth = np.flatnonzero(lcp == 0), 0
    while len(alive):
        alive = alive[(sizes[alive] > depth) & (sizes[alive - 1] > depth)]
        alive = alive[flat[at[alive] + depth] == flat[at[alive - 1] + depth]]
        depth += 1
        lcp[alive] = depth
    return lcp


def near_pairs(list_of: np.ndarray, rests: list[str], pairs: int = PAIRS):
    """(word, near word, letters they share in front), as places, of all entries of one list one edit apart.

    `list_of` numbers the lists in ascending order; the entries of a list are sorted and distinct.
    """
    flat, at, sizes = _flat(rests)
    lcp = shared_prefixes(list_of, flat, at, sizes)
    n = len(rests)
    heads = np.flatnonzero(lcp < 0)
    tails = np.append(heads[1:], n)
    # A list is the range of the empty prefix, compared with each of its own words.
    lengths = tails - heads
    low, high, word = np.repeat(heads, lengths), np.repeat(tails, lengths), np.arange(n)
    stack = [(0, low, high, word, np.full(n, 2, np.int8), np.zeros(n, np.int8),
              np.where(sizes[word] > 0, 1, 2).astype(np.int8), np.zeros(n, np.int64))]
    out = []
    starts_at: dict[int, np.ndarray] = {}
    while stack:
        depth, low, high, word, left, here, right, same = stack.pop()
        # Only a range's first entry can end at its prefix.
        over = sizes[word] - depth
        cell = np.choose(np.clip(over + 1, 0, 2), [left, here, right])
        ends = (sizes[low] == depth) & (np.abs(over) <= 1) & (cell == 1)
        if ends.any():
            out.append((word[ends], low[ends], same[ends]))
        starts = starts_at.get(depth)
        if starts is None:
            starts = starts_at[depth] = np.flatnonzero((lcp <= depth) & (sizes > depth))
        first = np.searchsorted(starts, low)
        count = np.searchsorted(starts, high) - first
        cuts = np.searchsorted(np.cumsum(count), np.arange(pairs, int(count.sum()) + pairs, pairs), "left") + 1
        before = 0
        for cut in np.unique(np.append(np.minimum(cuts, len(count)), len(count))).tolist():
            part, before = slice(before, cut), cut
            times = count[part]
            total = int(times.sum())
            if not total:
                continue
            own = np.repeat(np.arange(part.start, part.stop), times)
            child = first[own] + np.arange(total) - np.repeat(np.cumsum(times) - times, times)
            low2 = starts[child]
            nearer = np.minimum(np.append(starts[1:], n)[child], high[own])
            w, l, h, r, s = word[own], left[own], here[own], right[own], same[own]
            letter, size, q = flat[at[low2] + depth], sizes[w], at[w]
            differs = lambda j: (flat[np.minimum(q + j, len(flat) - 1)] != letter).astype(np.int8)
            d0 = differs(depth)
            new_left = np.minimum(h + 1, l + (differs(depth - 1) if depth else 2))
            new_left[size < depth] = 2
            new_here = np.minimum(np.minimum(r + 1, h + d0), new_left + 1)
            new_here[size < depth + 1] = 2
            new_right = np.minimum(r + differs(depth + 1), new_here + 1)
            new_right[size < depth + 2] = 2
            best = np.minimum(np.minimum(new_left, new_here), new_right) <= 1
            same2 = s + ((s == depth) & (size > depth) & (d0 == 0))
            trim = lambda x: np.minimum(x[best], 2).astype(np.int8)
            if best.any():
                stack.append((depth + 1, low2[best], nearer[best], w[best], trim(new_left), trim(new_here),
                              trim(new_right), same2[best]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(rows: pa.Table) -> pa.RecordBatch | None:
    """Per word: how many near words its lists hold, and the most frequent of them."""
    group = np.array(rows.column("group").to_pylist(), object)
    list_of = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    words_, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    m, b = rows.column("m").to_numpy(), rows.column("b").to_numpy()
    size = np.array([len(w) for w in words_])
    a = np.array([int(g.split(":", 3)[1]) for g in group])
    word, near, same = near_pairs(list_of, rows.column("rest").to_pylist())
    good = np.minimum(size[word], size[near]) == m[word]  # two of the longer ones meet in the next group
    good &= (b[word] == 0) | (same + a[word] < m[word] - b[word])  # a later first difference is another group's
    word, near = word[good], near[good]
    if not len(word):
        return None
    rank = np.empty(len(words_), np.int64)
    rank[sorted(range(len(words_)), key=words_.__getitem__)] = np.arange(len(words_))
    order = np.lexsort((rank[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    count = np.diff(np.append(first, len(word)))
    return pa.record_batch(
        [pa.array([words_[i] for i in word[first].tolist()], pa.string()), pa.array(count, pa.int64()),
         pa.array(n[near[first]], pa.int64()), pa.array([words_[i] for i in near[first].tolist()], pa.string())],
        ["word", "n_near", "form_n", "form"])


def near_words(vocabulary: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n_near, form, form_n) of (word, n): near words and the most frequent of them, ties to the least.

    Only words that have near ones. Memory is bounded by a list: `most` words, or what one letter can make.
    """
    lists = groups(vocabulary, most)
    dealt = lists.repartition("group").sortWithinPartitions("group", "rest").select("group", "rest", "word", "n", "m", "b")

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < LIST_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = table.column("group")[-1].as_py()
            stop = rows - 1  # the last list may go on in the next batch
            while stop >= 0 and table.column("group")[stop].as_py() == last:
                stop -= 1
            ready, rest = table.slice(0, stop + 1), table.slice(stop + 1)
            yield from _scanned(ready)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if held:
            yield from _scanned(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", F.col("_b.form").alias("form"), (-F.col("_b.minus")).alias("form_n"))


def _scanned(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Scan whole lists, about `LIST_ROWS` entries at a time; lists of one word have nothing to find."""
    if not rows.num_rows:
        return
    group = np.array(rows.column("group").to_pylist(), object)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lengths = np.diff(np.append(heads, len(group)))
    rows = rows.filter(pa.array(np.repeat(lengths > 1, lengths)))
    lengths = lengths[lengths > 1]
    ends = np.cumsum(lengths)
    start = 0
    while start < rows.num_rows:
        stop = int(ends[min(np.searchsorted(ends, start + LIST_ROWS), len(ends) - 1)])
        batch = _scan(rows.slice(start, stop - start).combine_chunks())
        if batch is not None:
            yield batch
        start = stop


def variants(vocabulary: DataFrame, ratio: int = RATIO, most: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (word, n).

    A word's form is its most frequent near word if that is `ratio` times as frequent; `root` is the end of
    the chain of forms. Forms grow in frequency, so chains end; they are followed by doubling.
    """
    vocabulary = written(vocabulary.select("word", "n"), "words")
    near = written(near_words(vocabulary, most), "near")
    joined = vocabulary.join(near, "word", "left")
    good = F.col("form_n") >= F.col("n") * ratio
    told = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "forms")
    chain = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        longer = written(chain.join(on, "root", "left").select(
            "word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "chains")
        chain = longer.select("word", "root")
        if longer.where("_moved").isEmpty():
            break
    else:
        raise RuntimeError("chains of forms did not end")
    return told.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digests(documents: DataFrame) -> DataFrame:
    """Variants of the words of whole texts, slips included, that have 6 letters and 5 occurrences.

    Null and empty texts have no words; a null doc_id counts as an empty one. Repeated rows count as often as they
    occur. An empty table gives no rows. Words are compared by 64-bit hash inside a batch and as text everywhere else.
    """
    counted = words(documents, every=TYPO_EVERY)
    return variants(counted.where(F.col("n") >= LEAST_COUNT))
