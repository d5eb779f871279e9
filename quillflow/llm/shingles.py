"""Word shingles of whole batches of texts, as 64-bit hashes.

A batch is brought to one byte array in which words are lower-cased (A-Z only) and closed by one
blank. The hash of any run of words is then a difference of prefix sums of a polynomial, so that
all shingles of a batch come from a few array operations.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = mixed(np.arange(1, 257, dtype=np.uint64))  # a random value for each byte


def batch_shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts in order, repeats included; shingles before each text).

    A text of fewer words than `words` gives its whole sequence as one shingle, a text without
    words none.
    """
    space = _SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(first & ~space)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = True
    ends = np.flatnonzero(last & ~space) + 1
    before = np.searchsorted(begins, offsets)
    # Words in a row with one blank after each: place of every kept byte.
    sizes = ends - begins
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    flat = np.full(int(starts[-1] + sizes[-1] + 1), 32, np.uint8)
    keep = ~space
    target = np.ones(len(flat), bool)
    target[starts + sizes] = False
    flat[target] = _LOWER[data[keep]]
    value = _CODE[flat]
    value *= powers(BASE, len(flat))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    count = np.diff(before)
    each = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    shingles = np.concatenate([[0], np.cumsum(each)])
    text = np.repeat(np.arange(len(count)), each)
    word = before[text] + np.arange(shingles[-1]) - shingles[text]
    span = np.minimum(count, words)[text]
    low, high = starts[word], starts[word + span - 1] + sizes[word + span - 1] + 1
    back = powers(INVERSE, len(flat))
    return mixed((total[high] - total[low]) * back[low] + span.astype(np.uint64)), shingles


def distinct(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their number before each text."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], kept[before]
