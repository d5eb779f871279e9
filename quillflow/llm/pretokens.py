"""Words of the byte-level BPE pattern, cut for a whole batch at once, and ids through a word cache.

The pattern is the one of the public 50k vocabulary:
`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
Its words tile the text, so a batch becomes one Arrow array over the batch's own bytes; equal
words are found by Arrow's dictionary encoding and only distinct words are encoded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
SPECIAL = b"<|endoftext|>"
CACHE_WORDS = 250_000


@lru_cache(1)
def _classes() -> np.ndarray:
    return np.full(0x110000, UNKNOWN, np.uint8)


def char_classes(points: np.ndarray) -> np.ndarray:
    """The pattern's class of every code point; a code point is looked up once per worker."""
    known = _classes()
    got = known[points]
    if (got == UNKNOWN).any():
        import regex

        for point in np.unique(points[got == UNKNOWN]).tolist():
            char = chr(point)
            known[point] = (
                LETTER if regex.match(r"\p{L}", char) else NUMBER if regex.match(r"\p{N}", char)
                else SPACE if regex.match(r"\p{White_Space}", char) else OTHER)
        got = known[points]
    return got


def word_starts(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where words start. `cuts`: first code points of texts, over which no word reaches."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = char_classes(points)
    first = np.zeros(n, bool)
    first[cuts[cuts < n]] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last white space before a visible character stands alone or, if it is a blank, leads the next word.
    leads = np.zeros(n, bool)
    leads[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start = run | leads
    blank = leads & (points == 32)
    start[1:] &= ~blank[:-1]
    # A lone apostrophe that starts a word takes the letters of a contraction.
    mark = np.flatnonzero((points == 39) & start & run)
    mark = mark[mark + 1 < n]
    mark = mark[run[mark + 1] & ~first[mark + 1]]
    one = points[mark + 1]
    short = mark[np.isin(one, [115, 116, 109, 100])]
    mark = mark[mark + 2 < n]
    one, two = points[mark + 1], points[mark + 2]
    pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    long = mark[pair & ~first[mark + 2]]
    start[short + 1] = False
    start[long + 1] = False
    after = np.concatenate([short + 2, long + 3])
    start[after[after < n]] = True
    return start


def batch_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, as a binary array over `data`; and the number of words before each text."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cuts = [offsets[:-1]]
    raw = data.tobytes()
    place = raw.find(SPECIAL)
    specials = []
    while place >= 0:
        row = int(np.searchsorted(offsets, place, "right")) - 1
        if place + len(SPECIAL) <= offsets[row + 1]:
            specials.append(place)
            place = raw.find(SPECIAL, place + len(SPECIAL))
        else:
            place = raw.find(SPECIAL, place + 1)
    if specials:
        cuts += [np.array(specials), np.array(specials) + len(SPECIAL)]
    marks = np.unique(np.concatenate(cuts)).astype(np.int64)
    start = word_starts(points, np.searchsorted(at, marks))
    if specials:
        for place in specials:  # the special token is one word
            a = int(np.searchsorted(at, place))
            start[a + 1:a + len(SPECIAL)] = False
    begins = at[start]
    bounds = np.append(begins, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return words, np.searchsorted(begins, offsets)


class WordIds:
    """Ids of batches of texts; `encode` gets distinct words and gives the ids of each as uint32 bytes.

    Words are remembered in two generations of at most `most` words: when the young one is full it
    becomes the old one, and words that are met again move back to the young one.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = CACHE_WORDS):
        self.encode, self.most = encode, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _lookup(self, distinct: list[bytes]) -> list[bytes]:
        found = list(map(self.young.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        again = [self.old.get(distinct[i]) for i in missing]
        new = [i for i, ids in zip(missing, again) if ids is None]
        for i, ids in zip(missing, again):
            found[i] = ids
        for i, ids in zip(new, self.encode([distinct[i] for i in new]) if new else ()):
            found[i] = ids
        for i in missing:
            if len(distinct[i]) <= 32:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[distinct[i]] = found[i]
        return found

    def batch(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all texts, ids before each text, word numbers, words before each text, ids of each distinct word)."""
        words, before = batch_words(data, offsets)
        coded = words.dictionary_encode()
        found = self._lookup(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), np.uint32)
        index = coded.indices.to_numpy()
        counts = sizes[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        shift = (np.cumsum(sizes) - sizes)[index] - ends[:-1]
        ids = flat[np.arange(ends[-1]) + np.repeat(shift, counts)]
        return ids, ends[before], index, before, found


@lru_cache(2)
def library_ids(path: str) -> WordIds:
    """Ids by the tokenizers library, with its own treatment of special tokens.

    Words of a blank and letters are handed over a few hundred in a row, which the pattern cuts
    again at every blank; the lengths of the tokens tell which ids belong to which word.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocabulary = tokenizer.get_vocab()
    length = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, number in vocabulary.items():
        length[number] = len(token)  # one character stands for one byte

    def rows(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for start in range(0, len(texts), 5_000)
                for x in tokenizer.encode_batch_fast(texts[start:start + 5_000], add_special_tokens=False)]

    def encode(words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        texts = [w.decode("utf-8") for w in words]
        plain = [i for i, w in enumerate(texts) if w[0] == " " and w[1:].isalpha()]
        joined = [plain[i:i + 400] for i in range(0, len(plain), 400)]
        for group, ids in zip(joined, rows(["".join(texts[i] for i in group) for group in joined])):
            ends = np.searchsorted(np.cumsum(length[ids]), np.cumsum([len(words[i]) for i in group])) + 1
            raw, start = ids.tobytes(), 0
            for i, end in zip(group, (4 * ends).tolist()):
                out[i], start = raw[start:end], end
        rest = [i for i, w in enumerate(out) if not w]
        for i, ids in zip(rest, rows([texts[i] for i in rest])):
            out[i] = ids.tobytes()
        return out

    return WordIds(encode)
