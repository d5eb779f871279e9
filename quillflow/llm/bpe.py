"""BPE by dynamic programming over prefixes.

The encoding of every prefix of a word ends in exactly one token. A suffix automaton of the
vocabulary (goto and suffix links, as Aho and Corasick build them) names the tokens that end at
each place; of these, the one that is compatible with the last token of the prefix before it is
the last token of this prefix. Following the last tokens back from the end gives the ids.
Two neighbouring tokens are compatible if no merge across their border comes before the merges
that build them.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_bytes
from .pretokens import SPECIAL, WordIds

BATCH_BYTES = 6 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return [chars[b] for b in range(256)]


class PrefixEncoder:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        value = {c: b for b, c in enumerate(alphabet)}
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        count = max([*vocabulary.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * count
        for token, number in vocabulary.items():
            if token.encode() not in self.special:
                self.pieces[number] = bytes(value[c] for c in token)
        for token, number in self.special.items():
            self.pieces[number] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left part, right part, rank of their merge
        for rank, (left, right) in enumerate(merges):
            a, b = vocabulary[left], vocabulary[right]
            self.rank.setdefault((a, b), rank)
            self.parts.setdefault(vocabulary[left + right], (a, b, rank))
        # Byte strings as one character a byte, which is what the automaton reads.
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.pieces):
            if piece and piece not in self.special and (len(piece) == 1 or number in self.parts):
                self.automaton.add_word(piece.decode("latin-1"), (number, len(piece)))
        self.automaton.make_automaton()
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}  # by last token (0 at the start of the word) and next token

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part at this end, rank of the merge that uses it up), from the token itself down to one byte."""
        chain, until = [(token, NEVER)], NEVER
        while token in self.parts:
            until = self.parts[token][2]
            token = self.parts[token][side]
            chain.append((token, until))
        return chain

    def compatible(self, left: int, right: int) -> bool:
        """No merge over the border happens while both parts exist. Of equal merges the left one is first."""
        right_chain = self._border(right, 0)
        for a, a_until in self._border(left, 1):
            for b, b_until in right_chain:
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def is_whole(self, token: int) -> bool:
        """The token's own bytes are encoded as this token."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (
                self.is_whole(parts[0]) and self.is_whole(parts[1]) and self._joins(parts[0], parts[1], parts[2]))
            self.whole[token] = known
        return known

    def _joins(self, left: int, right: int, own: int) -> bool:
        for a, a_until in self._border(left, 1):
            for b, b_until in self._border(right, 0):
                rank = self.rank.get((a, b))
                if rank is not None and rank != own and rank < a_until and rank <= b_until:
                    return False
        return True

    def word(self, word: bytes) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        last = [-1] * (len(word) + 1)
        back = [0] * (len(word) + 1)
        fits = self.fits
        for at, (token, size) in self.automaton.iter(word.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            pair = last[start] + 1 << 20 | token if start else token
            good = fits.get(pair)
            if good is None:
                good = self.is_whole(token) and (not start or self.compatible(last[start], token))
                if len(fits) >= 500_000:
                    fits.clear()
                fits[pair] = good
            if good:
                last[end], back[end] = token, start
        ids, end = [], len(word)
        while end:
            ids.append(last[end])
            end = back[end]
        ids.reverse()
        return ids

    def words(self, words: list[bytes]) -> list[bytes]:
        return [np.array(self.word(w), np.uint32).tobytes() for w in words]


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(encoder(path).words)


class Decoder:
    """Bytes of ids, for a whole batch at once."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, bytes before each id)."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.starts[ids] - ends[:-1], sizes)
        shift += np.arange(ends[-1])
        return self.flat[shift], ends


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(encoder(path).pieces)


def _decimal(found: list[bytes]) -> list[bytes]:
    flat = list(map(str, np.frombuffer(b"".join(found), np.uint32).tolist()))
    out, start = [], 0
    for ids in found:
        stop = start + (len(ids) >> 2)
        out.append(",".join(flat[start:stop]).encode())
        start = stop
    return out


def encode(documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text as little-endian unsigned 32-bit integers. A null text is empty."""

    def run(batches):
        for batch in slices(batches, text, BATCH_BYTES):
            ids, before, *_ = word_ids(path).batch(*text_bytes(batch.column(text)))
            raw = ids.astype("<u4").tobytes()
            rows = [raw[4 * a:4 * b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
            yield pa.record_batch([batch.column(id_column), pa.array(rows, pa.binary())], [id_column, "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, ids binary")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, text) of the rows of `encode`. Bytes that are no UTF-8 become replacement characters."""

    def run(batches):
        for batch in slices(batches, "ids", 4 * BATCH_BYTES):
            texts = []
            for raw in batch.column("ids").to_pylist():
                data, _ = decoder(path).bytes_of(np.frombuffer(raw or b"", "<u4"))
                texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(id_column), pa.array(texts, pa.string())], [id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """One row per row of `documents` (doc_id, text): number of ids, their digest, digest of the text decoded
    from the ids. Rows may repeat and doc_id may be null; a null or empty text has no ids and digests of nothing."""

    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, before, index, words, found = word_ids(path).batch(*text_bytes(batch.column("text")))
            shown = _decimal(found)
            index = index.tolist()
            data, ends = decoder(path).bytes_of(ids)
            cuts = ends[before].tolist()
            ids_sha, text_sha = [], []
            for i in range(batch.num_rows):
                line = b",".join([shown[w] for w in index[words[i]:words[i + 1]]])
                ids_sha.append(hashlib.sha256(line).hexdigest())
                text = data[cuts[i]:cuts[i + 1]].tobytes()
                try:
                    text.decode("utf-8")
                except UnicodeDecodeError:
                    text = text.decode("utf-8", "replace").encode()
                text_sha.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(before), pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


__all__ = ["SPECIAL", "PrefixEncoder", "decode", "digests", "encode", "encoder"]
