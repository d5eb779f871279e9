"""Toxicity by a weighted lexicon.

Texts are folded first: letter case, accents outside Latin-1, look-alike letters of other scripts, digits and signs that stand for
letters inside words, and invisible characters. An Aho-Corasick automaton then finds, in one pass, the
lexicon's word beginnings and the exception phrases; at a word the longest entry counts, and words inside an
exception do not count.

The weight of an entry is the logarithm of its rate in toxic over its rate in clean text. A document's sum of
weights is normalised by length: the weight that clean text of that many words has by chance is taken
off, and the rest is measured in standard deviations of that chance; the sum per word is the second measure. A
logistic curve over both gives the score.

Entries are learned from labelled documents: beginnings of words that are significantly more frequent in toxic than in clean ones.
`LEXICON` takes part like a few toxic documents more, and stands alone where there are no labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written
from .neardup import signatures

SAMPLE = 8000  # labelled documents of each kind to learn from, about
SHORTEST, LONGEST = 3, 10  # letters of a learned entry
LEAST_DOCUMENTS = 3
LEAST_EVIDENCE = 25.0  # log-likelihood ratio of an entry's occurrences; half of it for its documents
COUNTED = 3  # occurrences of an entry in one document that count when entries are chosen
LEAST_RATIO = 4.0
ENTRIES, CANDIDATES = 500, 4000
MOST_WEIGHT = 6.0
BATCH_BYTES = 4 << 20
THRESHOLD = 0.3

LEXICON = (
    "arsehole", "asshole", "bastard", "bitch", "bullshit", "clown", "crap", "cretin", "degenerate", "disgusting", "dumbass", "filth",
    "fool", "freak", "fuck", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "liar", "loser", "maggot", "moron", "pathetic",
    "pig", "retard", "scum", "shit", "slut", "stupid", "trash", "ugly", "vermin", "whore", "worthless")
LEXICON_DOCUMENTS = 0.5  # how many toxic documents the list's word counts for

# Harmless uses: nothing inside these phrases counts.
EXCEPTIONS = (
    "class clown", "clown fish", "clownfish", "fool proof", "foolproof", "garbage collection", "garbage collector", "garbage truck",
    "guinea pig", "hate speech", "hateful conduct", "idiot proof", "kill process", "kill signal", "killer whale", "pond scum",
    "sore loser", "trash bag", "trash bin", "trash can")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ԍ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ł": "l", "ø": "o"}
# Digits and signs that stand for letters, inside words only.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_SIGNS = "@$!|"
_STAND_IN = re.compile(
    r"(?<=[a-z])[0134578@$!|]+(?=[a-z])|(?<![a-z0-9@$!|])[0134578@$]+(?=[a-z])|(?<=[a-z])[0134578]+(?![a-z0-9@$!|])")
_TO_LETTERS = str.maketrans(DIGITS)
_NO_SIGNS = str.maketrans(dict.fromkeys(_SIGNS, " "))


class _Folding(dict):
    """What a code point becomes, worked out at first sight."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char) in ("Cf", "Mn") or char in "'’":
            out = ""  # invisible or a mark on a letter
        elif 0xC0 <= code <= 0xFF and char.isalpha():
            out = char.lower()  # letters of their own in many languages
        else:
            out = "".join(
                LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKD", char).lower() if unicodedata.category(c) != "Mn")
            out = "".join(c if c.isalnum() or c in _SIGNS else " " for c in out)
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> list[str]:
    """The words of a text, folded."""
    low = (text or "").translate(_FOLDING)
    low = _STAND_IN.sub(lambda m: m[0].translate(_TO_LETTERS), low)
    return low.translate(_NO_SIGNS).split()


@dataclass
class Lexicon:
    """Weighted word beginnings, exceptions, the chance of clean text, and the curve from measures to a score."""

    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    chance: float = 0.0  # weight per word of clean text
    spread: float = 0.0  # its variance per word
    curve: tuple[float, ...] = (-4.0, 2.0, 0.5)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found: dict[str, tuple] = {" " + entry: (len(entry) + 1, w) for entry, w in self.weights.items()}
            # A phrase ends with its last word, so that "trash cans" is one, too.
            found |= {" " + " ".join(fold(p)): (len(" ".join(fold(p))) + 1, None) for p in self.exceptions}
            machine = ahocorasick.Automaton()
            for key, value in found.items():
                machine.add_word(key, value)
            if found:
                machine.make_automaton()
            self._automaton = machine
        return self._automaton

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(place in the folded text, weight) of the entries that count."""
        if not len(self.automaton()):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(" " + " ".join(words)):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or best[start][0] < size:
                best[start] = (size, weight)
        return [(s, w) for s, (_, w) in best.items() if not any(a <= s < b for a, b in spared)]

    def measures(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        excess = (total - self.chance * n) / np.sqrt(1 + self.spread * n)
        return np.stack([np.ones(len(n)), np.log1p(np.maximum(excess, 0)), np.log1p(100 * np.maximum(total, 0) / (n + 20))], 1)

    def scores(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(total, n) @ np.array(self.curve), -30, 30)))


def _sums(lexicon: Lexicon, texts: list) -> tuple[np.ndarray, np.ndarray]:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        words = fold(text)
        n[i], total[i] = len(words), sum(w for _, w in lexicon.hits(words))
    return total, n


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about `size` labelled documents of each kind, chosen by hash; all of a kind that has fewer.

    A doc_id labelled both ways counts as toxic. Held-out rows and rows without a label take no part. Of documents that
    share a MinHash band one stays: the words of a much copied document say no more than those of another.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    known = written(known, "labels")
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for kind, count in there.items():
        share = F.when(F.col("toxic") == kind, min(1.0, size / count)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = written(known.where(place < share), "picked")  # its exact, bounded size decides about the join
    rows = documents.select("doc_id", "text").join(picked, "doc_id").withColumn("doc_id", F.monotonically_increasing_id())
    rows = written(rows, "sample")
    bands = written(signatures(rows).where("bands is not null").select("doc_id", F.explode("bands").alias("band")), "bands")
    firsts = written(bands.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copies = bands.join(firsts, "band").where("doc_id <> first").select("doc_id").distinct()
    return written(rows.join(copies, "doc_id", "left_anti").select("text", "toxic"), "originals")


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and word beginning: documents and occurrences in toxic and in clean texts; the empty one counts words."""
    for batch in slices(batches, "text", BATCH_BYTES):
        found: dict[str, np.ndarray] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = Counter(fold(text))
            own: Counter = Counter()
            for word, n in words.items():
                for size in range(SHORTEST, min(len(word), LONGEST) + 1):
                    own[word[:size]] += n
            own = Counter({entry: min(n, COUNTED) for entry, n in own.items()})
            own[""] = sum(words.values())
            row = 0 if toxic else 2
            for entry, n in own.items():
                counts = found.get(entry)
                if counts is None:
                    counts = found[entry] = np.zeros(4, np.int64)
                counts[row] += 1
                counts[row + 1] += n
        values = np.array(list(found.values())).reshape(-1, 4)
        yield pa.record_batch(
            [pa.array(list(found), pa.string()), *[pa.array(values[:, i]) for i in range(4)]], ["entry", "d1", "c1", "d0", "c0"])


def _evidence(seen1: Column, seen0: Column, all1: int, all0: int) -> Column:
    """Log-likelihood ratio of two counts against one rate for both kinds."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    one, two = seen1.cast("double"), seen0.cast("double")
    rate = (one + two) / float(all1 + all0)
    return 2 * (part(one, rate * all1) + part(two, rate * all0))


def _chosen(candidates: list) -> list:
    """Of beginnings that say the same thing, one: the longest with the most evidence.

    A longer one beside a shorter one must be told apart from it by the clean text it should have been seen in.
    """
    kept: dict[str, object] = {}

    def told_by(short, row) -> bool:
        due = row["c1"] * (short["c0"] + 0.5) / (short["c1"] + 0.5)
        return due < 5 or row["c0"] > due / 3

    for row in sorted(candidates, key=lambda r: (-round(r["evidence"], 6), -len(r["entry"]), r["entry"])):
        entry = row["entry"]
        shorter = [kept[entry[:i]] for i in range(1, len(entry)) if entry[:i] in kept]
        longer = [k for e, k in kept.items() if e.startswith(entry)]
        if any(told_by(s, row) for s in shorter) or sum(k["d1"] for k in longer) >= 0.8 * row["d1"]:
            continue
        kept[entry] = row
        if len(kept) == ENTRIES:
            break
    return list(kept.values())


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a light pull to zero."""
    pull = np.diag([1e-3, 0.05, 0.05])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + pull, x.T @ (y - p) - pull @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(documents: DataFrame, labels: DataFrame, size: int = SAMPLE, base: Sequence[str] = LEXICON,
          exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the texts and `toxic` labels (0 or 1) of documents that are not held out.

    Word counts are a Spark aggregate over the sample; the driver sees `CANDIDATES` rows of it at most, and two numbers for
    each document of the sample. Without toxic or without clean labels the base list stands alone.
    """
    rows = sample(documents, labels, size)
    counted = written(rows.mapInArrow(_beginnings, "entry string, d1 long, c1 long, d0 long, c0 long").groupBy("entry").agg(
        *[F.sum(c).alias(c) for c in ("d1", "c1", "d0", "c0")]), "beginnings")
    whole = counted.where("entry = ''").first()
    if not whole or not whole["d1"] or not whole["d0"]:
        return Lexicon({" ".join(fold(w)): 3.0 for w in base}, exceptions)
    words1, words0 = whole["c1"] + 1, whole["c0"] + 1
    ratio = (F.col("c1") + 0.5) / words1 / ((F.col("c0") + 0.5) / words0)
    evident = counted.withColumn("evidence", _evidence(F.col("c1"), F.col("c0"), words1, words0)).where(
        (F.col("entry") != "") & (F.col("d1") >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO) & (F.col("evidence") >= LEAST_EVIDENCE)
        & (_evidence(F.col("d1"), F.col("d0"), whole["d1"], whole["d0"]) >= LEAST_EVIDENCE / 2))
    top = evident.orderBy(F.desc("evidence"), F.desc(F.length("entry")), "entry").limit(CANDIDATES).collect()
    chosen = {r["entry"]: (r["c1"], r["c0"]) for r in _chosen(top)}
    listed = [" ".join(fold(w)) for w in base]
    for row in counted.where(F.col("entry").isin([w[:LONGEST] for w in listed])).collect():
        chosen.setdefault(row["entry"], (row["c1"] + LEXICON_DOCUMENTS, row["c0"]))
    for word in listed:
        chosen.setdefault(word[:LONGEST], (LEXICON_DOCUMENTS, 0))
    weights = {}
    for entry, (c1, c0) in chosen.items():
        weight = math.log((c1 + 0.5) / words1 / ((c0 + 0.5) / words0))
        if weight > 0:
            weights[entry] = min(weight, MOST_WEIGHT)
    rates = [(weights[e], c0 / words0) for e, (_, c0) in chosen.items() if e in weights]
    lexicon = Lexicon(weights, exceptions, sum(w * r for w, r in rates), sum(w * w * r for w, r in rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            total, n = _sums(lexicon, batch.column("text").to_pylist())
            yield pa.record_batch([pa.array(total), pa.array(n), batch.column("toxic").cast(pa.int32())], ["total", "n", "toxic"])

    seen = rows.mapInArrow(run, "total double, n double, toxic int").toArrow()
    x = lexicon.measures(seen.column("total").to_numpy(), seen.column("n").to_numpy())
    y = seen.column("toxic").to_numpy().astype(float)
    lexicon.curve = _fit_curve(x, y)
    return lexicon


def score(documents: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `documents` with `score` (0 to 1) and `predicted` (1 from `threshold` on).

    Null, empty and wordless texts get the score of a text without any hit. Each row is scored on its own whole text;
    columns called `score` or `predicted` give way.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    rows = documents.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = lexicon.scores(*_sums(lexicon, batch.column("text").to_pylist()))
            yield pa.record_batch(
                [*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def digests(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nothing but the text decides about a score."""
    lexicon = learn(documents, labels)
    return score(documents.select("doc_id", "text"), lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")
