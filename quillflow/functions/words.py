"""Word counting inside one row.

Words are sorted once, so equal words form runs and a run's length is the count. Nothing is
exploded and nothing is shuffled to count the words of an article.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import SUMMARY_STOP_WORDS
from .text import SPACE, WORD, bind

LATIN_WORD = rf"(?=[a-z])(?<![{WORD}])[a-z]{{3,}}+(?![{WORD}])"


def latin_words(text: Column) -> Column:
    """Words of three or more ASCII letters, lower case, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(LATIN_WORD), 0)


def run_starts(rows: Column, key: str) -> Column:
    """Places in a sorted array where `key` changes."""
    last = F.size(rows) - F.least(F.size(rows), F.lit(1))
    # Before the first row, and in an empty array, there is nothing, which is null.
    return F.filter(F.sequence(F.lit(0), last), lambda i: ~F.get(rows, i)[key].eqNullSafe(F.get(rows, i - 1)[key]))


def run_items(rows: Column, at: Column, n: Column, take) -> Column:
    """`take` of the `n` items from place `at`. By index: slice() would copy the whole array."""
    return F.transform(F.sequence(at, at + n - 1), lambda j: take(F.get(rows, j)))


def over_runs(rows: Column, key: str, make) -> Column:
    """`make(rows, start, length)` for every run of equal `key` in a sorted array."""
    return bind(run_starts(rows, key), lambda starts: F.transform(
        starts, lambda at, k: make(rows, at, F.coalesce(F.get(starts, k + 1), F.size(rows)) - at)))


def placed(words: Column, keep) -> Column:
    """Words for which `keep` holds with their places, sorted by word and place."""
    every = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    # sort_array() compares by the type's own order; array_sort() would evaluate an expression per comparison.
    return F.sort_array(F.filter(every, lambda r: keep(r["w"])))


def positions_by_word(words: Column, keep) -> Column:
    """Struct (term, tf, positions) per distinct word for which `keep` holds."""
    return bind(placed(words, keep), lambda rows: over_runs(rows, "w", lambda r, at, n: F.struct(
        F.get(r, at)["w"].alias("term"), n.alias("tf"),
        run_items(r, at, n, lambda x: x["i"]).alias("positions"))))


def merged_terms(postings: Column, stem) -> Column:
    """`positions_by_word` with the stems as terms: each distinct word is stemmed once, equal stems are joined."""
    stemmed = F.sort_array(F.transform(postings, lambda p: F.struct(stem(p["term"]).alias("term"), p["positions"].alias("positions"))))

    def joined(rows: Column, at: Column, n: Column) -> Column:
        places = F.sort_array(F.flatten(run_items(rows, at, n, lambda r: r["positions"])))
        return F.struct(F.get(rows, at)["term"].alias("term"), F.size(places).alias("tf"), places.alias("positions"))

    return bind(stemmed, lambda rows: over_runs(rows, "term", joined))


MIN_BODY = 200
MIN_SENTENCE = 20
SUMMARY_LIMIT = 1000


def extractive_summary(
    body: Column, stop_words: Sequence[str] = tuple(SUMMARY_STOP_WORDS), keep: int = 3
) -> Column:
    """The `keep` sentences with the most frequent words, in text order; null for short texts.

    A last piece without an end mark lends its words to the counts but is no sentence. An
    article's largest word count divides all its scores alike, so the choice does without it.
    """
    pieces = F.regexp_extract_all(body, F.lit(r"[^.!?]+[.!?]*"), 0)
    edges = f"^[{SPACE}]+|[{SPACE}]+$"
    segments = F.transform(pieces, lambda p: F.struct(
        F.when(p.rlike("[.!?]$"), F.regexp_replace(p, edges, "")).alias("sentence"), latin_words(p).alias("words")))
    chosen = bind(segments, lambda s: bind(_scored(s, _weights(s, stop_words)), lambda c: F.when(
        F.size(c) > 3, _joined(F.slice(F.sort_array(F.transform(c, _ranked)), 1, keep)))))
    cut = bind(chosen, lambda s: F.when(
        F.length(s) > SUMMARY_LIMIT, F.concat(F.substring(s, 1, SUMMARY_LIMIT - 3), F.lit("..."))).otherwise(s))
    return F.when(F.length(body) >= MIN_BODY, cut)


def _weights(segments: Column, stop_words: Sequence[str]) -> Column:
    """Per segment, the sum of its words' counts in the whole text."""
    stops = list(stop_words)
    occurrences = F.flatten(F.transform(segments, lambda s, k: F.transform(
        F.filter(s["words"], lambda w: ~w.isin(stops)), lambda w: F.struct(w.alias("w"), k.alias("k")))))
    counted = bind(F.sort_array(occurrences), lambda rows: F.flatten(over_runs(
        rows, "w", lambda r, at, n: run_items(
            r, at, n, lambda x: F.struct(x["k"].alias("k"), n.cast("bigint").alias("n"))))))
    # One zero entry per segment, so that run number and segment number agree.
    zeros = F.transform(segments, lambda s, k: F.struct(k.alias("k"), F.lit(0).cast("bigint").alias("n")))
    return bind(F.sort_array(F.concat(counted, zeros)), lambda rows: over_runs(
        rows, "k", lambda r, at, n: F.aggregate(
            run_items(r, at, n, lambda x: x["n"]), F.lit(0).cast("bigint"), lambda total, m: total + m)))


def _scored(segments: Column, weights: Column) -> Column:
    """Sentences with text, number of words and weight."""
    described = bind(weights, lambda weight: F.transform(segments, lambda s, k: F.struct(
        s["sentence"].alias("sentence"), F.size(s["words"]).alias("n_words"), F.get(weight, k).alias("weight"))))
    return F.filter(described, lambda s: F.length(s["sentence"]) > MIN_SENTENCE)


def _ranked(sentence: Column, place: Column) -> Column:
    odd = (sentence["n_words"] > 30) | (sentence["n_words"] < 5)
    score = sentence["weight"] * F.when(odd, 0.5).otherwise(1.0) * F.when(place == 0, 1.5).otherwise(1.0)
    return F.struct((-score).alias("minus"), place.alias("place"), sentence["sentence"].alias("sentence"))


def _joined(best: Column) -> Column:
    ordered = F.sort_array(F.transform(best, lambda b: F.struct(b["place"], b["sentence"].alias("sentence"))))
    return F.array_join(F.transform(ordered, lambda b: b["sentence"]), " ")
