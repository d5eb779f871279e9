"""Per-article enrichment as column expressions: no shuffle, no Python workers.

`max_chars` is off by default, so whole texts are read; set it to bound the work per article.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import ACRONYMS, ENTITIES, KEYWORD_STOP_WORDS, SECTORS, SENTIMENT
from .text import WORD, bind
from .words import latin_words, over_runs, placed

_EXTRACTOR_VERSION = 1


def article_text(title: Column, content: Column, max_chars: int | None = None) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def _quote(term: str) -> str:
    """Escape for a Java pattern; letters, digits and blanks need nothing."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def term_pattern(terms: Sequence[str]) -> str:
    """Whole-word, case-blind alternation in the given order.

    The leading look-ahead rejects most positions on one character, before the word-boundary test.
    """
    first = {c for t in terms for c in (t[0].lower(), t[0].upper())}
    first |= {"\u017f"} & {"\u017f" for c in first if c == "s"} | {"\u212a" for c in first if c == "k"}
    starts = "".join(_quote(c) for c in sorted(first))
    alternatives = "|".join(_quote(t) for t in terms)
    return f"(?=[{starts}])(?<![{WORD}])((?iu:{alternatives}))(?![{WORD}])"


def title_case(text: Column) -> Column:
    """First letter of each run of letters upper case, the others lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def _casing(kind: str):
    if kind == "Regulator":
        return F.upper
    return lambda m: F.when(F.upper(m).isin(ACRONYMS), F.upper(m)).otherwise(title_case(m))


def _typed(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(
        n.alias("entity"),
        F.lit(kind).alias("entity_type"),
        F.lit(1.0).alias("confidence"),
        F.lit(_EXTRACTOR_VERSION).alias("extractor_version"),
    ))


def entities(text: Column, dictionary: Mapping[str, Sequence[str]] = ENTITIES) -> Column:
    """Distinct typed entities found in `text`, longest dictionary entry first."""
    found = []
    for kind, terms in dictionary.items():
        pattern = term_pattern(sorted(terms, key=len, reverse=True))
        matches = F.regexp_extract_all(text, F.lit(pattern), 1)
        found.append(_typed(F.array_distinct(F.transform(matches, _casing(kind))), kind))
    return F.concat(*found)


def sectors(
    text: Column, dictionary: Mapping[str, Sequence[str]] = SECTORS, keep: int = 3, cap: float = 10.0
) -> Column:
    """Best `keep` sectors by number of keyword hits; ties keep dictionary order."""
    scored = F.array(*[
        F.struct(
            (-F.least(F.regexp_count(text, F.lit(term_pattern(terms))).cast("double"), F.lit(cap))).alias("minus"),
            F.lit(place).alias("place"),
            F.lit(name).alias("sector"),
        )
        for place, (name, terms) in enumerate(dictionary.items())
    ])
    best = F.slice(F.sort_array(F.filter(scored, lambda s: s["minus"] < 0)), 1, keep)
    return F.transform(best, lambda s: F.struct(s["sector"].alias("sector"), (-s["minus"]).alias("score")))


def sentiment(
    title: Column,
    content: Column,
    lexicon: Mapping[str, float] = SENTIMENT,
    max_chars: int | None = None,
) -> Column:
    """Struct (label, score); the title counts twice."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), article_text(title, content))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    weights = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    hits = F.regexp_extract_all(text, F.lit(term_pattern(list(lexicon))), 1)
    total = F.aggregate(
        hits, F.lit(0.0), lambda acc, hit: acc + F.coalesce(F.try_element_at(weights, F.lower(hit)), F.lit(0.0)))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / 3.0))
    label = lambda s: F.when(s >= 0.2, "positive").when(s <= -0.2, "negative").otherwise("neutral")
    return bind(score, lambda s: F.struct(
        label(s).alias("label"), F.bround(s, 4).alias("score")))


def keywords(text: Column, stop_words: Sequence[str] = tuple(KEYWORD_STOP_WORDS), keep: int = 5) -> Column:
    """Most frequent words of three or more ASCII letters; ties keep text order."""
    counted = bind(placed(latin_words(text), lambda w: ~w.isin(list(stop_words))), lambda rows: over_runs(rows, "w", lambda r, at, n: F.struct(
        (-n).alias("minus"), F.get(r, at)["i"].alias("first"), F.get(r, at)["w"].alias("keyword"))))
    return bind(F.slice(F.sort_array(counted), 1, keep), lambda top: F.transform(top, lambda t: F.struct(
        t["keyword"].alias("keyword"),
        F.bround(t["minus"] / F.get(top, F.lit(0))["minus"], 4).alias("weight"),
    )))
