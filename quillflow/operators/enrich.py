"""Attach enrichment outputs to articles; the list of enrichers can be extended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enrichment as E
from ..functions.words import extractive_summary

# An enricher is a name and either a column expression or a DataFrame step.
Step = Callable[[DataFrame], DataFrame]
Enricher = tuple[str, Column | Step]


def standard_enrichers(
    title: str = "title", content: str = "content", max_chars: int | None = None, **dictionaries
) -> list[Enricher]:
    """Entities, sectors, sentiment and keywords."""
    text = E.article_text(F.col(title), F.col(content), max_chars)
    get = dictionaries.get
    with_dictionary = lambda fn, name, *args: fn(*args, get(name)) if get(name) else fn(*args)
    mood = with_dictionary(E.sentiment, "lexicon", F.col(title), F.col(content))
    return [
        ("entities", with_dictionary(E.entities, "entities", text)),
        ("sectors", with_dictionary(E.sectors, "sectors", text)),
        ("sentiment", mood),
        ("keywords", with_dictionary(E.keywords, "stop_words", text)),
    ]


def register_enricher(enrichers: Sequence[Enricher], name: str, step: Column | Step) -> list[Enricher]:
    """A new list with one more enricher; a name may stand only once."""
    if name in [n for n, _ in enrichers]:
        raise ValueError(f"enricher {name} is registered already")
    return [*enrichers, (name, step)]


def isolated(value: Callable, returns: str, *inputs: Column) -> Column:
    """Run a pandas function `value(*series)` so that a bad row fails alone.

    Gives struct(value, error). A batch that raises is tried again row by row to find the bad rows.
    """
    @F.pandas_udf(f"value {returns}, error string")
    def guarded(*columns: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": value(*columns), "error": None})
        except Exception:
            out, errors = [], []
            for i in range(len(columns[0])):
                try:
                    out.append(value(*[c.iloc[i:i + 1] for c in columns]).iloc[0])
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            return pd.DataFrame({"value": pd.Series(out, dtype=object), "error": errors})

    return guarded(*inputs)


def enrich(articles: DataFrame, enrichers: Sequence[Enricher] | None = None, summaries: bool = False) -> DataFrame:
    """Run the enrichers in order. An `isolated` one leaves its failures in `errors`."""
    rows, guarded = articles, []
    for name, step in standard_enrichers() if enrichers is None else enrichers:
        if callable(step) and not isinstance(step, Column):
            rows = step(rows)
            continue
        rows = rows.withColumn(name, step)
        kind = rows.schema[name].dataType
        if hasattr(kind, "fieldNames") and kind.fieldNames() == ["value", "error"]:
            guarded.append(name)
    if "sentiment" in rows.columns and "sentiment" not in articles.columns:
        rows = rows.withColumns({
            "sentiment_label": F.col("sentiment.label"), "sentiment_score": F.col("sentiment.score"),
        }).drop("sentiment")
    notes = [F.when(F.col(f"{n}.error").isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"{n}.error"))) for n in guarded]
    rows = rows.withColumn("errors", F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>"))
    rows = rows.withColumns({n: F.col(f"{n}.value") for n in guarded}) if guarded else rows
    made = extractive_summary(F.col("content")) if summaries else F.lit(None).cast("string")
    return rows.withColumn("generated_summary", made)
