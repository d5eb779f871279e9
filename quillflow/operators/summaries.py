"""Extractive summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import extractive_summary
from ..lexicons import SUMMARY_STOP_WORDS


def summarize_extractive(
    articles: DataFrame, body: str = "body", stop_words: Sequence[str] = tuple(SUMMARY_STOP_WORDS), keep: int = 3
) -> DataFrame:
    """(id, generated_summary) for every article long enough to have one; no shuffle.

    The generator keeps the null test behind the summary: as a plain filter it would be pushed
    down and every summary made twice.
    """
    made = F.array(extractive_summary(F.col(body), stop_words, keep))
    rows = articles.select("id", F.explode_outer(made).alias("generated_summary"))
    return rows.filter(F.col("generated_summary").isNotNull())
