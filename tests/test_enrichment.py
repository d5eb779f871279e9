import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillflow.functions import enrichment as E
from quillflow.functions.words import extractive_summary
from quillflow.lexicons import KEYWORD_STOP_WORDS, SUMMARY_STOP_WORDS
from quillflow.operators import enrich as N
from quillflow.operators.maintenance import child_rows

NEWS = ("HDFC Bank and hdfc bank up; L&T, rbi, Reserve Bank of India on nifty 50, nifty, NIFTY IT",
        "Dollar rally! Shares surge to record high as TCS tech beats; upgraded profit market market naïve")


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(1, *NEWS), (2, "", ""), (3, None, None), (4, "crash fall fraud", "Fall"), (5, "up up", None)]
    return spark.createDataFrame(rows, "id int, title string, content string")


def test_entities(articles):
    found = E.entities(E.article_text(F.col("title"), F.col("content")))
    got = {r.id: {(e.entity, e.entity_type) for e in r.e} for r in articles.select("id", found.alias("e")).collect()}
    assert got[1] == {
        ("Hdfc Bank", "Company"), ("L&T", "Company"), ("TCS", "Company"), ("RBI", "Regulator"),
        ("RESERVE BANK OF INDIA", "Regulator"), ("Nifty 50", "Index"), ("Nifty", "Index"), ("Nifty It", "Index"),
        ("Dollar", "Currency")}
    assert got[2] == got[3] == set()


def test_sectors(articles):
    found = E.sectors(E.article_text(F.col("title"), F.col("content")))
    got = {r.id: [(s.sector, s.score) for s in r.s] for r in articles.select("id", found.alias("s")).collect()}
    # hdfc, bank twice, rbi, bank = 6; nifty three times, shares = 4; tcs, tech = 2
    assert got[1] == [("Banking", 6.0), ("Markets", 4.0), ("IT", 2.0)]
    assert got[2] == []


def test_sentiment(articles):
    mood = E.sentiment(F.col("title"), F.col("content"))
    got = {r.id: (r.m.label, r.m.score) for r in articles.select("id", mood.alias("m")).collect()}
    assert got[1] == ("positive", 1.0)
    assert got[2] == got[3] == ("neutral", 0.0)
    assert got[4] == ("negative", -1.0)
    assert got[5] == ("positive", 0.4)


def top_words(text, stops, keep=5):
    counts = Counter(w for w in re.findall(r"\b[a-zA-Z]{3,}\b", text.lower()) if w not in stops)
    best = counts.most_common(keep)
    return [(w, round(n / best[0][1], 4)) for w, n in best]


def summary(text):
    if len(text) < 200:
        return None
    sentences = [s.strip() for s in re.findall(r"([^.!?]+[.!?]+)", text) if len(s.strip()) > 20]
    if len(sentences) <= 3:
        return None
    words = lambda t: re.findall(r"\b[a-zA-Z]{3,}\b", t.lower())
    counts = Counter(w for w in words(text) if w not in set(SUMMARY_STOP_WORDS))
    scores = []
    for i, s in enumerate(sentences):
        n = len(words(s))
        scores.append(sum(counts.get(w, 0) for w in words(s)) * (0.5 if n > 30 or n < 5 else 1) * (1.5 if i == 0 else 1))
    best = sorted(sorted(range(len(sentences)), key=lambda i: -scores[i])[:3])
    made = " ".join(sentences[i] for i in best)
    return made if len(made) <= 1000 else made[:997] + "..."


def test_keywords_and_summaries_equal_plain_python(spark):
    from conftest import SMALL

    from quillflow.plans import fixtures as X

    rows = X.articles(spark, SMALL).select(
        "id", "body", E.keywords(F.col("body")).alias("k"), extractive_summary(F.col("body")).alias("s")).collect()
    assert len(rows) == 200
    for r in rows:
        assert [(k.keyword, k.weight) for k in r.k] == top_words(r.body, set(KEYWORD_STOP_WORDS))
        assert r.s == summary(r.body)


def test_whole_text_is_read_unless_bounded(spark):
    row = spark.createDataFrame([("t", "x " * 60000 + "sensex")], "title string, content string")
    full = E.sectors(E.article_text(F.col("title"), F.col("content")))
    cut = E.sectors(E.article_text(F.col("title"), F.col("content"), 100_000))
    got = row.select(F.size(full), F.size(cut)).first()
    assert tuple(got) == (1, 0)


def test_child_rows_settle_keys_that_are_equal_after_cutting(spark):
    long = "a" * 120
    rows = spark.createDataFrame([(1, [(long + "x", 1.0), (long + "y", 0.5), ("b", 0.1)])],
                                 "id int, keywords array<struct<keyword:string,weight:double>>")
    got = [(r.article_id, r.keyword, r.weight) for r in child_rows(rows, "keywords").collect()]
    assert got == [(1, "a" * 100, 1.0), (1, "b", 0.1)]


def test_a_failing_enricher_fails_alone(articles):
    steps = N.register_enricher(
        N.standard_enrichers(), "length", N.isolated(lambda s: s.map(len).astype("int64"), "bigint", F.col("title")))
    got = {r.id: r for r in N.enrich(articles, steps).collect()}
    assert got[1].length == len(NEWS[0]) and got[1].errors == []
    assert got[3].length is None and got[3].errors[0].startswith("length: TypeError")
    assert got[3].sentiment_label == "neutral" and got[1].entities
    with pytest.raises(ValueError):
        N.register_enricher(steps, "length", F.lit(1))
