from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillflow.operators import articles as A
from quillflow.operators import search
from quillflow.plans import fixtures as X
from quillflow.sources import tables


@pytest.fixture(scope="module")
def articles(spark):
    return X.articles(spark, SMALL).cache()


def test_filters_are_checked():
    with pytest.raises(ValueError):
        A.ArticleFilters(published_after=datetime(2024, 2, 1), published_before=datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        A.ArticleFilters(search=" a ")
    assert A.ArticleFilters(search=" market crash ").search == "market crash"
    assert A.ArticleFilters(keywords="  ").keywords is None


def test_keyword_wildcards_stand_for_themselves(spark):
    rows = spark.createDataFrame([("50% up",), ("50 up",)], "title string")
    assert [r.title for r in A.list_filters(rows, A.ArticleFilters(keywords="50%")).collect()] == ["50% up"]


def pages(fetch, limit, cursor_of):
    rows, cursor = [], None
    while True:
        page = fetch(cursor).collect()
        rows += page[:limit]
        if len(page) <= limit:
            return rows
        cursor = cursor_of(page[limit - 1])


def test_pages_partition_the_whole_order(articles):
    rows = articles.select("id", "published_at")
    got = pages(lambda c: A.latest_page(rows, 40, c), 40, lambda r: (r.published_at, r.id))
    assert [r.id for r in got] == [r.id for r in A.export_scan(rows).collect()]
    assert len({r.id for r in got}) == rows.count() == 200


def test_ranked_pages_partition_the_whole_order(articles):
    ranked = articles.select("id", "published_at", (F.col("id") % 5).cast("double").alias("rank"))
    got = pages(lambda c: A.search_page(ranked, 60, c), 60, lambda r: (r.rank, r.published_at, r.id))
    assert len({r.id for r in got}) == len(got) == 200
    assert [r.rank for r in got] == sorted((r.rank for r in got), reverse=True)


def test_export_refuses_and_never_cuts(spark, articles, tmp_path):
    with pytest.raises(ValueError):
        tables.export_csv(articles, str(tmp_path / "none"), max_rows=10)
    tables.export_csv(articles, str(tmp_path / "all"), max_rows=10_000)
    text = spark.read.text(str(tmp_path / "all"))
    assert text.filter(F.col("value") == ",".join(A.EXPORT_COLUMNS)).count() >= 1


def test_export_of_nulls(spark):
    rows = spark.createDataFrame(
        [("1", "T", "S", datetime(2024, 1, 1, 10, 0, 0, 5000), "a", "s", "u"), ("2", "T", "S", None, None, None, None)],
        "id string, title string, source_name string, published_at timestamp, author string, summary string, url string")
    got = [tuple(r) for r in A.export_rows(rows).collect()]
    assert got == [("1", "T", "S", "2024-01-01T10:00:00.005000+00:00", "a", "s", "u"), ("2", "T", "S", "", "", "", "")]


def test_list_reads_are_narrow(spark, articles, tmp_path):
    articles.write.parquet(str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    rows = A.list_filters(stored, A.ArticleFilters(source_names=["src1"], published_after=datetime(2024, 1, 3)))
    plan = A.latest_page(A.list_projection(rows), 10)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(source_name)" in plan and "GreaterThanOrEqual(p" in plan


def test_search_terms():
    assert search.search_terms('alpha "state of india" or -"x y" beta') == [
        [(True, ["alpha"]), (True, ["state", None, "india"])], [(False, ["x", "y"]), (True, ["beta"])]]
    assert search.search_terms("the of") == []


TEXTS = [
    (1, "market crash hits the State Bank of India"), (2, "crash market"), (3, "state bank in india"), (4, "Markets rally"),
    (5, "é market-crash é")]


@pytest.mark.parametrize("words, hits", [
    ("market crash", {1, 2, 5}), ('"market crash"', {1, 5}), ("market -crash", set()), ("rally or crash", {1, 2, 4, 5}),
    ('"bank of india"', {1, 3}), ("crash -bank", {2, 5}), ("the", set()), ("market -\"market crash\"", {2})])
def test_predicate_and_postings_agree(spark, tmp_path, words, hits):
    rows = spark.createDataFrame(TEXTS, "id int, body string").withColumns({"title": F.lit(None).cast("string"), "summary": F.lit("")})
    text = F.concat_ws(" ", "title", "summary", "body")
    assert {r.id for r in rows.filter(search.text_match(words, text)).collect()} == hits
    search.write_postings(search.build_postings(rows), str(tmp_path / "p"))
    found = search.search_ranked(
        rows, search.read_postings(spark, str(tmp_path / "p"), words), search.corpus_stats(rows), words)
    assert {r.id for r in found.collect()} == hits


def test_postings_read_only_the_buckets_of_the_search(spark, articles, tmp_path):
    search.write_postings(search.build_postings(articles), str(tmp_path / "p"))
    plan = search.read_postings(spark, str(tmp_path / "p"), "haus")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan
