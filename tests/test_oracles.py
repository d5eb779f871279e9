"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest
from compare import differences, oracle_connection
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from quillflow.plans.catalog import ORACLES, QUERIES

# Results that are rightly empty on so few rows.
MAY_BE_EMPTY = {"text_match", "search_ranked", "search_page", "list_filters"}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, oracle, name):
    problem = differences(spark, oracle, SMALL, name, QUERIES[name], ORACLES[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["entity", "entity_type", "total_mentions", "trend_score"]
    assert rows.count() == 10
