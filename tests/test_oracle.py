"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""
import pytest
from compare import difference
from conftest import DATA

from evidloom.plans.registry import ORACLE, QUERIES

# Results that are empty on the smallest tables.
MAY_BE_EMPTY = {"uncovered_topics", "fallback_candidates"}


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_equals_sql(spark, name):
    diff = difference(spark, DATA, QUERIES[name], ORACLE[name])
    assert diff == "" or (name in MAY_BE_EMPTY and diff == "both sides are empty")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
