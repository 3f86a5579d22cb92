"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from forumlake.checks.base import CHECKS
from tests.compare import compare, connect

# At this scale a few queries rightly find nothing; larger scales cover them.
MAY_BE_EMPTY = {"bm25_stories"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, c in CHECKS.items() if c.sql))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    problem = compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert problem is None or (name in MAY_BE_EMPTY and problem == "both are empty")


@pytest.mark.parametrize("name", sorted(n for n, c in CHECKS.items() if not c.sql))
def test_runs_without_sql(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    first = entry.entry(spark)
    assert first.count() > 0
    assert first.schema == entry.entry(spark).schema
