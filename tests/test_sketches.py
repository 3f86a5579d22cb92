"""Counts from theta sketches: exact while small, within their bounds beyond."""

import pytest

from forumlake.checks.text import two_word_queries
from forumlake.plans.batch import batch_matches
from forumlake.plans.lake import lake_of
from forumlake.plans.sketches import build_sketches, estimate_counts

QUERIES = [
    ("and", "the and", "comment"),
    ("or", "der or the", "all"),
    ("not", "the -with", "comment"),
    ("group", "the -with or la -de", "all"),
    ("exclusions", "-the -la", "story"),
    ("mixed", "la or -the", "comment"),
    ("unknown", "the zzzzzz", "comment"),
    ("unknown or", "zzzzzz or the", "comment"),
    ("not unknown", "the -zzzzzz", "all"),
    ("only unknown", "-zzzzzz", "poll"),
    ("again", "the the", "comment"),
    ("nothing", "", "comment"),
]


@pytest.fixture(scope="module")
def lake(spark, sf_dir):
    return lake_of(spark, sf_dir, "simple")


def exact_counts(lake, queries, operators=True):
    found = {r["qid"]: r["count"] for r in batch_matches(lake, queries, operators).groupBy("qid").count().collect()}
    return {r["qid"]: found.get(r["qid"], 0) for r in queries.collect()}


def test_small_sketches_are_exact(spark, lake, tmp_path):
    queries = spark.createDataFrame(QUERIES, "qid string, q string, type string")
    sketches = build_sketches(lake.index, lake.items, str(tmp_path / "sketches"))
    assert sketches.terms.count() == 0  # no word is in 4,096 rows here
    got = {r["qid"]: (r["estimate"], r["low"], r["high"]) for r in estimate_counts(sketches, queries).collect()}
    assert got == {qid: (n, n, n) for qid, n in exact_counts(lake, queries).items()}


def test_bounds_hold_for_two_words(spark, sf_dir, lake, tmp_path):
    """Sketches of 32 ids stand in for those of large tables."""
    queries = two_word_queries(spark, sf_dir)
    sketches = build_sketches(lake.index, lake.items, str(tmp_path / "sketches"), log_size=5)
    assert sketches.terms.count() > 20
    exact = exact_counts(lake, queries, operators=False)
    rows = estimate_counts(sketches, queries, operators=False).collect()
    assert {r["qid"] for r in rows} == set(exact) and len(rows) > 300
    inside = sum(r["low"] <= exact[r["qid"]] <= r["high"] for r in rows)
    assert inside >= 0.95 * len(rows)
    assert any(r["low"] < r["high"] for r in rows)
    assert sum(r["high"] - r["low"] for r in rows) < 3 * sum(exact.values())
