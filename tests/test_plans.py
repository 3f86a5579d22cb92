"""What the plans must look like, whatever the data."""

from datetime import datetime

import pytest

import __spark_entry__ as entry
from forumlake.checks.base import CHECKS
from forumlake.functions.requests import SAVED_SEARCHES, SearchFilters
from forumlake.plans.lake import lake_of
from forumlake.plans.search import page_ids, search
from forumlake.session import work_dir

AS_OF = datetime(2024, 1, 11)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_by_date_need_no_items(spark, sf_dir):
    """Sort keys and ages come from the postings; items are read for the page alone."""
    lake = lake_of(spark, sf_dir, "simple")
    for f in (SearchFilters(q="the and", type="comment", sort="date"), SearchFilters(q="the and", type="comment", sort="score", since="year")):
        scans = [line for line in plan(page_ids(lake, f, AS_OF)).splitlines() if "FileScan" in line]
        assert len(scans) == 1 and "tf:int" in scans[0]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_text_query_reads_only_its_terms(spark, sf_dir):
    text = plan(search(lake_of(spark, sf_dir, "simple"), SearchFilters(q="the and", type="comment"), AS_OF))
    assert "In(term, [and,the])" in text and "bucket" in text
    postings = [line for line in text.splitlines() if "FileScan" in line and "tf:int" in line]
    assert len(postings) == 1 and "type" in postings[0].split("PartitionFilters")[1] and "positions" not in postings[0].split("ReadSchema")[1]


def test_browsing_keeps_a_page_per_task_and_reads_no_text(spark, sf_dir):
    text = plan(search(lake_of(spark, sf_dir, "simple"), SAVED_SEARCHES["jobs"], AS_OF))
    assert "TakeOrderedAndProject" in text
    assert "conv_id" not in text  # only comments come from conversations


def test_batch_cuts_groups_before_the_shuffle(spark, sf_dir):
    text = plan(entry.queries()["batch_search"](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_exclusions_alone_join_no_rows_by_type(spark, sf_dir):
    """Free rows are counted by block; rows are looked up in the blocks that are opened."""
    for name in ("batch_exclusions", "batch_first_free"):
        text = plan(entry.queries()[name](spark, sf_dir))
        joins = [line for line in text.splitlines() if "Join [" in line]
        assert joins and not any("Join [type#" in line for line in joins)


def test_missing_ids_expand_gaps_alone(spark, sf_dir):
    text = plan(entry.queries()["missing_runs"](spark, sf_dir))
    assert "sequence(start" not in text and "sequence(FLOOR" in text


def test_work_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or work_dir(spark) == named.rstrip("/")


def test_request_defaults():
    f = SearchFilters.from_params({"q": "  a b ", "type": "STORY", "since": "decade", "sort": "by", "page": "x", "by": " "})
    assert f == SearchFilters(q="a b")
    pages = {"0": 1, "-1": 1, "1.5": 1, "7": 7, "": 1, "inf": 1}
    assert {p: SearchFilters.from_params({"page": p}).page for p in pages} == pages
    assert SearchFilters(q="ab").order == "date" and SearchFilters(q="abc").order == "relevance" and SearchFilters(q="abc", sort="score").order == "score"
    assert [SearchFilters(type=t).scope for t in ("story", "poll", "all")] == ["story", "all", "all"]
