"""Ordered access paths: the same pages as a scan, out of a few ranges."""

from datetime import datetime, timedelta
from random import Random

import pytest

from forumlake.functions.requests import SearchFilters
from forumlake.plans import access as paths
from forumlake.plans.lake import Lake
from forumlake.plans.search import search, search_flags, typeahead, user_items
from forumlake.schema import ITEM_COLUMNS, ITEM_TYPES, ITEMS
from forumlake.sources.items import read_items, write_items

AS_OF = datetime(2024, 1, 11)
SEARCHES = [
    SearchFilters(),
    SearchFilters(sort="score"),
    SearchFilters(sort="score", page=3),
    SearchFilters(type="comment"),
    SearchFilters(type="comment", page=9),
    SearchFilters(type="all"),
    SearchFilters(type="poll", since="week"),
    SearchFilters(type="story", since="24h", sort="score"),
    SearchFilters(by="u1"),
    SearchFilters(by="u1", type="comment", page=2),
    SearchFilters(by="u0", type="all", sort="score"),
    SearchFilters(by="nobody"),
    SearchFilters(q="T", type="all"),
    SearchFilters(q="é"),
    SearchFilters(q="u1", sort="score", type="job"),
    SearchFilters(q="%", type="all"),
    SearchFilters(q="İx", type="all"),
    SearchFilters(q="t", by="u0", type="all"),
    SearchFilters(page=400),
]


def made(n, seed, first=0):
    """Rows with a hot author, a hot time, missing values and odd titles."""
    draw = Random(seed)
    for i in range(first, first + n):
        yield {
            "id": i,
            "deleted": draw.random() < 0.05,
            "dead": draw.random() < 0.05,
            "type": draw.choice(("comment", "comment", "comment", *ITEM_TYPES)),
            "by": draw.choice((None, "", "u0", "u0", "u0", "u0", f"u{draw.randrange(9)}", "é")),
            "time": draw.choice((None, AS_OF - timedelta(days=2), AS_OF - timedelta(minutes=draw.randrange(30_000)))),
            "text": f"text {i}",
            "score": draw.choice((None, 5, draw.randrange(100))),
            "title": draw.choice((None, "", "Tea", "t", "Été", "İx y", "%a", "u1 too")),
            "kids": [],
            "parts": [],
        }


def items_of(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in ITEM_COLUMNS) for r in rows], ITEMS)


def lakes(spark, items, access):
    def nothing():
        raise AssertionError("not needed")

    return Lake(items, nothing, nothing), Lake(items, nothing, nothing, access=lambda: access)


def assert_same_pages(plain, ordered, searches=SEARCHES):
    for f in searches:
        assert search(ordered, f, AS_OF).collect() == search(plain, f, AS_OF).collect(), f
    for f in searches[:6:2]:
        assert search_flags(ordered, f, AS_OF).collect() == search_flags(plain, f, AS_OF).collect(), f
    for term in ("t", "U1", "é", "zz", "", "İx"):
        if len(term.lower()) <= 2:
            assert typeahead(ordered, term).collect() == typeahead(plain, term).collect(), term
    for author, page in (("u0", 1), ("u0", 12), ("u3", 1), ("é", 1), ("nobody", 1)):
        assert user_items(ordered.items, author, page, ordered.access).collect() == user_items(plain.items, author, page).collect(), author


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("access"))
    write_items(items_of(spark, made(3_000, 1)), f"{path}/items")
    items = read_items(spark, f"{path}/items")
    paths.build_access(items, f"{path}/access", 40)
    return path, items


def test_pages_equal_those_of_a_scan(spark, stored):
    path, items = stored
    assert_same_pages(*lakes(spark, items, paths.open_access(spark, f"{path}/access")))


def test_a_page_opens_a_few_ranges(spark, stored):
    path, _ = stored
    access = paths.open_access(spark, f"{path}/access")
    assert all(len(bounds) > 40 for bounds in access.bounds.values())

    assert len(access.ranges("time", ["comment"], 30, lambda b: b["n"])) <= 3
    for f in (SearchFilters(type="comment"), SearchFilters(type="comment", sort="score"), SearchFilters(by="u0", type="all")):
        ranges = access.ranges(paths.layout_of(f), paths.keys_of(f), 30, lambda b: b["n"])
        assert 1 <= len(ranges) <= 15
        plan = access.rows(f, AS_OF, 30)._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan" in line)
        assert "range" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "text:" not in scan
    hot = access.ranges("author", ["u0"], 30, lambda b: b["n"])
    assert len(hot) <= 3 and len(access.ranges("author", ["u0"], None, lambda b: b["n"])) > 20


def test_changes_show_at_once(spark, stored, tmp_path):
    _, items = stored
    access = paths.build_access(items, str(tmp_path / "access"), 40)
    first, second = list(made(60, 2, first=2_950)), list(made(30, 3, first=2_990))
    for batch, rows in ((0, first), (1, second), (1, second)):
        access.record(items_of(spark, rows), batch)
    changed = {r["id"]: r for r in (*first, *second)}
    after = items_of(spark, [*[r for r in made(3_000, 1) if r["id"] not in changed], *changed.values()])
    fresh = paths.open_access(spark, str(tmp_path / "access"))
    assert fresh.changed == 70
    assert_same_pages(*lakes(spark, after, fresh), SEARCHES[1::3])
    folded = paths.build_access(after, str(tmp_path / "folded"), 40)
    assert folded.changed == 0
    assert search(lakes(spark, after, folded)[1], SEARCHES[0], AS_OF).collect() == search(lakes(spark, after, fresh)[0], SEARCHES[0], AS_OF).collect()


def test_an_empty_table_has_empty_pages(spark, tmp_path):
    items = items_of(spark, [])
    access = paths.build_access(items, str(tmp_path / "access"))
    ordered = lakes(spark, items, access)[1]
    for f in SEARCHES[:13:4]:
        assert search(ordered, f, AS_OF).count() == 0
    assert typeahead(ordered, "t").count() == 0 and user_items(items, "u0", 1, access).count() == 0


def test_small_ranges_stay_few(spark, tmp_path):
    items = spark.createDataFrame(made(400, 5), ITEMS)
    access = paths.build_access(items, str(tmp_path / "access"), 2)
    assert all(1 < len(bounds) <= paths.FEW_RANGES for bounds in access.bounds.values())
    assert [paths.ranges_for(n, 2_000) for n in (0, 1, 90_000, 10**7, 10**10)] == [1, 1, 45, 200, paths.MOST_RANGES]
    assert [paths.ranges_for(n) for n in (10**5, 10**7)] == [2, 200]
