import pytest
from pyspark.sql import functions as F

from forumlake.operators import joins, ordering, threads, tour
from forumlake.operators.projections import THREAD
from forumlake.plans.lake import build_edges
from forumlake.schema import ITEMS
from forumlake.session import fresh_path

CHAIN = 150


def items_of(spark, edges):
    df = spark.createDataFrame(edges, "id bigint, parent bigint")
    values = {"deleted": F.col("id") % 7 == 0, "dead": F.lit(False), "type": F.lit("comment")}
    return df.select([values.get(f.name, F.lit(None) if f.name not in ("id", "parent") else F.col(f.name)).cast(f.dataType).alias(f.name) for f in ITEMS])


@pytest.fixture(scope="module")
def forest(spark):
    edges = [(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (6, None), (7, 999), (8, 7)]
    edges += [(20, 21), (21, 20), (22, 21), (30, 30), (31, 30)]  # a cycle of two, a self-parent, and rows below them
    edges += [(1000 + i, 1000 + i - 1 if i else None) for i in range(CHAIN)]
    edges += [(5000, None)] + [(5000 + i, 5000) for i in range(1, 3001)]
    return edges, items_of(spark, edges).cache()


def walk(edges, root):
    below = {}
    for i, p in edges:
        below.setdefault(p, []).append(i)
    out, level = {root: (0, (root,))}, [root]
    while level:
        nxt = []
        for parent in level:
            for child in sorted(below.get(parent, [])):
                if child not in out:
                    depth, path = out[parent]
                    out[child] = (depth + 1, (*path, child))
                    nxt.append(child)
        level = nxt
    return out


@pytest.mark.parametrize("root", [1, 4, 6, 7, 20, 30, 1000, 5000])
def test_thread(spark, forest, root):
    edges, items = forest
    got = {r["id"]: (r["depth"], tuple(r["path"])) for r in threads.thread(items, root).collect()}
    assert got == walk(edges, root)


def test_thread_of_a_missing_root_is_empty(spark, forest):
    assert threads.thread(forest[1], 999).count() == 0


def test_thread_through_stored_edges_and_without_paths(spark, forest):
    edges, items = forest
    stored = build_edges(items, fresh_path(spark, "edges"))
    for root in (1, 5000):
        rows = threads.thread(items, root, stored, with_path=False)
        assert rows.columns == [*THREAD, "depth"]
        assert {r["id"]: r["depth"] for r in rows.collect()} == {k: d for k, (d, _) in walk(edges, root).items()}


def test_large_levels_are_joined(spark, forest, monkeypatch):
    edges, items = forest
    monkeypatch.setattr(threads, "LITERAL_IDS", 2)
    monkeypatch.setattr(threads, "join_small", lambda *a, **k: joins.join_small(*a, max_rows=0, **k))
    for root in (1, 5000):
        got = {r["id"]: (r["depth"], tuple(r["path"])) for r in threads.thread(items, root).collect()}
        assert got == walk(edges, root)


@pytest.mark.parametrize(("name", "value"), [("SMALL_THREAD", 3), ("SMALL_PATHS", 6), ("LITERAL_IDS", 1)])
def test_threads_past_a_bound_go_on_in_tables(spark, forest, monkeypatch, name, value):
    edges, items = forest
    monkeypatch.setattr(threads, name, value)
    got = {r["id"]: (r["depth"], tuple(r["path"])) for r in threads.thread(items, 1).collect()}
    assert got == walk(edges, 1)


def expected_roots(edges):
    parent, out = dict(edges), {}
    for i in parent:
        seen, at = {i}, i
        while parent[at] is not None and parent[at] in parent:
            at = parent[at]
            if at in seen:
                at = None
                break
            seen.add(at)
        out[i] = (at, len(seen) - 1) if at is not None else (None, None)
    return out


@pytest.mark.parametrize("hot_rows", [100_000, 50])
def test_roots(spark, forest, monkeypatch, hot_rows):
    """With a low threshold the 3,000 children of one item take the hot path."""
    edges, items = forest
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    got = {r["id"]: (r["root"], r["depth"]) for r in threads.roots(items).collect()}
    assert got == expected_roots(edges)


def test_every_thread_agrees_with_roots(spark, forest):
    edges, items = forest
    sizes = {r["root"]: (r["items"], r["max_depth"]) for r in threads.thread_sizes(threads.roots(items)).collect()}
    for root in (1, 6, 1000, 5000):
        below = walk(edges, root)
        assert sizes[root] == (len(below), max(d for d, _ in below.values()))


def test_children_are_numbered_across_blocks(spark, forest):
    edges, items = forest
    children = items.filter("parent IS NOT NULL").select("parent", "id")
    got = sorted((r["parent"], r["position"], r["id"]) for r in ordering.grouped_positions(children, "parent", width=64).collect())
    expected = []
    for parent in {p for _, p in edges if p is not None}:
        expected += [(parent, n, i) for n, i in enumerate(sorted(i for i, p in edges if p == parent), 1)]
    assert got == sorted(expected)


def test_display_masks_deleted_rows(spark, forest):
    rows = threads.display_thread(threads.thread(forest[1], 5000)).collect()
    assert {r["body"] for r in rows if r["id"] % 7 == 0} == {"[deleted]"}
    assert {r["author"] for r in rows} == {"deleted"}


def expected_order(edges):
    known = {i for i, _ in edges}
    out = {}
    for root in (i for i, p in edges if p is None or p not in known):
        below = walk(edges, root)
        rows = sorted(below.items(), key=lambda r: r[1][1])
        for place, (i, (depth, path)) in enumerate(rows):
            out[i] = (root, place, place + sum(p[: len(path)] == path for _, p in below.values()) - 1, depth)
    return {i: out.get(i, (None,) * 4) for i, _ in edges}


@pytest.mark.parametrize("block", [1_000_000, 64])
def test_order_of_every_thread(spark, forest, monkeypatch, block):
    """Cycles and rows below them get NULLs, a missing parent makes a root, a chain is as deep as it is long."""
    monkeypatch.setattr(tour, "BLOCK", block)
    edges, items = forest
    got = {r["id"]: (r["root"], r["place"], r["last"], r["depth"]) for r in tour.thread_order(items).collect()}
    assert got == expected_order(edges)


def test_order_of_a_long_chain_and_of_nothing(spark):
    items = items_of(spark, [(i, i - 1 if i else None) for i in range(10_000)])
    got = tour.thread_order(items).filter("root <> 0 OR place <> id OR last <> 9999 OR depth <> id").count()
    assert got == 0 and tour.thread_order(items).count() == 10_000
    assert tour.thread_order(items.limit(0)).count() == 0


def test_a_stored_thread_is_one_range(spark, forest):
    edges, items = forest
    order = tour.build_order(items, fresh_path(spark, "order"))
    for root in (1, 4, 6, 7, 1000, 5000):
        rows = tour.with_paths(tour.thread_rows(items, order, root)).orderBy("place").collect()
        assert {r["id"]: (r["depth"], tuple(r["path"])) for r in rows} == walk(edges, root)
        assert [tuple(r["path"]) for r in rows] == sorted(tuple(r["path"]) for r in rows)
    assert tour.thread_rows(items, order, 20).count() == tour.thread_rows(items, order, 999).count() == 0
    text = order.below(4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "root_bucket" in text.split("PartitionFilters")[1] and "EqualTo(root,1)" in text
