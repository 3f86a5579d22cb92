"""The stream: restarts, replays, and a search index that follows the items."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from forumlake.operators.postings import corpus_stats, postings, term_stats
from forumlake.operators.merge import upsert
from forumlake.plans import index as indexes
from forumlake.plans.index import add_generation, build_index, compact, is_committed, last_batches, open_index
from forumlake.plans.lake import Lake
from forumlake.plans.search import text_matches
from forumlake.operators.match import analyse_query
from forumlake.schema import ITEM_COLUMNS, ITEMS
from forumlake.sources.items import read_items, write_items
from forumlake.streaming.feed_sync import apply_batch, rows_before, sync_stream
from forumlake.operators.clean import clean_feed
from forumlake.plans.sync import latest_versions
from forumlake.sources.feed import read_feed


def start_items(spark):
    base = {"deleted": False, "dead": False, "kids": [], "parts": []}
    given = [
        {"id": 1, "type": "story", "title": "red fish", "by": "ann"},
        {"id": 2, "type": "comment", "text": "blue fish <i>swim</i>", "parent": 1},
        {"id": 3, "type": "comment", "text": "red red wine", "parent": 1},
        {"id": 2_000_001, "type": "job", "title": "fish market"},
    ]
    return spark.createDataFrame([tuple({**base, **g}.get(c) for c in ITEM_COLUMNS) for g in given], ITEMS)


def put(folder, name, *rows, at=None):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    if at:
        os.utime(folder / name, (at, at))


def index_content(index):
    posts = sorted((r["id"], r["type"], r["live"], r["term"], r["tf"], r["dl"], tuple(r["positions"])) for r in index.postings().collect())
    terms = sorted((r["scope"], r["term"], r["df"]) for r in index.term_stats().collect())
    corpus = sorted((r["scope"], r["n"], r["total_dl"]) for r in index.corpus_stats().collect() if r["n"])
    return posts, terms, corpus


def rebuilt(items, config):
    posts = postings(items, config)
    rows = sorted((r["id"], r["type"], r["live"], r["term"], r["tf"], r["dl"], tuple(r["positions"])) for r in posts.collect())
    terms = sorted((r["scope"], r["term"], r["df"]) for r in term_stats(posts).collect())
    corpus = sorted((r["scope"], r["n"], r["total_dl"]) for r in corpus_stats(items, posts).collect() if r["n"])
    return rows, terms, corpus


@pytest.mark.parametrize("config", ["simple", "english"])
def test_stream_keeps_items_and_index_in_step(spark, tmp_path, config):
    items, index, feed, check = (str(tmp_path / n) for n in ("items", "index", "feed", "check"))
    write_items(start_items(spark), items)
    build_index(read_items(spark, items), index, 0, config)
    put(tmp_path / "feed", "a.json", {"id": 2, "type": "comment", "text": "green fish", "parent": 1}, {"id": 4, "type": "story", "title": "new fishing"}, at=1_000)
    put(tmp_path / "feed", "b.json", {"id": 2, "type": "comment", "text": "yellow submarine", "dead": True}, {"id": 7, "type": "odd"}, None, at=2_000)

    def run():
        sync_stream(spark, feed, items, check, index, str(tmp_path / "rejected"), files_per_trigger=1).awaitTermination()

    run()
    got = {r["id"]: (r["text"], r["title"], r["dead"]) for r in read_items(spark, items).collect()}
    assert got[2] == ("yellow submarine", None, True) and got[4][1] == "new fishing" and set(got) == {1, 2, 3, 4, 2_000_001}
    assert index_content(open_index(spark, index)) == rebuilt(read_items(spark, items), config)

    # Started again, only the new file is worked off.
    put(tmp_path / "feed", "c.json", {"id": 1, "type": "story", "title": "red herring"}, {"id": 3, "type": "comment", "deleted": True}, at=3_000)
    run()
    assert len(open_index(spark, index).generations) == 4
    assert index_content(open_index(spark, index)) == rebuilt(read_items(spark, items), config)
    assert spark.read.parquet(str(tmp_path / "rejected")).select("id", "reject_reason").collect() == [(7, "unknown type")]

    # Searches see the changes at once, and a compacted index answers alike.
    lake = Lake(read_items(spark, items), lambda: open_index(spark, index), None)
    smaller = compact(lake.index, str(tmp_path / "compact"))
    for q in ("red -fish", "fishing", "fish or wine", '"red herring"'):
        query = analyse_query(spark, q, config)
        ours = {r["id"]: r["bm25"] for r in text_matches(lake, query, "all").collect()}
        theirs = {r["id"]: r["bm25"] for r in text_matches(Lake(lake.items, lambda: smaller, None), query, "all").collect()}
        assert set(ours) == set(theirs) and all(math.isclose(ours[i], theirs[i]) for i in ours)
    assert {r["id"] for r in text_matches(lake, analyse_query(spark, '"red herring"', config), "all").collect()} == {1}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    items, index = str(tmp_path / "items"), str(tmp_path / "index")
    write_items(start_items(spark), items)
    build_index(read_items(spark, items), index, 0, "simple")
    put(tmp_path / "feed", "a.json", {"id": 2, "type": "comment", "text": "green fish", "parent": 1}, {"id": 9, "type": "job", "title": "x"})
    batch = read_feed(spark, str(tmp_path / "feed"))
    work = apply_batch(items, index)
    work(batch, 0)
    first = index_content(open_index(spark, index)), sorted(read_items(spark, items).collect())
    work(batch, 0)
    assert (index_content(open_index(spark, index)), sorted(read_items(spark, items).collect())) == first
    assert first[0] == rebuilt(read_items(spark, items), "simple")


def test_sources_fold_to_the_last_batch_of_each_stream():
    names = ("build", "a#0", "a#10", "a#9", "/check#2#3", "odd#x")
    assert last_batches(names) == ["/check#2#3", "a#10", "build", "odd#x"]
    for name, known in (("a#10", True), ("a#7", True), ("a#11", False), ("b#0", False), ("/check#2#2", True), ("/check#4", False), ("build", True), ("odd#x", True)):
        assert is_committed(name, tuple(last_batches(names))) == known == is_committed(name, names)


@pytest.mark.parametrize("most", [0, 100_000])
def test_compacted_index_follows_on(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(indexes, "BROADCAST_ROWS", most)
    index = build_index(start_items(spark), str(tmp_path / "index"), 0, "simple")
    items = start_items(spark)
    for batch in range(3):
        put(tmp_path / "feed", f"{batch}.json", {"id": 2, "type": "comment", "text": f"green fish {batch}"}, {"id": 9 + batch, "type": "job", "title": "x"})
        changes = clean_feed(latest_versions(read_feed(spark, str(tmp_path / "feed" / f"{batch}.json")))).select(*ITEM_COLUMNS)
        index = add_generation(index, items.join(changes.select("id"), "id", "left_semi").select(*ITEM_COLUMNS), changes, f"feed#{batch}")
        items = upsert(items, changes)
    assert index.retired == 6 and len(index.generations) == 4
    plan = index.postings(["fish"])._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(most)
    assert index_content(index) == rebuilt(items, "simple")
    small = compact(index, str(tmp_path / "small"))
    assert small.sources == ("build", "feed#2") and small.retired == 0
    assert add_generation(small, items.limit(0), items.limit(0), "feed#1").generations == (0,)
    assert index_content(small) == rebuilt(items, "simple")


def test_compaction_leaves_the_first_generation_in_its_folders(spark, tmp_path, monkeypatch):
    items = start_items(spark)
    index = build_index(items, str(tmp_path / "index"), 0, "simple")
    put(tmp_path / "feed", "a.json", {"id": 2, "type": "comment", "text": "green fish"}, {"id": 9, "type": "job", "title": "x"})
    changes = clean_feed(latest_versions(read_feed(spark, str(tmp_path / "feed")))).select(*ITEM_COLUMNS)
    index = add_generation(index, items.join(changes.select("id"), "id", "left_semi").select(*ITEM_COLUMNS), changes, "feed#0")
    shuffled, hint = [], type(items).hint
    monkeypatch.setattr(type(items), "hint", lambda df, name, *keys: shuffled.append((name, "positions" in df.columns and {r["id"] for r in df.collect()})) or hint(df, name, *keys))
    small = compact(index, str(tmp_path / "small"))
    assert ("rebalance", {2, 9}) in shuffled and all(not ids or ids == {2, 9} for _, ids in shuffled)
    monkeypatch.undo()
    assert index_content(small) == rebuilt(upsert(items, changes), "simple")


def test_crash_between_index_and_items_is_repaired(spark, tmp_path):
    items, index = str(tmp_path / "items"), str(tmp_path / "index")
    write_items(start_items(spark), items)
    build_index(read_items(spark, items), index, 0, "simple")
    put(tmp_path / "feed", "a.json", {"id": 3, "type": "comment", "text": "white wine"})
    batch = read_feed(spark, str(tmp_path / "feed"))
    changes = clean_feed(latest_versions(batch)).select(*ITEM_COLUMNS)
    add_generation(open_index(spark, index), rows_before(spark, items, changes), changes, "feed#0")  # and then the run dies
    apply_batch(items, index)(batch, 0)
    assert index_content(open_index(spark, index)) == rebuilt(read_items(spark, items), "simple")
    assert read_items(spark, items).filter("id = 3").select(F.col("text")).first()[0] == "white wine"


def test_late_files_change_nothing(spark, tmp_path):
    """Within the horizon the file written last wins, whenever it comes; older files are left out."""
    items, feed, check = (str(tmp_path / n) for n in ("items", "feed", "check"))
    write_items(start_items(spark), items)

    def run():
        sync_stream(spark, feed, items, check, rejected_path=str(tmp_path / "rejected"), files_per_trigger=1, horizon="100 seconds").awaitTermination()
        return {r["id"]: r["title"] for r in read_items(spark, items).collect()}

    start = 1_700_000_000
    put(tmp_path / "feed", "b c.json", {"id": 1, "type": "story", "title": "second"}, {"id": 5, "type": "story", "title": "five"}, at=start + 50)
    assert run()[1] == "second"
    put(tmp_path / "feed", "a.json", {"id": 1, "type": "story", "title": "first"}, {"id": 6, "type": "story", "title": "six"}, at=start)
    put(tmp_path / "feed", "z.json", {"id": 5, "type": "story", "title": "five again"}, {"id": 5, "type": "odd"}, at=start + 49)
    got = run()
    assert (got[1], got[5], got[6]) == ("second", "five", "six")
    put(tmp_path / "feed", "d.json", {"id": 1, "type": "story", "title": "third"}, {"type": "story", "title": "no id"}, at=start + 400)
    assert run()[1] == "third"
    put(tmp_path / "feed", "e.json", {"id": 5, "type": "story", "title": "too late"}, at=start + 60)
    got = run()
    assert (got[1], got[5]) == ("third", "five")
    put(tmp_path / "feed", "f.json", {"id": 5, "type": "story", "title": "sixth"}, at=start + 401)
    assert run()[5] == "sixth"
    assert [r["title"] for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == ["no id"]
