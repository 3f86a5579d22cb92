"""Merges, files, cursors, windows, ledger."""

import gzip
import json
import os
import random
from datetime import datetime
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from forumlake.operators import merge
from forumlake.operators.clean import clean_dump, clean_feed, split_dump
from forumlake.plans import ledger, sync
from forumlake.schema import ITEM_COLUMNS, ITEMS
from forumlake.sources import dump, feed, items as stored, shards
from forumlake.sources import manifest as manifests


def rows_of(spark, *given):
    base = {"deleted": False, "type": "story", "dead": False, "kids": [], "parts": []}
    return spark.createDataFrame([tuple({**base, **g}.get(c) for c in ITEM_COLUMNS) for g in given], ITEMS)


def titles(df):
    return {r["id"]: r["title"] for r in df.collect()}


def test_newest_collapses_a_hot_id(spark):
    rows = spark.range(50_000).select((F.col("id") % 3).alias("id"), F.col("id").alias("n"), F.array("id").alias("kids"))
    got = sorted(tuple(r) for r in merge.newest(rows, F.col("n")).collect())
    assert got == [(0, 49_998, [49_998]), (1, 49_999, [49_999]), (2, 49_997, [49_997])]


def test_upsert_twice_is_upsert_once(spark):
    old = rows_of(spark, {"id": 1, "title": "a", "score": 5}, {"id": 2, "title": "b"})
    new = rows_of(spark, {"id": 2, "title": "c"}, {"id": 3, "title": "d"})
    once = merge.upsert(old, new)
    assert titles(once) == {1: "a", 2: "c", 3: "d"}
    assert titles(merge.upsert(once, new)) == titles(once)


def test_insert_if_absent_never_changes_a_row(spark):
    old = rows_of(spark, {"id": 1, "title": "a"})
    new = rows_of(spark, {"id": 1, "title": "x"}, {"id": 2, "title": "p"}, {"id": 2, "title": "q"})
    first = titles(merge.insert_if_absent(old, new))
    assert first[1] == "a" and set(first) == {1, 2}
    assert titles(merge.insert_if_absent(old, new.orderBy(F.desc("title")))) == first


def test_merge_into_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "items")
    stored.write_items(rows_of(spark, {"id": 1, "title": "a"}, {"id": 2, "title": "b"}, {"id": 3_000_001, "title": "far"}), path)
    far = next(Path(path).glob("id_bucket=3/*.parquet"))
    before = far.stat().st_mtime_ns
    for _ in range(2):
        merge.merge_into(path, rows_of(spark, {"id": 2, "title": "B"}, {"id": 5_000_000, "title": "new"}))
    assert titles(stored.read_items(spark, path)) == {1: "a", 2: "B", 3_000_001: "far", 5_000_000: "new"}
    assert far.stat().st_mtime_ns == before
    merge.append_absent(path, rows_of(spark, {"id": 2, "title": "no"}, {"id": 9, "title": "yes"}))
    assert titles(stored.read_items(spark, path)) == {1: "a", 2: "B", 3_000_001: "far", 5_000_000: "new", 9: "yes"}
    assert titles(stored.get_item(spark, path, 9)) == {9: "yes"}
    assert stored.get_item(spark, path, 10).count() == 0


def test_point_read_prunes_folders_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "items")
    stored.write_items(rows_of(spark, {"id": 1}, {"id": 3_000_001}), path)
    plan = stored.get_item(spark, path, 3_000_001)._jdf.queryExecution().executedPlan().toString()
    assert "id_bucket" in plan and "EqualTo(id,3000001)" in plan


DUMP = (
    "\ufeffid,deleted,type,by,time,text,dead,parent,poll,kids,url,score,title,parts,descendants\n"
    '1,,story,ann,1171909200,"two\nlines, ""quoted""",f,0,,"[2,3]",http://x,1.7,T,[],3\n'
    "\n"
    '2,t,COMMENT,"",2007-02-19 18:20:00,a\0b,,1,null,"{4,5}",\\N,,,,\n'
    "3,,thing,,,,,,,,,,,,\n"
    ",,story,,,,,,,,,,,,\n"
    "4,,job,bob\n"
)


def test_dirty_dump(spark, tmp_path):
    path = tmp_path / "dump.csv"
    path.write_text(DUMP, encoding="utf-8")
    good, rejected = split_dump(dump.read_dump(spark, str(path)))
    got = {r["id"]: r for r in good.collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["text"] == 'two\nlines, "quoted"' and got[1]["kids"] == [2, 3] and got[1]["score"] == 1 and got[1]["parent"] is None
    assert got[2]["type"] == "comment" and got[2]["by"] is None and got[2]["text"] == "ab" and got[2]["deleted"] and got[2]["kids"] == [4, 5]
    assert got[1]["time"] == got[2]["time"] == datetime(2007, 2, 19, 18, 20)
    assert got[4]["by"] == "bob" and got[4]["title"] is None
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["no numeric id", "unknown type"]
    assert dump.read_dump(spark, str(path), limit=2).count() == 2


def test_dump_header_must_hold_id_and_type(spark, tmp_path):
    path = tmp_path / "dump.csv"
    path.write_text("id,title\n1,x\n", encoding="utf-8")
    with pytest.raises(ValueError, match="type"):
        dump.read_dump(spark, str(path))
    path.write_text("type,id\njob,7\n", encoding="utf-8")
    assert clean_dump(dump.read_dump(spark, str(path))).collect()[0]["id"] == 7


def test_shards_keep_null_and_empty_apart(spark, tmp_path):
    path = str(tmp_path / "shards")
    ts = datetime(2020, 5, 1, 12, 30, 15)
    items = rows_of(spark, {"id": 5, "by": "", "text": None, "title": ' pad "q"\nx ', "time": ts, "kids": [1, 2]}, {"id": 205, "title": "far"})
    shards.write_shards(items, path, width=100, first=1)
    assert sorted(p.name for p in Path(path).glob("shard_start=*")) == ["shard_start=1", "shard_start=201"]
    line = b"".join(gzip.open(p).read() for p in Path(path).glob("shard_start=1/*.gz")).decode()
    assert line.startswith('5,f,story,"",2020-05-01T12:30:15.000000Z,,f,')
    raw = {r["id"]: r for r in shards.read_shards(spark, path).collect()}
    assert raw["5"]["by"] == "" and raw["5"]["text"] is None and raw["5"]["shard_start"] == 1
    back = {r["id"]: r for r in clean_dump(shards.read_shards(spark, path)).collect()}
    assert back[5]["title"] == ' pad "q"\nx ' and back[5]["time"] == ts and back[5]["kids"] == [1, 2]


def test_feed_newest_file_wins(spark, tmp_path):
    def put(name, *items):
        (tmp_path / name).write_text("".join(json.dumps(i) + "\n" for i in items), encoding="utf-8")

    put("a.json", {"id": 1, "type": "story", "title": "old", "time": 1171909200}, None, {"id": 2, "type": "poll", "parts": [3, 4]})
    put("b.json", {"id": 1, "type": "story", "title": "new", "score": 4}, {"id": 9, "type": "thing"})
    os.utime(tmp_path / "a.json", (1, 1))
    rows = feed.read_feed(spark, str(tmp_path))
    got = {r["id"]: r for r in clean_feed(sync.latest_versions(rows)).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["title"], got[1]["score"], got[1]["time"], got[2]["parts"]) == ("new", 4, None, [3, 4])


def test_story_lists(spark, tmp_path):
    lists = {"newstories": [5, 4, 3], "topstories": [5, None, 99], "jobstories": [4, "x"], "empty": []}
    for name, ids in lists.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(ids), encoding="utf-8")
    rows = feed.read_story_lists(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("jobstories", 4), ("newstories", 3), ("newstories", 4), ("newstories", 5), ("topstories", 5), ("topstories", 99),
    ]
    assert sorted(r["id"] for r in sync.story_list_ids(rows, 50).collect()) == [3, 4, 5]


def test_windows(spark):
    def window(*a, **k):
        w = sync.resolve_window(spark, *a, **k)
        return w.start, w.end

    assert window("latest", 0, 0, 50_000, 10_000) == (40_001, 50_000)
    assert window("latest", 49_990, 0, 50_000, 10_000) == (48_001, 50_000)
    assert window("latest", 1_000, 0, 50_000, 10_000) == (1_001, 11_000)  # far behind: nothing is passed over
    assert window("latest", 40_000, 0, 50_000, 10_000) == (40_001, 50_000)
    assert window("latest", 49_000, 0, 50_000, 100, first=10) == (10, 109)
    assert window("latest", 45_000, 0, 50_000, 10_000) == (45_001, 50_000)
    assert window("latest", 0, 0, 500, 10_000) == (1, 500)
    assert window("backfill", 0, 700, 50_000, 100) == (701, 800)
    assert window("backfill", 900, 700, 950, 100) == (901, 950)
    assert sync.resolve_window(spark, "backfill", 950, 700, 950, 100).is_empty
    assert window("backfill", 900, 700, 50_000, 100, first=10) == (10, 109)
    assert [(g.start, g.end) for g in sync.groups_of(sync.Window(1, 2_500), 1_000)] == [(1, 1000), (1001, 2000), (2001, 2500)]


def test_sync_order(spark):
    lists = spark.createDataFrame([("top", 3), ("top", 98), ("new", 3), ("new", 500)], "list string, id bigint")
    wanted = sync.wanted_ids(spark, "latest", sync.Window(96, 100), lists, 100)
    assert [(r["priority"], r["id"]) for r in sync.in_sync_order(wanted, "latest").collect()] == [(0, 98), (0, 3), (1, 100), (1, 99), (1, 97), (1, 96)]


def test_sync_reports_and_moves_the_cursor(spark, tmp_path):
    items = rows_of(spark, {"id": 1, "title": "a"}, {"id": 2, "title": "b"})
    (tmp_path / "f.json").write_text(
        "".join(json.dumps({"id": i, "type": t, "title": f"n{i}"}) + "\n" for i, t in ((2, "story"), (3, "story"), (4, "odd"), (8, "story"))), encoding="utf-8"
    )
    merged, result = sync.sync(items, feed.read_feed(spark, str(tmp_path)), "backfill", cursor=1, head=8, batch=4)
    assert titles(merged) == {1: "a", 2: "n2", 3: "n3"}
    assert (result.window, result.fetched, result.upserted, result.cursor) == (sync.Window(2, 5), 3, 2, 5)
    same, nothing = sync.sync(items, feed.read_feed(spark, str(tmp_path)), "backfill", cursor=8, head=8)
    assert nothing.window is None and titles(same) == titles(items)


def test_cursors(spark, tmp_path):
    path = str(tmp_path / "cursors")
    assert stored.get_cursor(spark, path, "latest") == 0
    stored.set_cursor(spark, path, "latest", 10, 5, datetime(2024, 1, 1))
    stored.set_cursor(spark, path, "latest", 20, 7, datetime(2024, 1, 2))
    stored.set_cursor(spark, path, "backfill", 3, 1, datetime(2024, 1, 1))
    assert stored.get_cursor(spark, path, "latest") == 20
    assert stored.get_cursor(spark, path, "backfill") == 3
    assert stored.cursors(spark, path).count() == 2


def test_stopped_and_resumed_load_equals_one_pass(spark, tmp_path):
    path, shard_path, ledger_path = (str(tmp_path / n) for n in ("items", "shards", "ledger"))
    stored.write_items(rows_of(spark, {"id": 5, "title": "kept"}), path)
    rows = rows_of(spark, *[{"id": i, "title": f"t{i}"} for i in range(1, 251) if i % 10])
    shards.write_shards(rows, shard_path, width=100)
    plan = ledger.plan_shards(spark, 1, 250, 100)
    assert [(r["start"], r["end"]) for r in ledger.pending_fetch(plan, 1, 250).collect()] == [(1, 100), (101, 200), (201, 250)]

    # A first run knows the first shard only; it dies after loading and before keeping the ledger.
    raw = shards.read_shards(spark, shard_path)
    ledger.write_ledger(ledger.mark_fetched(plan, raw.filter("shard_start = 1")), ledger_path)
    kept = ledger.clean_shards(raw)
    ledger.load_shards(ledger.read_ledger(spark, ledger_path), kept, path)
    assert ledger.pending_load(ledger.read_ledger(spark, ledger_path)).count() == 1

    # The next run fetches the others, loads all three and keeps the ledger.
    ledger.write_ledger(ledger.mark_fetched(ledger.plan_shards(spark, 1, 250, 100, ledger.read_ledger(spark, ledger_path)), raw), ledger_path)
    done = ledger.load_shards(ledger.read_ledger(spark, ledger_path), kept, path)
    ledger.write_ledger(done, ledger_path)
    assert ledger.pending_load(ledger.read_ledger(spark, ledger_path)).count() == 0
    expected = {i: f"t{i}" for i in range(1, 251) if i % 10} | {5: "kept"}
    assert titles(stored.read_items(spark, path)) == expected

    final = ledger.read_ledger(spark, ledger_path)
    counted = ledger.shard_counts(final, stored.read_items(spark, path), 100)
    assert sorted(tuple(r) for r in counted.collect()) == [(1, 100, 90, 10), (101, 200, 90, 10), (201, 250, 45, 5)]
    gaps = ledger.missing_ids(final, stored.read_items(spark, path))
    assert sorted(r["id"] for r in gaps.collect()) == list(range(10, 251, 10))


def test_a_ledger_grows_by_what_changed(spark, tmp_path):
    path, folded = str(tmp_path / "ledger"), str(tmp_path / "folded")
    plan = ledger.plan_shards(spark, 1, 1_000, 10)
    ledger.write_ledger(plan, path)

    def stored_rows(at):
        return spark.read.parquet(at).groupBy("version").count().orderBy("version").collect()

    def kept(at):
        return sorted(tuple(r) for r in ledger.read_ledger(spark, at).collect())

    fetched = ledger.mark_fetched(ledger.read_ledger(spark, path), spark.createDataFrame([(11,), (11,), (991,)], "shard_start bigint"))
    ledger.write_ledger(fetched, path)
    ledger.write_ledger(ledger.read_ledger(spark, path), path)  # nothing new
    assert [tuple(r) for r in stored_rows(path)] == [(1, 100), (2, 2)]
    ledger.write_ledger(ledger.plan_shards(spark, 1_001, 1_020, 10, ledger.read_ledger(spark, path)), path)
    assert [(r[0], r[2]) for r in kept(path) if r[3]] == [(11, 2), (991, 1)] and len(kept(path)) == 102

    # Another plan in its place: windows go, come back, and change their ends.
    short = ledger.plan_shards(spark, 1, 95, 10)
    ledger.write_ledger(short, path)
    assert kept(path) == sorted(tuple(r) for r in short.collect())
    ledger.write_ledger(plan, path)
    assert kept(path) == sorted(tuple(r) for r in plan.collect())
    ledger.fold_ledger(spark, path, folded)
    assert kept(folded) == kept(path) and [tuple(r) for r in stored_rows(folded)] == [(1, 100)]


def test_extended_plan_keeps_old_shards_off_the_grid(spark):
    first = ledger.plan_shards(spark, 7, 150, 100)
    extended = ledger.plan_shards(spark, 107, 400, 100, first)
    assert sorted((r["start"], r["end"]) for r in extended.collect()) == [(7, 106), (107, 150), (151, 206), (207, 306), (307, 400)]


def test_profile(spark):
    rows = rows_of(spark, {"id": 1, "title": "a"}, {"id": 2})
    got = {r["column"]: (r["type"], r["rows"], r["nulls"]) for r in stored.profile(rows).collect()}
    assert got["title"] == ("string", 2, 1) and got["kids"] == ("array<bigint>", 2, 0) and len(got) == 15


def test_dump_with_stray_quotes(spark, tmp_path):
    path = tmp_path / "dump.csv"
    path.write_text('id,type,title\n1,story,5" disk\n2,job,x\n3,story,a 3" and a 5" one\n4,job,"q ""r"""\n', encoding="utf-8")
    assert titles(clean_dump(dump.read_dump(spark, str(path)))) == {1: '5" disk', 2: "x", 3: 'a 3" and a 5" one', 4: 'q "r"'}


def test_latest_run_far_behind_passes_no_id(spark, tmp_path):
    items, cursors = str(tmp_path / "items"), str(tmp_path / "cursors")
    stored.write_items(rows_of(spark, {"id": 1, "title": "a"}), items)
    stored.set_cursor(spark, cursors, "latest", 1_000, 0, datetime(2024, 1, 1))
    (tmp_path / "feed").mkdir()
    lines = [json.dumps({"id": i, "type": "story", "title": f"n{i}"}) for i in (2_000, 20_000, 45_000)]
    (tmp_path / "feed" / "f.json").write_text("\n".join(lines), encoding="utf-8")
    rows = feed.read_feed(spark, str(tmp_path / "feed"))
    for _ in range(6):
        done = sync.run_sync(spark, items, cursors, rows, "latest", head=50_000, batch=10_000)
    assert done.cursor == 50_000 and titles(stored.read_items(spark, items)) == {1: "a", 2_000: "n2000", 20_000: "n20000", 45_000: "n45000"}


def test_latest_run_out_of_time_keeps_its_cursor(spark, tmp_path):
    items, cursors = str(tmp_path / "items"), str(tmp_path / "cursors")
    stored.write_items(rows_of(spark, {"id": 1, "title": "a"}), items)
    (tmp_path / "feed").mkdir()
    lines = [json.dumps({"id": i, "type": "story", "title": f"n{i}"}) for i in (1, 5, 6, 7, 8)]
    (tmp_path / "feed" / "f.json").write_text("\n".join(lines), encoding="utf-8")
    rows = feed.read_feed(spark, str(tmp_path / "feed"))
    lists = spark.createDataFrame([("top", 1), ("top", 99)], "list string, id bigint")

    def run(*stops):
        left = iter(stops)
        return sync.run_sync(spark, items, cursors, rows, "latest", head=8, batch=4, lists=lists, group=2, out_of_time=lambda: next(left, False))

    first = run(False, False, True)
    assert first.timed_out and first.cursor == 0 and stored.get_cursor(spark, cursors, "latest") == 0
    assert titles(stored.read_items(spark, items)) == {1: "n1", 7: "n7", 8: "n8"}  # the list, then the newest group
    second = run()
    assert not second.timed_out and stored.get_cursor(spark, cursors, "latest") == 8
    assert titles(stored.read_items(spark, items)) == {1: "n1", 5: "n5", 6: "n6", 7: "n7", 8: "n8"}


@pytest.mark.parametrize("mode", sync.MODES)
def test_an_overridden_start_passes_no_ids_over(spark, tmp_path, mode):
    items, cursors = str(tmp_path / "items"), str(tmp_path / "cursors")
    stored.write_items(rows_of(spark, {"id": 1, "title": "a"}), items)
    (tmp_path / "feed").mkdir()
    lines = [json.dumps({"id": i, "type": "story", "title": f"n{i}"}) for i in (500, 1_500, 5_500)]
    (tmp_path / "feed" / "f.json").write_text("\n".join(lines), encoding="utf-8")
    rows = feed.read_feed(spark, str(tmp_path / "feed"))
    stored.set_cursor(spark, cursors, mode, 1_000, 0, datetime(2024, 1, 1))
    # Ahead of the cursor, behind it, and right after it.
    for first, cursor in ((5_000, 1_000), (1, 1_000), (1_001, 2_000)):
        done = sync.run_sync(spark, items, cursors, rows, mode, head=9_000, batch=1_000, first=first)
        assert (done.window.start, done.cursor, stored.get_cursor(spark, cursors, mode)) == (first, cursor, cursor)
    assert titles(stored.read_items(spark, items)) == {1: "a", 500: "n500", 1_500: "n1500", 5_500: "n5500"}


def put_feed(folder, name, *ids, at, title="n"):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(json.dumps({"id": i, "type": "story", "title": f"{title}{i}"}) for i in ids) or "null", encoding="utf-8")
    os.utime(path, (at, at))


def names_of(paths):
    return sorted(Path(unquote(p)).name for p in paths)


@pytest.mark.parametrize("named", [0, 10_000])
def test_a_run_opens_only_the_files_it_needs(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(manifests, "NAMED_FILES", named)
    folder = tmp_path / "feed"
    for n in range(10):
        put_feed(folder, f"f {n}.json", *range(n * 100 + 1, n * 100 + 101, 7), at=1_000 + n)
    put_feed(folder, "nothing.json", at=2_000)
    put_feed(folder, "wide.json", 3, 720, at=3_000, title="w")
    files = manifests.FeedFiles(spark, str(folder), str(tmp_path / "manifest"))


    def refreshed():
        files.refresh()
        return spark.read.parquet(files.manifest).count()

    assert refreshed() == 12 and refreshed() == 12
    if named:
        assert names_of(files.rows(250, 350).inputFiles()) == ["f 2.json", "f 3.json", "wide.json"]
    assert files.rows(5_000, 6_000).count() == 0
    # Rewritten, new and removed files.
    put_feed(folder, "f 9.json", 310, at=4_000)
    put_feed(folder, "late.json", 5, at=4_000, title="l")
    (folder / "f 3.json").unlink()
    assert refreshed() == 14
    assert names_of(r["path"] for r in files.needed(301, 400).collect()) == ["f 9.json", "wide.json"]
    listed = spark.createDataFrame([(5,), (555,), (9_999,)], "id bigint")
    assert names_of(r["path"] for r in files.needed(2_000, 3_000, listed).collect()) == ["f 0.json", "f 5.json", "late.json", "wide.json"]

    # The same items as by a read of all files.
    items = {}
    for way in (files, feed.read_feed(spark, str(folder))):
        path = str(tmp_path / f"items-{type(way).__name__}")
        stored.write_items(rows_of(spark, {"id": 1, "title": "a"}), path)
        lists = listed.selectExpr("'top' AS list", "id")
        done = sync.run_sync(spark, path, path + "-cursors", way, "latest", 10_000, 9_800, lists)
        items[path] = (done, titles(stored.read_items(spark, path)))
    (a, b) = items.values()
    assert a == b and a[1][720] == "w720" and a[1][5] == "l5"


@pytest.mark.parametrize("seed", range(3))
def test_files_of_single_ids_by_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    spans = [tuple(sorted(rng.choices(range(1 << rng.randint(1, 40)), k=2))) for _ in range(60)]
    folder = tmp_path / "feed"
    for n, (least, greatest) in enumerate(spans):
        put_feed(folder, f"{n}.json", least, greatest, at=1_000)
    files = manifests.FeedFiles(spark, str(folder), str(tmp_path / "manifest"))
    files.refresh()
    ids = [rng.randrange(1 << rng.randint(1, 40)) for _ in range(30)] + [spans[0][0], spans[1][1]]
    got = files.needed(1, 0, spark.createDataFrame([(i,) for i in ids], "id bigint"))
    assert sorted(int(Path(r["path"]).stem) for r in got.collect()) == [n for n, (a, b) in enumerate(spans) if any(a <= i <= b for i in ids)]
