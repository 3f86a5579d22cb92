"""Ingest, merges, sync, ledger, and round trips through the file formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlake.checks.base import AS_OF, HIGHEST_SQL, ITEMS, NEWEST_SQL, as_hits, check, in_places
from forumlake.corpus import items_view, table
from forumlake.functions.requests import SAVED_SEARCHES
from forumlake.operators import clean, counts, merge
from forumlake.plans import ledger, sync
from forumlake.plans.access import build_access
from forumlake.plans.index import build_index, compact, open_index
from forumlake.plans.lake import SAMPLE_RANGE_ROWS, open_lake
from forumlake.plans.search import search, typeahead, user_items
from forumlake.schema import FEED, ITEM_COLUMNS
from forumlake.session import fresh_path, stage
from forumlake.sources.dump import WRITE_OPTIONS, read_dump
from forumlake.sources.feed import read_feed, read_story_lists
from forumlake.sources.items import get_item, read_items, set_cursor, write_items
from forumlake.sources.manifest import FeedFiles
from forumlake.sources.shards import read_shards, write_shards
from forumlake.streaming.feed_sync import sync_stream

WITH = f"WITH {ITEMS}"
MAIN_SQL = 'id, type, "by" AS author, time, score, title, parent, deleted, dead'
MAIN = ("id", "type", "by", "time", "score", "title", "parent", "deleted", "dead")


def _main(df: DataFrame) -> DataFrame:
    return as_hits(df.select(*MAIN).withColumn("time", F.col("time").cast("timestamp_ntz")))


# A feed of changes: every event is a version of one of a few hundred stories,
# some stored already and some new. Some versions have a type no item can have.


def changes_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    none = F.lit(None)
    values: dict[str, Column] = {
        "id": (c("event_id") % 500) * 10 + 1,
        "deleted": F.when(c("event_id") % 41 == 0, True),
        "type": F.when(c("event_id") % 23 == 0, c("event_type")).otherwise("story"),
        "by": F.concat(F.lit("v"), c("user_id").cast("string")),
        "time": F.unix_micros(c("ts").cast("timestamp")) / 1e6,
        "text": none,
        "dead": F.when(c("event_id") % 43 == 0, True),
        "parent": none,
        "poll": none,
        "kids": none,
        "url": F.when(c("event_id") % 3 == 0, ""),
        "score": F.floor("value"),
        "title": F.concat_ws(" ", "event_type", "props"),
        "parts": F.when(c("event_id") % 2 == 0, F.array(c("event_id"))),
        "descendants": none,
    }
    feed = [values[f.name].cast(f.dataType).alias(f.name) for f in FEED]
    return table(spark, sf_dir, "events").select(*feed, c("ts").cast("timestamp").alias("arrived"), F.lpad(c("event_id").cast("string"), 12, "0").alias("file"))


_FEED = f"""{WITH},
versions AS (
  SELECT event_id, ts, (event_id % 500) * 10 + 1 AS id, event_id % 41 = 0 AS deleted, CASE WHEN event_id % 23 = 0 THEN event_type ELSE 'story' END AS type,
         'v' || user_id AS "by", ts AS time, event_id % 43 = 0 AS dead, CAST(floor(value) AS INTEGER) AS score,
         concat_ws(' ', event_type, props) AS title, CAST(NULL AS BIGINT) AS parent
  FROM events),
newest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1),
changes AS (SELECT * FROM newest WHERE type IN ('story', 'comment', 'poll', 'pollopt', 'job')),
merged AS (SELECT {MAIN_SQL} FROM items WHERE id NOT IN (SELECT id FROM changes) UNION ALL SELECT {MAIN_SQL} FROM changes)
"""


@check("feed_latest", f"{_FEED} SELECT {MAIN_SQL} FROM changes")
def _feed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _main(clean.clean_feed(sync.latest_versions(changes_feed(spark, sf_dir))))


@check("feed_rejected", f"{_FEED} SELECT id, type, 'unknown type' AS reject_reason FROM newest WHERE id NOT IN (SELECT id FROM changes)")
def _feed_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = clean.split_feed(sync.latest_versions(changes_feed(spark, sf_dir)))[1]
    return rejected.select("id", "type", "reject_reason")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with time as an instant, as the stored table has it."""
    return items_view(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))


@check("upsert", f"{_FEED} SELECT * FROM merged")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = clean.clean_feed(sync.latest_versions(changes_feed(spark, sf_dir)))
    return _main(merge.upsert(_items(spark, sf_dir), changes))


@check("insert_absent", f"{_FEED} SELECT {MAIN_SQL} FROM items UNION ALL SELECT {MAIN_SQL} FROM changes WHERE id NOT IN (SELECT id FROM items)")
def _insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = clean.clean_feed(sync.latest_versions(changes_feed(spark, sf_dir)))
    return _main(merge.insert_if_absent(_items(spark, sf_dir), changes))


@check(
    "load_totals",
    f"""{_FEED}, kept AS (SELECT id, id // 1000 * 1000 AS shard FROM changes)
SELECT shard, count(*) AS processed, count(*) FILTER (WHERE id NOT IN (SELECT id FROM items)) AS inserted FROM kept GROUP BY shard""",
)
def _load_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = clean.clean_feed(sync.latest_versions(changes_feed(spark, sf_dir)))
    changes = changes.withColumn("shard", F.floor(F.col("id") / 1000) * 1000)
    return counts.load_totals(changes, merge.absent(_items(spark, sf_dir), changes), "shard")


@check("sync_latest", f"{_FEED}, window_rows AS (SELECT * FROM changes WHERE id BETWEEN 2002 AND 4001) SELECT {MAIN_SQL} FROM items WHERE id NOT IN (SELECT id FROM window_rows) UNION ALL SELECT {MAIN_SQL} FROM window_rows")
def _sync_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor 3500 and head 4001: the refresh overlap starts the window at 2002."""
    merged, _ = sync.sync(_items(spark, sf_dir), changes_feed(spark, sf_dir), "latest", cursor=3500, head=4001)
    return _main(merged)


@check("sync_backfill", f"{_FEED}, window_rows AS (SELECT * FROM changes WHERE id BETWEEN 1001 AND 3000) SELECT {MAIN_SQL} FROM items WHERE id NOT IN (SELECT id FROM window_rows) UNION ALL SELECT {MAIN_SQL} FROM window_rows")
def _sync_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _ = sync.sync(_items(spark, sf_dir), changes_feed(spark, sf_dir), "backfill", cursor=1000, head=4001, batch=2000)
    return _main(merged)


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(c("event_id") % 9 != 0, c("event_id") * 3).otherwise(0).alias("cursor"),
        (20_000 + c("user_id")).alias("head"),
        (1_000 + c("event_id") % 5_000).alias("batch"),
        (c("user_id") * 7).alias("max_id"),
    )


_CURSORS = """WITH cursors AS (
  SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id * 3 ELSE 0 END AS cursor, 20000 + user_id AS head,
         1000 + event_id % 5000 AS batch, user_id * 7 AS max_id FROM events)"""


@check(
    "latest_window",
    f"""{_CURSORS} SELECT event_id, CASE WHEN cursor > 0 AND head - cursor > batch THEN cursor + 1
    ELSE greatest(1, CASE WHEN cursor > 0 THEN least(cursor + 1, head - 1999) ELSE head - batch + 1 END, head - batch + 1) END AS start,
  CASE WHEN cursor > 0 AND head - cursor > batch THEN cursor + batch ELSE head END AS "end" FROM cursors""",
)
def _latest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = sync.latest_window(F.col("cursor"), F.col("head"), F.col("batch"))
    return _cursors(spark, sf_dir).select("event_id", start.alias("start"), end.alias("end"))


@check(
    "backfill_window",
    f"""{_CURSORS}, starts AS (SELECT *, CASE WHEN cursor > 0 THEN cursor ELSE max_id END + 1 AS start FROM cursors)
SELECT event_id, start, least(start + batch - 1, head) AS "end" FROM starts""",
)
def _backfill_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = sync.backfill_window(F.col("cursor"), F.col("max_id"), F.col("head"), F.col("batch"))
    return _cursors(spark, sf_dir).select("event_id", start.alias("start"), end.alias("end"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that items point to, as ranked lists by the kind of the pointer."""
    items = items_view(spark, sf_dir)
    return (
        items.select(F.lit("parents").alias("list"), F.col("parent").alias("id"))
        .unionByName(items.select(F.lit("polls").alias("list"), F.col("poll").alias("id")))
        .unionByName(items.select(F.lit("parts").alias("list"), F.explode("parts").alias("id")))
        .filter("id IS NOT NULL")
    )


_LISTED = f"""{WITH}, lists AS (
  SELECT parent AS id FROM items UNION ALL SELECT poll FROM items UNION ALL SELECT unnest(parts) FROM items),
listed AS (SELECT DISTINCT id FROM lists WHERE id <= 4000)"""


@check("story_list_union", f"{_LISTED} SELECT id FROM listed")
def _story_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.story_list_ids(_lists(spark, sf_dir), 4_000)


@check(
    "sync_order",
    f"""{_LISTED}, wanted AS (SELECT 0 AS priority, id FROM listed UNION ALL
  SELECT 1, r.id FROM generate_series(2001, 4000) r(id) WHERE r.id NOT IN (SELECT id FROM listed))
SELECT priority, id, row_number() OVER (ORDER BY priority, id DESC) AS place FROM wanted""",
)
def _sync_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = sync.wanted_ids(spark, "latest", sync.Window(2_001, 4_000), _lists(spark, sf_dir), 4_000)
    return in_places(sync.in_sync_order(wanted, "latest"))


# Ledger over the ids of the items.


def _plan(spark: SparkSession, sf_dir: str, width: int = 1_000) -> DataFrame:
    """A first plan over part of the ids, extended to all of them."""
    top = items_view(spark, sf_dir).agg(F.max("id")).first()[0]
    first = ledger.plan_shards(spark, 1, 2_500, width)
    return ledger.plan_shards(spark, 1, top, width, first)


_PLAN = f"""{WITH}, top AS (SELECT max(id) AS m FROM items),
first_plan AS (SELECT s AS start, least(s + 999, 2500) AS "end" FROM generate_series(1, 2500, 1000) r(s)),
plan AS (SELECT * FROM first_plan UNION ALL
  SELECT greatest(s, 2501), least(s + 999, m) FROM top, generate_series(1, (SELECT m FROM top), 1000) r(s) WHERE s + 999 > 2500)"""


@check("shard_plan", f'{_PLAN} SELECT start, "end", CAST(0 AS BIGINT) AS rows, false AS fetched, false AS loaded FROM plan')
def _shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@check("shard_coverage", "WITH ids AS (SELECT max(id) AS m FROM items) SELECT m AS ids, m AS covered, CAST(0 AS BIGINT) AS twice FROM ids".replace("WITH ", f"{WITH}, ", 1))
def _shard_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of the range lies in exactly one shard."""
    plan = _plan(spark, sf_dir)
    each = plan.select(F.explode(F.sequence("start", "end")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return each.agg(F.max("id").alias("ids"), F.count("*").alias("covered"), F.count_if(F.col("n") > 1).alias("twice"))


_COUNTS = f"""{_PLAN}, shard_counts AS (
  SELECT start, "end", (SELECT count(*) FROM items WHERE id BETWEEN start AND "end") AS rows FROM plan)"""


@check("shard_counts", f'{_COUNTS} SELECT start, "end", rows, "end" - start + 1 - rows AS missing FROM shard_counts')
def _shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.shard_counts(_plan(spark, sf_dir), items_view(spark, sf_dir), 1_000)


@check(
    "missing_ids",
    f"""{_PLAN}, wanted AS (SELECT start, unnest(generate_series(start, "end")) AS id FROM plan),
gaps AS (SELECT * FROM wanted WHERE id NOT IN (SELECT id FROM items))
SELECT start, count(*) AS missing, min(id) AS first_id, max(id) AS last_id FROM gaps GROUP BY start""",
)
def _missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = ledger.missing_ids(_plan(spark, sf_dir), items_view(spark, sf_dir))
    return gaps.groupBy("start").agg(F.count("*").alias("missing"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@check(
    "missing_runs",
    f"""{_PLAN}, wanted AS (SELECT start, unnest(generate_series(start, "end")) AS id FROM plan),
gaps AS (SELECT start, id, id - row_number() OVER (PARTITION BY start ORDER BY id) AS run FROM wanted WHERE id NOT IN (SELECT id FROM items))
SELECT start, min(id) AS first_id, max(id) AS last_id FROM gaps GROUP BY start, run""",
)
def _missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.missing_runs(_plan(spark, sf_dir), items_view(spark, sf_dir))


@check(
    "shard_progress",
    f"""{_COUNTS} SELECT start, "end", rows, row_number() OVER (ORDER BY start) AS place FROM shard_counts""",
)
def _shard_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows were written, some without a row; all wait to be loaded, in order."""
    plan = _plan(spark, sf_dir)
    edge = plan.select("start", "end")
    cells = edge.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 1_000), F.floor(F.col("end") / 1_000))))
    ids = items_view(spark, sf_dir).select("id", F.floor(F.col("id") / 1_000).alias("cell"))
    rows = cells.join(ids, "cell").filter("id BETWEEN start AND end").select(F.col("start").alias("shard_start"), "id")
    pending = ledger.pending_load(ledger.mark_fetched(plan, rows, plan.select("start")))
    return in_places(pending.select("start", "end", "rows"))


# Rules.


@check(
    "constraint_violations",
    f"""{WITH}, dirty AS (SELECT id, type, deleted FROM items UNION ALL
  SELECT (event_id % 500) * 10 + 1, CASE WHEN event_id % 23 = 0 THEN event_type ELSE 'story' END, CASE WHEN event_id % 37 <> 0 THEN false END FROM events)
SELECT 'repeated id' AS rule, id, count(*) AS n FROM dirty GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'unknown type', id, 1 FROM dirty WHERE type NOT IN ('story', 'comment', 'poll', 'pollopt', 'job')
UNION ALL SELECT 'deleted is null', id, 1 FROM dirty WHERE deleted IS NULL""",
)
def _constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    more = table(spark, sf_dir, "events").select(
        ((c("event_id") % 500) * 10 + 1).alias("id"),
        F.when(c("event_id") % 23 == 0, c("event_type")).otherwise("story").alias("type"),
        F.when(c("event_id") % 37 != 0, False).alias("deleted"),
    )
    return clean.check_items(items_view(spark, sf_dir).select("id", "type", "deleted").unionByName(more))


@check(
    "empty_tables",
    f"""{WITH}, tables AS (SELECT 'dead stories without a time' AS part, count(*) AS n FROM items WHERE type = 'story' AND dead AND time IS NULL AND id < 0
  UNION ALL SELECT 'items', count(*) FROM items)
SELECT part, 'empty table' AS rule, CAST(NULL AS BIGINT) AS id, n FROM tables WHERE n = 0""",
)
def _empty_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of no rows breaks one rule, a filled one does not."""
    items = items_view(spark, sf_dir)
    parts = {"dead stories without a time": items.filter("type = 'story' AND dead AND time IS NULL AND id < 0"), "items": items}
    found = [clean.check_items(rows).filter("rule = 'empty table'").select(F.lit(part).alias("part"), "rule", "id", "n") for part, rows in parts.items()]
    return found[0].unionByName(found[1])


# Raw dump rows with every kind of dirt, derived from the events.

def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    text = event.cast("string")
    events = table(spark, sf_dir, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    values = {
        "id": F.when(event % 29 == 0, "x").when(event % 31 == 0, F.concat(text, F.lit(".0"))).otherwise(text),
        "deleted": F.when(event % 5 == 0, "TRUE").when(event % 5 == 1, "t").when(event % 5 == 2, "0"),
        "type": F.when(event % 3 == 0, "Story").when(event % 3 == 1, "comment").when(event % 17 == 0, F.col("event_type")).otherwise("JOB"),
        "by": F.when(event % 4 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        "time": F.when(event % 7 == 0, seconds.cast("string")).when(event % 7 == 1, (seconds * 1000).cast("string"))
        .when(event % 7 == 2, "x").when(event % 7 == 3, "\\N").when(event % 7 == 4, F.date_format(F.from_unixtime(seconds), "yyyy-MM-dd HH:mm:ss"))
        .when(event % 7 == 5, F.concat(F.date_format(F.from_unixtime(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(""),
        "text": F.concat(F.lit("a\0b "), F.col("props")),
        "dead": F.when(event % 6 == 0, "1").otherwise("f"),
        "parent": F.when(event % 8 == 0, "0").when(event % 8 == 1, "null").otherwise(F.col("user_id").cast("string")),
        "poll": F.lit(None).cast("string"),
        "kids": F.when(event % 4 == 0, "[1, 2,x]").when(event % 4 == 1, "{3,4}").when(event % 4 == 2, "[]").otherwise("null"),
        "url": F.lit(""),
        "score": F.when(event % 10 == 0, "9999999999").otherwise(F.col("value").cast("string")),
        "title": F.col("event_type"),
        "parts": F.lit(""),
        "descendants": F.when(event % 9 == 0, "-1.7").otherwise("12"),
    }
    return events.select([values[name].alias(name) for name in ITEM_COLUMNS])


_RAW = """WITH raw AS (
  SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id END AS id, event_id % 5 < 2 AS deleted,
    lower(CASE WHEN event_id % 3 = 0 THEN 'Story' WHEN event_id % 3 = 1 THEN 'comment' WHEN event_id % 17 = 0 THEN event_type ELSE 'JOB' END) AS type,
    CASE WHEN event_id % 4 <> 0 THEN 'u' || user_id END AS author,
    CASE WHEN event_id % 7 IN (0, 1, 4, 5) THEN date_trunc('second', ts) END AS time,
    'ab ' || props AS text, event_id % 6 = 0 AS dead, CASE WHEN event_id % 8 > 1 THEN nullif(user_id, 0) END AS parent,
    CASE event_id % 4 WHEN 0 THEN '1,2' WHEN 1 THEN '3,4' ELSE '' END AS kids,
    event_id % 10 = 0 AS too_wide, CASE WHEN event_id % 10 <> 0 THEN CAST(trunc(value) AS INTEGER) END AS score, event_type AS title,
    CASE WHEN event_id % 9 = 0 THEN -1 ELSE 12 END AS descendants
  FROM events),
judged AS (SELECT *, CASE WHEN id IS NULL THEN 'no numeric id' WHEN type NOT IN ('story', 'comment', 'poll', 'pollopt', 'job') THEN 'unknown type'
  WHEN too_wide THEN 'score out of range' END AS reject_reason FROM raw)
"""


@check("clean_dump", f"{_RAW} SELECT id, deleted, type, author, time, text, dead, parent, kids, score, title, descendants FROM judged WHERE reject_reason IS NULL")
def _clean_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.clean_dump(raw_rows(spark, sf_dir)).withColumn("time", F.col("time").cast("timestamp_ntz"))
    rows = rows.withColumn("kids", F.array_join(F.col("kids").cast("array<string>"), ","))
    return as_hits(rows.select("id", "deleted", "type", "by", "time", "text", "dead", "parent", "kids", "score", "title", "descendants"))


@check("rejected_rows", f"{_RAW} SELECT reject_reason, count(*) AS n, count(id) AS with_id FROM judged WHERE reject_reason IS NOT NULL GROUP BY 1")
def _rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = clean.split_dump(raw_rows(spark, sf_dir))[1]
    with_id = F.count_if(F.col("id") != "x").alias("with_id")
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("n"), with_id)


# Round trips: written by Spark to the work folder in each format and read back.

_ROUND = f"""{WITH} SELECT id, type, "by" AS author, time, nullif(text, '') AS text, deleted, dead, parent, poll, url, score, title,
  array_to_string(kids, ',') AS kids, array_to_string(parts, ',') AS parts, descendants FROM items"""


def _round(rows: DataFrame) -> DataFrame:
    listed = {name: F.array_join(F.col(name).cast("array<string>"), ",") for name in ("kids", "parts")}
    return as_hits(rows.withColumns({"time": F.col("time").cast("timestamp_ntz")} | listed).select(*ITEM_COLUMNS))


@check("items_table", _ROUND)
def _items_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "items")
    write_items(_items(spark, sf_dir), path)
    return _round(read_items(spark, path).withColumn("text", F.nullif("text", F.lit(""))))


@check("shard_files", _ROUND)
def _shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "shards")
    write_shards(_items(spark, sf_dir), path, 10_000)
    return _round(clean.clean_dump(read_shards(spark, path)))


def write_dump(items: DataFrame, path: str) -> None:
    as_text = [F.to_json(c).alias(c) if c in ("kids", "parts") else F.col(c).cast("string").alias(c) for c in ITEM_COLUMNS]
    items.select(*as_text).write.options(**WRITE_OPTIONS, header="true").csv(path)


@check("dump_files", _ROUND)
def _dump_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "dump")
    write_dump(items_view(spark, sf_dir), path)
    return _round(clean.clean_dump(read_dump(spark, path)))


@check("feed_files", _ROUND)
def _feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "feed")
    _as_feed(_items(spark, sf_dir)).write.json(path)
    return _round(clean.clean_feed(read_feed(spark, path)))


def _as_feed(items: DataFrame) -> DataFrame:
    return items.withColumn("time", F.unix_micros(F.col("time").cast("timestamp")) / 1e6)


@check("story_list_files", f"{WITH} SELECT id FROM items WHERE type IN ('story', 'job', 'poll')")
def _story_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists of ids by type, written as JSON arrays of a few ids each."""
    path = fresh_path(spark, "lists")
    ids = items_view(spark, sf_dir).filter(F.col("type").isin("story", "job", "poll")).select("type", "id")
    lists = ids.groupBy("type", F.floor(F.col("id") / 500).cast("string").alias("part")).agg(F.to_json(F.collect_list("id")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_story_lists(spark, path).select("id")


@check("stream_upsert", f"{_FEED} SELECT * FROM merged")
def _stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed as files of JSON, worked off by the stream in two batches."""
    base = fresh_path(spark, "stream")
    write_items(_items(spark, sf_dir), f"{base}/items")
    latest = sync.latest_versions(changes_feed(spark, sf_dir))
    latest.repartition(4, "id").write.json(f"{base}/feed")
    sync_stream(spark, f"{base}/feed", f"{base}/items", f"{base}/checkpoint", files_per_trigger=2).awaitTermination()
    return _main(read_items(spark, f"{base}/items"))



@check("stream_late_files", f"{_FEED} SELECT * FROM merged")
def _stream_late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with older versions of all changed rows reach the stream after the newer ones, and change nothing."""
    base = fresh_path(spark, "stream-late")
    write_items(_items(spark, sf_dir), f"{base}/items")
    latest = stage(sync.latest_versions(changes_feed(spark, sf_dir)), "latest")
    older = latest.withColumn("title", F.concat(F.lit("older "), F.coalesce("title", F.lit(""))))
    older.repartition(2, "id").write.json(f"{base}/feed/first-written")
    latest.repartition(2, "id").write.json(f"{base}/feed/last-written")
    for arrived in ("last-written", "*"):
        sync_stream(spark, f"{base}/feed/{arrived}", f"{base}/items", f"{base}/checkpoint", files_per_trigger=2, horizon="7 days").awaitTermination()
    return _main(read_items(spark, f"{base}/items"))


@check(
    "stream_pages",
    f"""{_FEED}, shown AS (SELECT * FROM merged WHERE NOT deleted AND NOT dead)
SELECT 'new' AS page, id, row_number() OVER (ORDER BY {NEWEST_SQL}) AS rank FROM shown WHERE type = 'story' AND title <> '' QUALIFY rank <= 30
UNION ALL SELECT 'top', id, row_number() OVER (ORDER BY {HIGHEST_SQL}) AS rank FROM shown WHERE type = 'story' AND title <> '' QUALIFY rank <= 30
UNION ALL SELECT 'typeahead', id, row_number() OVER (ORDER BY {NEWEST_SQL}) AS rank FROM shown
  WHERE starts_with(lower(title), 'v') OR starts_with(lower(author), 'v') QUALIFY rank <= 8
UNION ALL SELECT 'author', id, row_number() OVER (ORDER BY {NEWEST_SQL}) AS rank FROM shown WHERE author = 'v7' QUALIFY rank <= 30""",
)
def _stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from the ordered access paths of a lake that a stream has changed in two batches."""
    base = fresh_path(spark, "stream-pages")
    write_items(_items(spark, sf_dir), f"{base}/items")
    build_access(read_items(spark, f"{base}/items"), f"{base}/access", SAMPLE_RANGE_ROWS)
    sync.latest_versions(changes_feed(spark, sf_dir)).repartition(4, "id").write.json(f"{base}/feed")
    sync_stream(spark, f"{base}/feed", f"{base}/items", f"{base}/checkpoint", files_per_trigger=2, access_path=f"{base}/access").awaitTermination()
    lake = open_lake(spark, base, ordered=True)
    pages = {
        "new": search(lake, SAVED_SEARCHES["new"], AS_OF),
        "top": search(lake, SAVED_SEARCHES["top"], AS_OF),
        "typeahead": typeahead(lake, "V"),
        "author": user_items(lake.items, "v7", access=lake.access),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(page).alias("page"), "id", "rank") for page, rows in pages.items()])


@check("sync_groups", f"{_FEED}, window_rows AS (SELECT * FROM changes WHERE id BETWEEN 1001 AND 3000) SELECT {MAIN_SQL} FROM items WHERE id NOT IN (SELECT id FROM window_rows) UNION ALL SELECT {MAIN_SQL} FROM window_rows")
def _sync_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backfill on the stored table, merged in two groups by a first run that
    stops half way and a second one that goes on from its cursor."""
    base = fresh_path(spark, "sync")
    write_items(_items(spark, sf_dir), f"{base}/items")
    set_cursor(spark, f"{base}/cursors", "backfill", 1_000, 0, AS_OF)
    feed = stage(changes_feed(spark, sf_dir), "feed")
    times_up = iter((False, True))
    sync.run_sync(spark, f"{base}/items", f"{base}/cursors", feed, "backfill", 3_000, 2_000, group=1_000, out_of_time=lambda: next(times_up))
    sync.run_sync(spark, f"{base}/items", f"{base}/cursors", feed, "backfill", 3_000, 2_000, group=1_000)
    return _main(read_items(spark, f"{base}/items"))


@check("ledger_load", f"{_FEED} SELECT {MAIN_SQL} FROM items UNION ALL SELECT {MAIN_SQL} FROM changes WHERE id NOT IN (SELECT id FROM items)")
def _ledger_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes as shards, loaded into the stored items through the ledger."""
    base = fresh_path(spark, "load")
    write_items(_items(spark, sf_dir), f"{base}/items")
    write_shards(clean.clean_feed(sync.latest_versions(changes_feed(spark, sf_dir))), f"{base}/shards", 1_000)
    rows = ledger.clean_shards(read_shards(spark, f"{base}/shards"))
    plan = ledger.mark_fetched(ledger.plan_shards(spark, 1, 5_000, 1_000), rows)
    ledger.write_ledger(ledger.load_shards(plan, rows, f"{base}/items"), f"{base}/ledger")
    if not ledger.pending_load(ledger.read_ledger(spark, f"{base}/ledger")).isEmpty():
        raise RuntimeError("shards were left unloaded")
    return _main(read_items(spark, f"{base}/items"))


@check("item_by_id", f"{WITH} SELECT {MAIN_SQL} FROM items WHERE id = 502")
def _item_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "items")
    write_items(_items(spark, sf_dir), path)
    return _main(get_item(spark, path, 502))


@check("table_replaced", f"{WITH} SELECT id, type FROM items")
def _table_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk write over a table leaves nothing of it, in whatever bucket."""
    path = fresh_path(spark, "items")
    items = _items(spark, sf_dir)
    write_items(items.withColumn("id", F.col("id") + 50_000_000), path)
    write_items(items, path)
    return read_items(spark, path).select("id", "type")


@check(
    "dump_stray_quotes",
    """SELECT event_id AS id, 'story' AS type, 'disk of ' || user_id || '" and 5" more' AS title, 'say "x", twice' || chr(10) || 'line, two' AS text FROM events""",
)
def _dump_stray_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes inside bare fields, next to quoted fields with commas and line breaks."""
    path = fresh_path(spark, "dump")
    c = F.col
    bare = F.concat(F.lit("disk of "), c("user_id").cast("string"), F.lit('" and 5" more'))
    record = F.concat_ws(",", c("event_id").cast("string"), F.lit("story"), bare, F.lit('"say ""x"", twice\nline, two"'))
    # Every file has its header.
    files = table(spark, sf_dir, "events").repartition(4).select(F.spark_partition_id().alias("part"), record.alias("record"))
    texts = files.groupBy("part").agg(F.concat(F.lit("id,type,title,text\n"), F.array_join(F.collect_list("record"), "\n")).alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = clean.clean_dump(read_dump(spark, path))
    return rows.select("id", "type", "title", "text")


_SAMPLE = 700


@check("dump_sample", f"{WITH} SELECT least(count(*), {_SAMPLE}) AS n, true AS known FROM items")
def _dump_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a dump: so many, and all of them rows of the table."""
    path = fresh_path(spark, "dump")
    items = items_view(spark, sf_dir)
    write_dump(items, path)
    rows = read_dump(spark, path, limit=_SAMPLE).select(F.col("id").cast("bigint").alias("id"))
    known = rows.join(items.select("id", F.lit(True).alias("found")), "id", "left")
    return known.agg(F.count("*").alias("n"), F.bool_and(F.coalesce("found", F.lit(False))).alias("known"))


@check("bounded_latest", f"""{_FEED}, lists AS (SELECT DISTINCT parent AS id FROM items WHERE parent <= 6000),
wanted AS (SELECT id FROM lists UNION SELECT unnest(generate_series(1001, 4000))),
seen AS (SELECT id FROM newest WHERE id IN (SELECT id FROM wanted))
SELECT (SELECT count(*) FROM seen) AS fetched, (SELECT count(*) FROM changes WHERE id IN (SELECT id FROM wanted)) AS upserted,
  CAST(4000 AS BIGINT) AS cursor, CAST(1001 AS BIGINT) AS start""")  # fmt: skip
def _bounded_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far behind the head: the next ids after the cursor, ranked lists first and once; what the run reports."""
    base = fresh_path(spark, "sync")
    write_items(_items(spark, sf_dir), f"{base}/items")
    set_cursor(spark, f"{base}/cursors", "latest", 1_000, 0, AS_OF)
    lists = items_view(spark, sf_dir).filter("parent IS NOT NULL").select(F.lit("top").alias("list"), F.col("parent").alias("id"))
    done = sync.run_sync(spark, f"{base}/items", f"{base}/cursors", changes_feed(spark, sf_dir), "latest", 6_000, 3_000, lists, group=1_000)
    numbers = {"fetched": done.fetched, "upserted": done.upserted, "cursor": done.cursor, "start": done.window.start}
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in numbers.items()])


@check("sync_by_manifest", f"""{_FEED}, lists AS (SELECT DISTINCT parent AS id FROM items WHERE parent <= 4900),
window_rows AS (SELECT * FROM changes WHERE id BETWEEN 1001 AND 3000 OR id IN (SELECT id FROM lists))
SELECT {MAIN_SQL} FROM items WHERE id NOT IN (SELECT id FROM window_rows) UNION ALL SELECT {MAIN_SQL} FROM window_rows""")  # fmt: skip
def _sync_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over files of JSON that opens those of its window and of the ranked lists; older versions lie in files written before."""
    base = fresh_path(spark, "manifest")
    write_items(_items(spark, sf_dir), f"{base}/items")
    set_cursor(spark, f"{base}/cursors", "latest", 1_000, 0, AS_OF)
    latest = stage(sync.latest_versions(changes_feed(spark, sf_dir)), "latest")
    files = FeedFiles(spark, f"{base}/feed", f"{base}/manifest")
    older = latest.withColumn("title", F.concat(F.lit("older "), F.coalesce("title", F.lit(""))))
    for rows in (older, latest):
        rows.repartitionByRange(12, "id").write.mode("append").json(f"{base}/feed")
        files.refresh()
    lists = items_view(spark, sf_dir).filter("parent IS NOT NULL").select(F.lit("top").alias("list"), F.col("parent").alias("id"))
    sync.run_sync(spark, f"{base}/items", f"{base}/cursors", files, "latest", 4_900, 2_000, lists, group=1_000)
    return _main(read_items(spark, f"{base}/items"))


def _index_after_streams(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Items and index after two streams with checkpoints of their own, which bring two versions of every changed id."""
    base = fresh_path(spark, "stream-index")
    write_items(_items(spark, sf_dir), f"{base}/items")
    build_index(read_items(spark, f"{base}/items"), f"{base}/index", 0, "simple")
    latest = sync.latest_versions(changes_feed(spark, sf_dir))
    older = latest.withColumn("title", F.concat(F.lit("older "), F.coalesce("title", F.lit(""))))
    for name, rows in (("first", older), ("second", latest)):
        rows.repartition(2, "id").write.json(f"{base}/{name}")
        sync_stream(spark, f"{base}/{name}", f"{base}/items", f"{base}/check-{name}", f"{base}/index", files_per_trigger=1).awaitTermination()
    return f"{base}/items", f"{base}/index"


_STREAMED = f"""{_FEED}, merged_items AS (
  SELECT id, type, NOT deleted AND NOT dead AS live, concat_ws(' ', title, "by", regexp_replace(text, '<[^>]+>', ' ', 'g')) AS body FROM items WHERE id NOT IN (SELECT id FROM changes)
  UNION ALL SELECT id, type, NOT deleted AND NOT dead, concat_ws(' ', title, "by") FROM changes),
words AS (SELECT id, type, live, unnest(regexp_extract_all(lower(regexp_replace(body, '&[#A-Za-z0-9]+;', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM merged_items),
posts AS (SELECT id, type, live, term, count(*) AS tf FROM words GROUP BY ALL)
"""


@check("stream_index", f"{_STREAMED} SELECT id, term, CAST(tf AS INTEGER) AS tf, live FROM posts")
def _stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after the streams."""
    _, index = _index_after_streams(spark, sf_dir)
    return open_index(spark, index).postings().select("id", "term", "tf", "live")


@check(
    "stream_index_compacted",
    f"""{_STREAMED} SELECT 'all' AS scope, term, count(*) AS df FROM posts GROUP BY term
UNION ALL SELECT type, term, count(*) FROM posts WHERE live AND type IN ('story', 'comment', 'job') GROUP BY type, term""",
)
def _stream_index_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics after the streams, folded into one generation."""
    _, index = _index_after_streams(spark, sf_dir)
    return compact(open_index(spark, index), fresh_path(spark, "compact")).term_stats().select("scope", "term", "df")
