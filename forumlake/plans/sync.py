"""Windowed sync of a feed into items."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlake.operators.clean import clean_feed
from forumlake.operators.merge import merge_into, newest, upsert
from forumlake.schema import ITEM_COLUMNS, REFRESH_WINDOW, SYNC_BATCH, SYNC_GROUP
from forumlake.session import stage
from forumlake.sources.items import get_cursor, read_items, set_cursor
from forumlake.sources.manifest import FeedFiles

MODES = ("latest", "backfill")


@dataclass(frozen=True)
class Window:
    """Ids from ``start`` to ``end``, both included; none if start > end."""

    start: int
    end: int

    @property
    def is_empty(self) -> bool:
        return self.start > self.end


def latest_window(cursor: Column, head: Column, batch: Column) -> tuple[Column, Column]:
    """(start, end), at most ``batch`` ids. Works on a table of cursors.

    Near the head: the ids new since the cursor and a refresh of the newest ones,
    ending at the head. Further behind, the next ``batch`` ids after the cursor,
    so that no id is passed over; later runs catch up. Without a cursor, the
    newest ``batch`` ids.
    """
    behind = (cursor > 0) & (head - cursor > batch)
    fresh = F.least(cursor + 1, head - REFRESH_WINDOW + 1)
    wanted = F.when(cursor > 0, fresh).otherwise(head - batch + 1)
    start = F.when(behind, cursor + 1).otherwise(F.greatest(F.lit(1), wanted, head - batch + 1))
    return start, F.when(behind, cursor + batch).otherwise(head)


def backfill_window(cursor: Column, max_id: Column, head: Column, batch: Column) -> tuple[Column, Column]:
    """(start, end): the ``batch`` ids after the cursor, or after the highest
    stored id when there is no cursor yet, cut at the head."""
    start = F.when(cursor > 0, cursor).otherwise(max_id) + 1
    return start, F.least(start + batch - 1, head)


def resolve_window(spark: SparkSession, mode: str, cursor: int, max_id: int, head: int, batch: int = SYNC_BATCH, first: int | None = None) -> Window:
    """One run's window; ``first`` overrides its start."""
    if first is not None:
        start = max(1, first)
        return Window(start, min(start + batch - 1, head))
    numbers = [F.lit(n).cast("bigint") for n in (cursor, max_id, head, batch)]
    start, end = backfill_window(*numbers) if mode == "backfill" else latest_window(numbers[0], numbers[2], numbers[3])
    row = spark.range(1).select(start.alias("start"), end.alias("end")).first()
    return Window(row["start"], row["end"])


def story_list_ids(lists: DataFrame, head: int) -> DataFrame:
    """The distinct ids of all ranked lists, none above the head."""
    return lists.filter(F.col("id") <= head).select("id").distinct()


def wanted_ids(spark: SparkSession, mode: str, window: Window, lists: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """(priority, id) of a run: ids of the ranked lists first, then the window's
    others, newest first for ``latest`` and oldest first for ``backfill``."""
    ids = spark.range(window.start, window.end + 1)
    if mode == "backfill" or lists is None:
        return ids.select(F.lit(1).alias("priority"), "id")
    listed = story_list_ids(lists, window.end if head is None else head)
    others = ids.join(listed, "id", "left_anti")
    return listed.select(F.lit(0).alias("priority"), "id").unionByName(others.select(F.lit(1).alias("priority"), "id"))


def in_sync_order(wanted: DataFrame, mode: str) -> DataFrame:
    return wanted.orderBy("priority", F.col("id").asc() if mode == "backfill" else F.col("id").desc())


def groups_of(window: Window, size: int = SYNC_GROUP) -> list[Window]:
    """The window in pieces of ``size`` ids, to be committed one by one."""
    return [Window(s, min(s + size - 1, window.end)) for s in range(window.start, window.end + 1, size)]


def covered(cursor: int, max_id: int, window: Window, end: int, first: int | None) -> int:
    """The cursor once a run's window is merged up to ``end``.

    An overridden start neither takes the cursor back nor over ids that no run
    has asked for; a backfill without a cursor stands at the highest stored id."""
    if first is None:
        return end
    stands = cursor or max_id
    return max(stands, end) if window.start <= stands + 1 else stands


@dataclass(frozen=True)
class SyncResult:
    mode: str
    head: int
    window: Window | None
    fetched: int
    upserted: int
    cursor: int
    timed_out: bool = False


def changes_of(feed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest version of every wanted item of the feed, cleaned."""
    cleaned = clean_feed(latest_versions(feed.join(wanted.select("id"), "id", "left_semi")))
    return cleaned.select(*ITEM_COLUMNS)


def latest_versions(feed: DataFrame) -> DataFrame:
    """One row per id: the one of the file written last; rows of one file are
    told apart by their content, so every run keeps the same one."""
    version = F.struct("arrived", "file", F.xxhash64(*ITEM_COLUMNS))
    return newest(feed, version).select(*ITEM_COLUMNS)


def sync(
    items: DataFrame, feed: DataFrame, mode: str, cursor: int, head: int, batch: int = SYNC_BATCH, lists: DataFrame | None = None, first: int | None = None
) -> tuple[DataFrame, SyncResult]:
    """One run: (items after it, what it did). The cursor covers only ids that
    are part of the merged result."""
    if mode not in MODES:
        raise ValueError(f"unknown sync mode {mode!r}")
    spark = items.sparkSession
    max_id = items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if mode == "backfill" and not cursor else 0
    window = resolve_window(spark, mode, cursor, max_id, head, batch, first)
    if window.is_empty:
        return items, SyncResult(mode, head, None, 0, 0, cursor if mode == "backfill" or first is not None else head)
    wanted = wanted_ids(spark, mode, window, lists, head)
    found = feed.join(wanted.select("id"), "id", "left_semi")
    changes = changes_of(feed, wanted)
    fetched = found.select("id").distinct().count()
    upserted = changes.count()
    return upsert(items, changes), SyncResult(mode, head, window, fetched, upserted, covered(cursor, max_id, window, window.end, first))


def run_sync(
    spark: SparkSession,
    items_path: str,
    cursors_path: str,
    feed: DataFrame | FeedFiles,
    mode: str,
    head: int,
    batch: int = SYNC_BATCH,
    lists: DataFrame | None = None,
    group: int = SYNC_GROUP,
    out_of_time: Callable[[], bool] = lambda: False,
    first: int | None = None,
) -> SyncResult:
    """One bounded run on the stored items: group after group is merged until
    the window is done or the time is up, and the next run goes on from there.

    A backfill moves its cursor with every group. The groups of a ``latest`` run
    start at the newest end, after the ranked lists, so its cursor moves to the
    window's end only when all of them are merged: no id is passed over. Ids of
    the ranked lists are not asked for again with their group. The feed is read
    once a run; of a feed with a manifest (:class:`FeedFiles`, refreshed here) only the files that
    hold ids near the wanted ones. A run from ``first`` moves the cursor only if no id lies between.
    """
    if mode not in MODES:
        raise ValueError(f"unknown sync mode {mode!r}")
    cursor = get_cursor(spark, cursors_path, mode)
    max_id = read_items(spark, items_path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if mode == "backfill" and not cursor else 0
    window = resolve_window(spark, mode, cursor, max_id, head, batch, first)
    if window.is_empty:
        return SyncResult(mode, head, None, 0, 0, cursor if mode == "backfill" or first is not None else head)
    groups = groups_of(window, group)
    wanted = wanted_ids(spark, mode, window, lists, head)
    if isinstance(feed, FeedFiles):
        feed.refresh()
        listed = None if mode == "backfill" or lists is None else wanted.filter("priority = 0").select("id")
        feed = feed.rows(window.start, window.end, listed)
    found = stage(latest_versions(feed.join(wanted.select("id"), "id", "left_semi")).join(wanted, "id"), "fetched")
    parts = [(F.col("priority") == 1) & F.col("id").between(g.start, g.end) for g in groups]
    if mode == "latest":
        parts = [F.col("priority") == 0, *parts[::-1]]
    fetched = upserted = 0
    for n, part in enumerate(parts):
        if out_of_time():
            return SyncResult(mode, head, window, fetched, upserted, cursor, True)
        here = found.where(part).drop("priority")
        changes = stage(clean_feed(here), "changes")
        fetched += here.count()
        merged = changes.count()
        if merged:
            merge_into(items_path, changes)
        upserted += merged
        if mode == "backfill":
            cursor = covered(cursor, max_id, window, groups[n].end, first)
            set_cursor(spark, cursors_path, mode, cursor, upserted, datetime.now(timezone.utc))
    if mode == "latest":
        cursor = covered(cursor, max_id, window, window.end, first)
        set_cursor(spark, cursors_path, mode, cursor, upserted, datetime.now(timezone.utc))
    return SyncResult(mode, head, window, fetched, upserted, cursor)
