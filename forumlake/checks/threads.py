"""Threads and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.checks.base import ITEMS, check, in_places
from forumlake.checks.browse import _stripped as stripped
from forumlake.corpus import items_view
from forumlake.operators import threads, tour
from forumlake.plans.lake import lake_of

WITH = f"WITH RECURSIVE {ITEMS}"

_DOWN = WITH + """, down(id, root, depth, path) AS (
  SELECT i.id, i.id, 0, [i.id] FROM items i WHERE {start}
  UNION ALL
  SELECT i.id, d.root, d.depth + 1, list_append(d.path, i.id) FROM items i JOIN down d ON i.parent = d.id)
"""
_ONE = _DOWN.replace("{start}", "i.id = 11")
_ALL = _DOWN.replace("{start}", "i.parent IS NULL OR i.parent NOT IN (SELECT id FROM items)")


def _thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = lake_of(spark, sf_dir)
    return tour.thread_rows(lake.items, lake.order, 11)


@check(
    "thread_one",
    f"""{_ONE} SELECT i.id, i.type, i."by" AS author, i.time, i.text, i.parent, i.deleted, i.dead, CAST(d.depth AS BIGINT) AS depth,
  array_to_string(d.path, '/') AS path FROM down d JOIN items i USING (id)""",
)
def _thread_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tour.with_paths(_thread(spark, sf_dir))
    path = F.array_join(F.col("path").cast("array<string>"), "/").alias("path")
    return rows.select("id", "type", F.col("by").alias("author"), "time", "text", "parent", "deleted", "dead", "depth", path)


@check(
    "thread_display",
    f"""{_ONE}, shown AS (SELECT i.*, d.depth, d.path FROM down d JOIN items i USING (id)), {stripped("shown", "text")}
SELECT id, parent, CAST(depth AS BIGINT) AS depth, coalesce(nullif("by", ''), 'deleted') AS author,
  CASE WHEN deleted THEN '[deleted]' ELSE coalesce(body, '') END AS body, row_number() OVER (ORDER BY path) AS position FROM stripped""",
)
def _thread_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _thread(spark, sf_dir)
    shown = threads.display_thread(rows, (F.col("place") + 1).alias("position"))
    return shown.orderBy("position")


@check(
    "thread_descendants",
    f"""{_DOWN.replace("{start}", "i.parent IS NULL OR i.parent NOT IN (SELECT id FROM items)")}, above AS (SELECT unnest(path) AS id FROM down)
SELECT id, count(*) - 1 AS descendants FROM above GROUP BY id""",
)
def _thread_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items below every item: the stretch of places that its subtree takes."""
    return lake_of(spark, sf_dir).order.places.select("id", (F.col("last") - F.col("place")).alias("descendants"))


@check("thread_order", f"""{_ALL}, numbered AS (SELECT id, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM down),
above AS (SELECT unnest(path) AS id FROM down), sizes AS (SELECT id, count(*) AS n FROM above GROUP BY id)
SELECT id, root, place, place + n - 1 AS last, CAST(depth AS BIGINT) AS depth FROM numbered JOIN sizes USING (id)""")
def _thread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, subtree end and depth of every item."""
    return tour.thread_order(items_view(spark, sf_dir))


@check("thread_all", f"{_ALL} SELECT id, root, CAST(depth AS BIGINT) AS depth FROM down")
def _thread_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.roots(items_view(spark, sf_dir))


@check("thread_sizes", f"{_ALL} SELECT root, count(*) AS items, CAST(max(depth) AS BIGINT) AS max_depth FROM down GROUP BY root")
def _thread_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.thread_sizes(threads.roots(items_view(spark, sf_dir)))


@check(
    "children",
    f"""{WITH} SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY id) AS position, id FROM items WHERE parent IS NOT NULL""",
)
def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.child_rows(items_view(spark, sf_dir))


@check("child_counts", f"{WITH} SELECT parent, count(*) AS children FROM items WHERE parent IS NOT NULL GROUP BY parent")
def _child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.child_counts(items_view(spark, sf_dir))
