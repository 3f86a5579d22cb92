"""The display order of every thread at once: an Euler tour, ranked by pointer doubling.

Walking a thread enters each item, then its children by id, then leaves it. Every entry and
every exit is an event that knows the event before it, so a thread is a list of events that
starts with the entry of its root. A round replaces an event's pointer by its predecessor's
pointer and adds up what lies between: entries, and entries less exits. After about
log2(2 * items) rounds every event knows the root, the entries before it (an item's place in
its thread) and the level it stands on. An item's subtree ends where its exit stands.

Each event is the predecessor of one event at most, so no round has a hot key. A
round writes only the events it moved. Items on or below a cycle have events without a start;
they get NULLs. An item whose parent is not in the table is a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from forumlake.operators.joins import fits_broadcast, lookup, rows_of
from forumlake.operators.projections import THREAD
from forumlake.schema import ID_BUCKET_WIDTH
from forumlake.session import fresh_path, stage

BLOCK = 1_000_000  # ids; the children of one item are ordered block by block
STATE = "event bigint, before bigint, entries bigint, level bigint, start bigint, round int"
ORDER = "root bigint, place bigint, last bigint, depth bigint, id bigint, root_bucket bigint"
PLACES = "id bigint, root bigint, place bigint, last bigint, depth bigint, id_bucket bigint"


def entry(id_):
    return id_ * 2


def exit_(id_):
    return id_ * 2 + 1


def with_parents(items: DataFrame) -> DataFrame:
    """(id, parent), without the parents that are not in the table."""
    nodes = stage(items.select("id", "parent"), "nodes")
    present = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("present"))
    linked = lookup(nodes.filter("parent IS NOT NULL"), present, "parent", nodes.count())
    linked = linked.select("id", F.when(F.col("present"), F.col("parent")).alias("parent"))
    return stage(linked.unionByName(nodes.filter("parent IS NULL")), "parents")


def events(nodes: DataFrame) -> DataFrame:
    """(event, before): every entry and exit and the event before it, NULL for the entry of a root."""
    children = nodes.filter("parent IS NOT NULL").withColumn("block", F.floor(F.col("id") / BLOCK))
    in_block = Window.partitionBy("parent", "block").orderBy("id")
    ends = children.groupBy("parent", "block").agg(F.max("id").alias("end"))
    by_block = Window.partitionBy("parent").orderBy("block")
    ends = ends.select("parent", "block", "end", F.lag("end").over(by_block).alias("end_before"), F.lead("block").over(by_block).isNull().alias("final"))
    younger = children.withColumn("own", F.lag("id").over(in_block)).join(ends, ["parent", "block"])
    sibling = F.coalesce("own", "end_before")
    entries = younger.select(entry(F.col("id")).alias("event"), F.coalesce(exit_(sibling), entry(F.col("parent"))).alias("before"))
    heads = nodes.filter("parent IS NULL").select(entry(F.col("id")).alias("event"), F.lit(None).cast("bigint").alias("before"))
    last_children = ends.filter("final").select(F.col("parent").alias("id"), "end")
    exits = nodes.select("id").join(last_children, "id", "left").select(exit_(F.col("id")).alias("event"), F.coalesce(exit_(F.col("end")), entry(F.col("id"))).alias("before"))
    return entries.unionByName(heads).unionByName(exits)


def thread_order(items: DataFrame) -> DataFrame:
    """(id, root, place, last, depth) of every item: its place in its thread from 0, and the last place below it."""
    spark = items.sparkSession
    nodes = with_parents(items)
    base = fresh_path(spark, "tour")
    entered = F.col("before") % 2 == 0
    head = F.col("before").isNull()
    rows = events(nodes).select(
        "event",
        "before",
        F.when(head, 0).when(entered, 1).otherwise(0).cast("bigint").alias("entries"),
        F.when(head, 0).when(entered, 1).otherwise(-1).cast("bigint").alias("level"),
        F.when(head, F.col("event")).alias("start"),
    )
    n, reach, total = 0, 1, 2 * nodes.count()
    while True:
        rows.write.parquet(f"{base}/round={n}")
        state = spark.read.schema(STATE).parquet(base).filter(F.col("start").isNotNull() | (F.col("round") == n)).drop("round")
        pending = state.filter("start IS NULL")
        # Past ``total`` steps back, whoever has not met a start never will.
        if reach > total or pending.isEmpty():
            break
        earlier = state.select(F.col("event").alias("before"), F.col("before").alias("next"), F.col("entries").alias("more"), F.col("level").alias("rise"), F.col("start").alias("found"))
        rows = pending.drop("start").join(earlier, "before").select(
            "event", F.col("next").alias("before"), (F.col("entries") + F.col("more")).alias("entries"), (F.col("level") + F.col("rise")).alias("level"), F.col("found").alias("start")
        )
        n, reach = n + 1, reach * 2
    is_entry = F.col("event") % 2 == 0
    settled = F.col("start").isNotNull()
    return state.groupBy(F.floor(F.col("event") / 2).alias("id")).agg(
        F.floor(F.max(F.col("start")) / 2).alias("root"),
        F.max(F.when(is_entry & settled, F.col("entries"))).alias("place"),
        (F.max(F.when(~is_entry & settled, F.col("entries"))) - 1).alias("last"),
        F.max(F.when(is_entry & settled, F.col("level"))).alias("depth"),
    )


class ThreadOrder:
    """The stored order: ``places`` by id, to find an item, and ``order`` by root and place, to read what lies below it."""

    def __init__(self, places: DataFrame, order: DataFrame) -> None:
        self.places, self.order = places, order

    def below(self, id_: int) -> DataFrame:
        """(id, depth, place, last) of an item and all below it, relative to it: one row is looked up, one range is read."""
        found = self.places.filter((F.col("id_bucket") == id_ // ID_BUCKET_WIDTH) & (F.col("id") == id_)).filter("root IS NOT NULL").take(1)
        if not found:
            return self.order.select("id", "depth", "place", "last").limit(0)
        at = found[0]
        inside = (F.col("root_bucket") == at["root"] // ID_BUCKET_WIDTH) & (F.col("root") == at["root"]) & F.col("place").between(at["place"], at["last"])
        rows = self.order.filter(inside)
        return rows.select("id", (F.col("depth") - at["depth"]).alias("depth"), (F.col("place") - at["place"]).alias("place"), (F.col("last") - at["place"]).alias("last"))


def build_order(items: DataFrame, path: str) -> ThreadOrder:
    """Writes the order of all threads. A thread of very many items is cut into several files by the rebalance."""
    rows = stage(thread_order(items), "thread-order")
    bucket = lambda name: F.floor(F.col(name) / ID_BUCKET_WIDTH).cast("bigint")
    places = rows.withColumn("id_bucket", bucket("id"))
    places.hint("rebalance", "id_bucket").sortWithinPartitions("id_bucket", "id").write.mode("overwrite").partitionBy("id_bucket").parquet(f"{path}/places")
    order = rows.filter("root IS NOT NULL").withColumn("root_bucket", bucket("root"))
    order.hint("rebalance", "root_bucket").sortWithinPartitions("root_bucket", "root", "place").write.mode("overwrite").partitionBy("root_bucket").parquet(f"{path}/order")
    return open_order(items.sparkSession, path)


def open_order(spark: SparkSession, path: str) -> ThreadOrder:
    return ThreadOrder(spark.read.schema(PLACES).parquet(f"{path}/places"), spark.read.schema(ORDER).parquet(f"{path}/order"))


def thread_rows(items: DataFrame, order: ThreadOrder, root_id: int) -> DataFrame:
    """The item and all its descendants, deleted ones included, with ``depth``, ``place`` and ``last``. Only ids travel; no row passes the driver
    but a few ids for the look-up in the stored items."""
    found = order.below(root_id)
    joined = rows_of(items, found) if fits_broadcast(found) else items.join(found, "id")
    return joined.select(*THREAD, "depth", "place", "last")


def with_paths(rows: DataFrame) -> DataFrame:
    """Adds ``path``, the ids from the first row down. An item is sent to the places below it, so the rows are as many as the ids in all paths."""
    above = rows.select(F.col("id").alias("above"), F.col("place").alias("from"), F.explode(F.sequence("place", "last")).alias("place"))
    paths = above.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("from", "above"))), lambda x: x["above"]).alias("path"))
    return rows.join(paths, "place")
