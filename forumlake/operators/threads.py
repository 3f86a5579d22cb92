"""Threads: everything below one item, and the root of every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.functions.display import thread_author, thread_text
from forumlake.operators.joins import LITERAL_IDS, fits_broadcast, join_small, lookup, rows_of
from forumlake.operators.ordering import grouped_positions
from forumlake.operators.projections import THREAD
from forumlake.schema import ID_BUCKET_WIDTH
from forumlake.session import fresh_path, stage

# What one small thread may bring to the driver: rows, and ids in all its paths.
SMALL_THREAD = 10_000
SMALL_PATHS = 1_000_000


def edges_of(items: DataFrame) -> DataFrame:
    """(parent, id) of every item that has a parent."""
    return items.filter("parent IS NOT NULL").select("parent", "id")


def edges_from(edges: DataFrame, parents: list[int]) -> DataFrame:
    """The edges of a few parents; literal ids prune stored edges to the folders
    and row groups that hold them."""
    if "bucket" in edges.columns:
        edges = edges.filter(F.col("bucket").isin(*{id_ // ID_BUCKET_WIDTH for id_ in parents}))
    return edges.filter(F.col("parent").isin(*parents))


def first_levels(edges: DataFrame, root_id: int, with_path: bool) -> tuple[list[tuple], bool]:
    """(id, path, depth) of the first levels of a thread, and whether they are
    all of it. One small job per level, for as long as the levels are small; the
    rows and paths brought to the driver are bounded."""
    found = [(root_id, [root_id] if with_path else [], 0)]
    level, room = {root_id: found[0][1]}, SMALL_PATHS
    while level:
        rows = edges_from(edges, list(level)).select("parent", "id").limit(LITERAL_IDS + 1).collect()
        below = {row["id"]: [*level[row["parent"]], row["id"]] if with_path else [] for row in rows}
        room -= sum(len(path) for path in below.values())
        if len(rows) > LITERAL_IDS or len(found) + len(rows) > SMALL_THREAD or room < 0:
            return found, False
        depth = found[-1][2] + 1
        found += [(id_, path, depth) for id_, path in below.items()]
        level = below
    return found, True


def thread(items: DataFrame, root_id: int, edges: DataFrame | None = None, with_path: bool = True) -> DataFrame:
    """The item and all its descendants, deleted ones included, with ``depth``
    and ``path`` (the ids from the root down, which orders the rows as shown).

    Level by level through ``edges``. Small first levels are looked up directly;
    from the first large level on, every level is a join whose result is kept in
    the shared folder: broadcast while it fits, salted by child beyond. Every
    item has one parent, so a cycle can only be met by coming back to the root,
    which is left out. Without the path nothing grows with the depth, for
    threads nested without limit.
    """
    spark = items.sparkSession
    edges = (edges_of(items) if edges is None else edges).filter(F.col("id") != root_id)
    if rows_of(items, spark.range(root_id, root_id + 1)).isEmpty():
        first, whole = [], True
    else:
        first, whole = first_levels(edges, root_id, with_path)
    found = spark.createDataFrame(first, "id bigint, path array<bigint>, depth bigint")
    if not whole:
        found = _further_levels(edges, found, first[-1][2], with_path)
    joined = rows_of(items, found) if whole or fits_broadcast(found) else items.join(found, "id")
    return joined.select(*THREAD, "depth", *(["path"] if with_path else []))


def _further_levels(edges: DataFrame, found: DataFrame, depth: int, with_path: bool) -> DataFrame:
    spark = edges.sparkSession
    base = fresh_path(spark, "thread")
    schema = "id bigint, path array<bigint>"
    found.repartition("depth").write.partitionBy("depth").parquet(base)
    while True:
        level = spark.read.schema(schema).parquet(f"{base}/depth={depth}").withColumnRenamed("id", "parent")
        ids = [row["parent"] for row in level.select("parent").limit(LITERAL_IDS + 1).collect()]
        if not ids:
            return spark.read.schema(f"{schema}, depth bigint").parquet(base)
        if len(ids) <= LITERAL_IDS:
            below = edges_from(edges, ids).join(F.broadcast(level), "parent")
        else:
            below = join_small(edges, level, ["parent"], salt_by="id")
        path = F.concat("path", F.array("id")) if with_path else F.col("path")
        depth += 1
        below.select("id", path.alias("path")).write.parquet(f"{base}/depth={depth}")


def in_order(thread_rows: DataFrame) -> DataFrame:
    return thread_rows.orderBy("path")


def display_thread(thread_rows: DataFrame, *more: Column) -> DataFrame:
    """Thread rows as shown: deleted texts and absent authors are masked."""
    return thread_rows.select(
        "id",
        "parent",
        "depth",
        thread_author(F.col("by")).alias("author"),
        thread_text(F.col("deleted"), F.col("text")).alias("body"),
        *more,
    )


def roots(items: DataFrame) -> DataFrame:
    """(id, root, depth) of every item, by pointer jumping.

    Each item points to an ancestor at a known distance; a round replaces the
    pointer by the ancestor's own pointer, so the distance doubles and a thread
    of depth d is settled after about log2(d) rounds. A round writes only the
    items it moved. An item whose parent is not in the table is a root. Items on
    or below a cycle never settle and get NULL. Ancestors that very many items
    point to are looked up apart from the others, so no round leaves them to
    one task.
    """
    spark = items.sparkSession
    base = fresh_path(spark, "roots")
    schema = "id bigint, up bigint, dist bigint, done boolean, round int"
    nodes = stage(items.select("id", "parent"), "edges")
    total = nodes.count()
    present = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("present"))
    linked = lookup(nodes.filter("parent IS NOT NULL"), present, "parent", total)
    tops = nodes.filter("parent IS NULL").withColumn("present", F.lit(False))
    is_root = ~F.coalesce("present", F.lit(False))
    rows = linked.unionByName(tops).select(
        "id",
        F.when(is_root, F.col("id")).otherwise(F.col("parent")).alias("up"),
        F.when(is_root, 0).otherwise(1).cast("bigint").alias("dist"),
        is_root.alias("done"),
    )
    n, reach = 0, 1
    while True:
        rows.write.parquet(f"{base}/round={n}")
        state = spark.read.schema(schema).parquet(base).filter(F.col("done") | (F.col("round") == n)).drop("round")
        pending = state.filter("NOT done")
        # Past ``total`` steps up, whoever has not met a root never will.
        if reach > total or pending.isEmpty():
            break
        ancestors = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("done").alias("next_done"))
        rows = lookup(pending, ancestors, "up", total).select(
            "id",
            F.col("next").alias("up"),
            (F.col("dist") + F.col("more")).alias("dist"),
            F.col("next_done").alias("done"),
        )
        n, reach = n + 1, reach * 2
    return state.select("id", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("dist")).alias("depth"))


def thread_sizes(root_rows: DataFrame) -> DataFrame:
    """Rows and depth per thread; counted before the shuffle, so one huge thread
    is as cheap as many small ones."""
    return root_rows.groupBy("root").agg(F.count("*").alias("items"), F.max("depth").alias("max_depth"))


def child_rows(items: DataFrame) -> DataFrame:
    """(parent, position, id): the children of every item in id order."""
    children = items.filter("parent IS NOT NULL").select("parent", "id")
    return grouped_positions(children, "parent").select("parent", "position", "id")


def child_counts(items: DataFrame) -> DataFrame:
    return items.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children"))


