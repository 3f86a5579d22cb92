"""Ordered access paths: the pages of a front page, a type, an author or a prefix
without a scan of the items.

Layout under one folder::

    time/, score/, author/, prefix/   range=   key and narrow result columns of the live rows
    bounds/                           layout=  per range: first and last key, rows, titled rows, times
    changes/                          batch=   the state of the rows changed since

Each layout is cut into ranges of (key, order); ranges are numbered in that order and
sorted inside. A page takes the ranges of its key from the first on until they are known
to hold enough rows, so it reads a few files whatever the corpus. There are at most
``MOST_RANGES`` ranges in a layout, so their bounds may be read by the driver.

Changed rows are kept apart: they void their ids in the layouts and are added to every
page that they suit. A range may have lost as many rows as were changed, so pages read
that many more; :func:`build_access` into a new folder folds the changes in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from forumlake.functions.requests import SINCE_DAYS, SearchFilters
from forumlake.operators import ordering
from forumlake.operators.filters import build_filter, by_author, has_prefix, is_live
from forumlake.operators.joins import fits_broadcast
from forumlake.operators.merge import newest
from forumlake.operators.projections import HIT
from forumlake.schema import ITEM_TYPES, ITEMS
from forumlake.session import stage

RANGE_ROWS = 50_000
FEW_RANGES = 64  # as many ranges may be smaller
MOST_RANGES = 4096

BOUNDS = "layout string, range int, low string, high string, n bigint, titled bigint, timeless bigint, oldest timestamp_ntz, latest timestamp_ntz"


def prefixes() -> Column:
    """The distinct first one and two characters of a row's title and author, lowered."""
    starts = [F.substring(F.lower(c), 1, n) for c in ("title", "by") for n in (1, 2)]
    return F.array_distinct(F.filter(F.array(*starts), lambda s: s != ""))


LAYOUTS = {
    "time": (lambda: F.col("type"), ordering.newest),
    "score": (lambda: F.col("type"), ordering.highest),
    "author": (lambda: F.col("by"), ordering.newest),
    "prefix": (lambda: F.explode(prefixes()), ordering.newest),
}


def layout_of(f: SearchFilters) -> str:
    """The layout that serves a search without full text."""
    if f.by:
        return "author"
    if f.text:
        return "prefix"
    return "score" if f.order == "score" else "time"


def keys_of(f: SearchFilters) -> list[str]:
    if f.by:
        return [f.by]
    if f.text:
        return [f.text.lower()]
    return [f.type] if f.type in ITEM_TYPES else list(ITEM_TYPES)


def ranges_for(rows: int, range_rows: int = RANGE_ROWS) -> int:
    """How many ranges a layout is cut into. Every range costs the driver its sampled rows and its file's
    entry, so beyond ``FEW_RANGES`` of them smaller ranges grow to ``RANGE_ROWS`` before there are more."""
    few = min(FEW_RANGES, -(-rows // range_rows))
    return min(MOST_RANGES, max(1, few, -(-rows // max(range_rows, RANGE_ROWS))))


def build_access(items: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> Access:
    """Writes the layouts of the live rows, one range shuffle each, and their
    bounds. Rows without an author or a title have no key of that kind."""
    access = Access(items.sparkSession, path, items.schema["time"].dataType.simpleString())
    rows = stage(items.filter(is_live()).select(*HIT), "narrow")
    for name, (key, order) in LAYOUTS.items():
        keyed = rows.select(key().alias("key"), *HIT).filter("key IS NOT NULL")
        laid = keyed.repartitionByRange(ranges_for(keyed.count(), range_rows), "key", *order()).withColumn("range", F.spark_partition_id())
        laid.sortWithinPartitions("range", "key", *order()).write.mode("overwrite").partitionBy("range").parquet(f"{path}/{name}")
        time = F.col("time").cast("timestamp_ntz")
        bounds = access.layout(name).groupBy("range").agg(
            F.min("key").alias("low"),
            F.max("key").alias("high"),
            F.count("*").alias("n"),
            F.count_if(F.col("title") != "").alias("titled"),
            F.count_if(time.isNull()).alias("timeless"),
            F.min(time).alias("oldest"),
            F.max(time).alias("latest"),
        )
        bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds/layout={name}")
    access.record(items.limit(0), -1)
    return access


def open_access(spark: SparkSession, path: str) -> Access:
    """The access paths of a stored items table."""
    return Access(spark, path, ITEMS["time"].dataType.simpleString())


@dataclass(frozen=True, eq=False)
class Access:
    spark: SparkSession
    path: str
    time_type: str

    @property
    def _narrow(self) -> str:
        kinds = {name: ITEMS[name].dataType.simpleString() for name in HIT} | {"time": self.time_type}
        return ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())

    def layout(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"key string, {self._narrow}, range int").parquet(f"{self.path}/{name}")

    def record(self, changes: DataFrame, batch: int) -> None:
        """Makes the rows of a batch (one per id) show in the pages of an access
        opened after it. Batches are numbered in their order; one that is
        replayed replaces itself."""
        rows = changes.select(*HIT, is_live().alias("live")).withColumn("time", F.col("time").cast(self.time_type))
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

    @cached_property
    def bounds(self) -> dict[str, list[Row]]:
        """Per layout its ranges in order, ``MOST_RANGES`` at most."""
        found: dict[str, list[Row]] = {name: [] for name in LAYOUTS}
        for row in self.spark.read.schema(BOUNDS).parquet(f"{self.path}/bounds").collect():
            found[row["layout"]].append(row)
        return {name: sorted(rows, key=lambda row: row["range"]) for name, rows in found.items()}

    @cached_property
    def changes(self) -> DataFrame:
        """The last state of every row changed since the layouts were written."""
        rows = self.spark.read.schema(f"{self._narrow}, live boolean, batch bigint").parquet(f"{self.path}/changes")
        return newest(rows, F.col("batch"))

    @cached_property
    def changed(self) -> int:
        return self.changes.count()

    def serves(self, f: SearchFilters) -> bool:
        """Whether the layouts hold the keys of a search. A prefix may grow as it is lowered."""
        return not f.is_full_text and len(f.text.lower()) <= 2

    def ranges(self, layout: str, keys: list[str], rows: int | None, least: Callable[[Row], int | None]) -> list[int]:
        """The ranges that hold the first ``rows`` rows of each key, or all of its
        rows. ``least`` says how many rows of a range count at least, None if none can."""
        wanted: set[int] = set()
        for key in keys:
            held = 0
            for bound in self.bounds[layout]:
                if rows is not None and held >= rows + self.changed:
                    break
                if bound["low"] <= key <= bound["high"] and (sure := least(bound)) is not None:
                    wanted.add(bound["range"])
                    held += sure if bound["low"] == bound["high"] else 0
        return sorted(wanted)

    def read(self, layout: str, keys: list[str], ranges: list[int]) -> DataFrame:
        """The live rows of some keys in some ranges, and all changed live rows."""
        table = self.layout(layout)
        found = table.filter(F.col("range").isin(*ranges) & F.col("key").isin(*keys)) if ranges else table.limit(0)
        if not self.changed:
            return found.select(*HIT)
        ids = self.changes.select("id")
        kept = found.select(*HIT).join(F.broadcast(ids) if fits_broadcast(ids) else ids, "id", "left_anti")
        return kept.select(*HIT).unionByName(self.changes.filter("live").select(*HIT))

    def rows(self, f: SearchFilters, as_of: datetime, rows: int) -> DataFrame:
        """Narrow rows of a search without full text, among them its first ``rows``."""
        layout, keys = layout_of(f), keys_of(f)
        in_order = f.order == ("score" if layout == "score" else "date")
        ranges = self.ranges(layout, keys, rows if in_order else None, lambda bound: _least(bound, f, as_of, layout))
        alive = {"deleted": F.lit(False), "dead": F.lit(False)}
        return self.read(layout, keys, ranges).withColumns(alive).filter(build_filter(f, as_of)).select(*HIT)

    def rows_of_author(self, author: str, rows: int) -> DataFrame:
        """Narrow rows of an author, titled or not, among them the newest ``rows``."""
        ranges = self.ranges("author", [author], rows, lambda bound: bound["n"])
        return self.read("author", [author], ranges).filter(by_author(author))

    def rows_with_prefix(self, prefix: str, rows: int) -> DataFrame:
        """Narrow rows whose title or author starts so, among them the newest ``rows``."""
        key = prefix.lower()
        ranges = self.ranges("prefix", [key], rows, lambda bound: bound["n"])
        return self.read("prefix", [key], ranges).filter(has_prefix(prefix))


def _least(bound: Row, f: SearchFilters, as_of: datetime, layout: str) -> int | None:
    """How many rows of a range of one key suit a search at least; None if no row can."""
    aged = f.since in SINCE_DAYS
    if aged and (bound["latest"] is None or bound["latest"] < f.cutoff(as_of)):
        return None
    if layout in ("author", "prefix") and (f.type in ITEM_TYPES or (f.by and f.text)):
        return 0  # types, and prefixes of one author, are not counted there
    if aged and (bound["timeless"] or bound["oldest"] < f.cutoff(as_of)):
        return 0
    return bound["n"] if layout == "prefix" or f.type == "comment" else bound["titled"]
