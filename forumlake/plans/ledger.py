"""Loads in fixed id windows that can stop and go on."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from forumlake.operators.clean import clean_dump
from forumlake.operators.merge import append_absent
from forumlake.schema import ITEM_COLUMNS, LEDGER


def plan_shards(spark: SparkSession, start: int, end: int, width: int, ledger: DataFrame | None = None) -> DataFrame:
    """A ledger covering start to end in windows of ``width`` ids. Windows that
    an earlier ledger holds keep their state; of the others only the ids that no
    earlier window covers are planned, so every id lies in exactly one."""
    planned = spark.range(start, end + 1, width).select(F.col("id").alias("start"), F.least(F.col("id") + (width - 1), F.lit(end)).cast("bigint").alias("end"))
    if ledger is not None:
        planned = _uncovered(planned, ledger.select("start", "end"), start, end, width)
    planned = planned.select("start", "end", F.lit(0).cast("bigint").alias("rows"), F.lit(False).alias("fetched"), F.lit(False).alias("loaded"))
    return planned if ledger is None else ledger.unionByName(planned)


def _uncovered(planned: DataFrame, known: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """The parts of the planned windows that no known one covers. A known window
    is cut at the planned ones, so each of those sees at most ``width`` pieces."""
    cell = lambda at: F.floor((at - start) / width)
    inside = known.select(F.greatest("start", F.lit(start)).alias("s"), F.least("end", F.lit(end)).alias("e")).filter("s <= e")
    cut = inside.select("s", "e", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e")))).alias("cell"))
    held = cut.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("held"))
    cells = planned.withColumn("cell", cell(F.col("start"))).join(held, "cell", "left")
    held = F.coalesce("held", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    starts = F.concat(F.array("start"), F.transform(held, lambda x: x["e"] + 1))
    ends = F.concat(F.transform(held, lambda x: x["s"] - 1), F.array("end"))
    gaps = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(F.greatest(x["a"], F.col("start")).alias("s"), F.least(x["b"], F.col("end")).alias("e")))
    return cells.select(F.explode(F.filter(gaps, lambda x: x["s"] <= x["e"])).alias("gap")).select(F.col("gap.s").alias("start"), F.col("gap.e").alias("end"))


def pending_fetch(ledger: DataFrame, start: int, end: int) -> DataFrame:
    inside = (F.col("start") >= start) & (F.col("end") <= end)
    return ledger.filter(inside & ~F.col("fetched")).orderBy("start")


def pending_load(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("fetched") & ~F.col("loaded")).orderBy("start")


def shard_counts(ledger: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(start, end, rows, missing) per shard.

    Ids and shards meet in cells of ``width`` ids: a shard touches at most two,
    so this is an equi-join whatever the shards' starts, and a cell holds at
    most ``width`` ids.
    """
    cells = ledger.select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("cell"))
    ids = items.select("id", F.floor(F.col("id") / width).alias("cell"))
    inside = cells.join(ids, "cell").filter("id BETWEEN start AND end")
    counted = inside.groupBy("start").agg(F.count("*").alias("rows"))
    joined = ledger.select("start", "end").join(counted, "start", "left")
    rows = F.coalesce("rows", F.lit(0))
    return joined.select("start", "end", rows.alias("rows"), (F.col("end") - F.col("start") + 1 - rows).alias("missing"))


def missing_runs(ledger: DataFrame, items: DataFrame, width: int = 1_000) -> DataFrame:
    """(start, first_id, last_id): the stretches of ids of each shard that are
    not in the table.

    The present ids of a shard are put in order; a step of more than one is a
    gap. So there is a row for an id that is
    present and one for a cell of ``width`` planned ones, but none for a planned
    id. Ids and shards meet in cells as in :func:`shard_counts`. Inside
    a cell the ids themselves are put in order; between cells, their ends.
    """
    cell = lambda at: F.floor(at / width)
    spans = ledger.select("start", "end", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
    held = items.select("id", cell(F.col("id")).alias("cell"))
    inside = spans.join(held, "cell").filter("id BETWEEN start AND end").select("start", "cell", "id")
    # Stretches of cells without any id need no row each: gaps run from one filled cell to the next.
    met = inside.groupBy("start", "cell").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    by_cell = Window.partitionBy("start").orderBy("cell")
    edges = ledger.select("start", "end").join(met, "start", "left")
    before = F.coalesce(F.lag("high").over(by_cell), F.col("start") - 1)
    between = edges.withColumns({"before": before, "last": F.lead("cell").over(by_cell).isNull()})
    ahead = between.select("start", (F.col("before") + 1).alias("first_id"), (F.coalesce("low", F.col("end") + 1) - 1).alias("last_id"))
    behind = between.filter("last AND low IS NOT NULL").select("start", (F.col("high") + 1).alias("first_id"), F.col("end").alias("last_id"))
    step = F.lead("id").over(Window.partitionBy("start", "cell").orderBy("id"))
    within = inside.withColumn("next", step).filter("next - id > 1").select("start", (F.col("id") + 1).alias("first_id"), (F.col("next") - 1).alias("last_id"))
    return ahead.unionByName(behind).unionByName(within).filter("first_id <= last_id")


def missing_ids(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """(start, id): the ids of the shards that are not in the table; only gaps are expanded."""
    return missing_runs(ledger, items).select("start", F.explode(F.sequence("first_id", "last_id")).alias("id"))


def mark_fetched(ledger: DataFrame, shards: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Shards present in ``shards`` (with their rows counted) are fetched, and so
    are those whose ``start`` is in ``written``: a window may hold no row."""
    counted = shards.groupBy(F.col("shard_start").alias("start")).agg(F.count("*").alias("_n"))
    if written is not None:
        counted = counted.unionByName(written.select("start", F.lit(0).cast("bigint").alias("_n"))).groupBy("start").agg(F.sum("_n").alias("_n"))
    joined = ledger.join(counted, "start", "left")
    return joined.select(
        "start",
        "end",
        F.coalesce("_n", F.col("rows")).alias("rows"),
        (F.col("fetched") | F.col("_n").isNotNull()).alias("fetched"),
        "loaded",
    )


def clean_shards(raw: DataFrame) -> DataFrame:
    """Shard rows read as text, cleaned, still with the start of their shard."""
    return clean_dump(raw, "shard_start")


def load_shards(ledger: DataFrame, shards: DataFrame, items_path: str) -> DataFrame:
    """Adds the rows of all fetched, not yet loaded shards to the stored items
    and returns the ledger with them marked. Existing rows win, so loading a
    shard twice, or dying before the ledger is kept, changes nothing."""
    todo = ledger.filter(F.col("fetched") & ~F.col("loaded")).select(F.col("start").alias("shard_start"))
    rows = shards.join(todo, "shard_start", "left_semi").select(*ITEM_COLUMNS)
    append_absent(items_path, rows)
    return ledger.withColumn("loaded", F.col("loaded") | F.col("fetched"))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Adds the rows that differ from the stored ledger as its next version, and
    marks windows that it no longer has as gone. A write that dies is never visible."""
    spark = ledger.sparkSession
    held, version = _rows(spark, path), _version(spark, path) + 1
    now = ledger.select(*LEDGER.fieldNames())
    if version > 1:
        held = _newest(held)
        # Both sides have one row a window, so a window whose rows agree counts twice.
        both = held.withColumn("mine", F.lit(0)).unionByName(now.withColumn("mine", F.lit(1)))
        ends = both.groupBy(*LEDGER.fieldNames()).agg(F.count("*").alias("n"), F.max("mine").alias("mine")).filter("n = 1")
        changed = ends.groupBy("start").agg(F.max_by(F.struct(*LEDGER.fieldNames()[1:]), "mine").alias("row"), F.max("mine").alias("mine"))
        now = changed.select("start", "row.*", (F.col("mine") == 0).alias("gone"))
    else:
        now = now.withColumn("gone", F.lit(False))
    now.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every window."""
    return _newest(_rows(spark, path))


def fold_ledger(spark: SparkSession, path: str, folded: str) -> None:
    """The same ledger as one version in a new folder."""
    write_ledger(read_ledger(spark, path), folded)


def _newest(rows: DataFrame) -> DataFrame:
    row = F.max_by(F.struct("end", "rows", "fetched", "loaded", "gone"), "version").alias("row")
    last = rows.groupBy("start").agg(row).select("start", "row.*").filter("gone IS NOT TRUE").drop("gone")
    return last.select(*LEDGER.fieldNames())


def _rows(spark: SparkSession, path: str) -> DataFrame:
    about = [T.StructField("gone", T.BooleanType()), T.StructField("version", T.IntegerType())]
    schema = T.StructType([*LEDGER.fields, *about])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def _version(spark: SparkSession, path: str) -> int:
    return _rows(spark, path).agg(F.max("version")).first()[0] or 0
