"""Shards: gzipped CSV without a header, one folder per id window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlake.schema import ITEM_COLUMNS
from forumlake.sources.dump import CSV_OPTIONS, WRITE_OPTIONS

SHARD_OPTIONS = {**CSV_OPTIONS, "multiLine": "true"}


def _text(name: str) -> Column:
    col = F.col(name)
    if name in ("kids", "parts"):
        return F.concat(F.lit("{"), F.array_join(col.cast("array<string>"), ","), F.lit("}"))
    if name in ("deleted", "dead"):
        return F.when(col, "t").otherwise("f")
    if name == "time":
        return F.date_format(F.to_utc_timestamp(col.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return col.cast("string")


def write_shards(items: DataFrame, path: str, width: int, first: int = 1) -> None:
    """Writes ``items`` by windows of ``width`` ids counted from ``first``.

    A window holds at most ``width`` rows, so no task gets more than that per
    window. Files appear only when the write has committed; windows written
    before are replaced, others left alone.
    """
    start = F.floor((F.col("id") - first) / width) * width + first
    rows = items.select(start.cast("bigint").alias("shard_start"), *[_text(name).alias(name) for name in ITEM_COLUMNS])
    rows = rows.hint("rebalance", "shard_start").sortWithinPartitions("shard_start", "id")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_start")
    writer.options(**WRITE_OPTIONS, compression="gzip").csv(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All 15 columns as text plus ``shard_start``, ready for ``split_dump``."""
    schema = ", ".join(f"`{name}` string" for name in ITEM_COLUMNS)
    return spark.read.schema(f"{schema}, shard_start bigint").options(**SHARD_OPTIONS).csv(path)
