"""The stored items table and its cursors."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from forumlake.operators.merge import add_bucket, write_buckets
from forumlake.schema import CURSORS, ID_BUCKET_WIDTH, ITEMS

_STORED = T.StructType([*ITEMS.fields, T.StructField("id_bucket", T.LongType())])


def write_items(df: DataFrame, path: str) -> None:
    """Replaces the whole table."""
    write_buckets(add_bucket(df), path, "overwrite", "static")


def read_items(spark: SparkSession, path: str, with_bucket: bool = False) -> DataFrame:
    rows = spark.read.schema(_STORED).parquet(path)
    return rows if with_bucket else rows.drop("id_bucket")


def get_item(spark: SparkSession, path: str, id_: int) -> DataFrame:
    """One item: the bucket prunes folders, the id prunes files and row groups."""
    rows = spark.read.schema(_STORED).parquet(path)
    return rows.filter((F.col("id_bucket") == id_ // ID_BUCKET_WIDTH) & (F.col("id") == id_)).drop("id_bucket")


def profile(items: DataFrame) -> DataFrame:
    """One row per column: its type, the table's rows, and its NULLs."""
    nulls = [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n_{i}") for i, f in enumerate(items.schema)]
    counted = items.agg(F.count("*").alias("rows"), *nulls)
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n_{i}").alias("nulls"))
        for i, f in enumerate(items.schema)
    ]
    return counted.select("rows", F.explode(F.array(*rows)).alias("c")).select("c.position", "c.column", "c.type", "rows", "c.nulls")


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of every key. A cursor is set by adding a row, so setting
    it never rewrites what another run may be reading."""
    rows = spark.read.schema(CURSORS).parquet(path)
    packed = rows.groupBy("key").agg(F.max_by(F.struct("last_id", "synced", "updated_at"), F.struct("updated_at", "last_id")).alias("r"))
    return packed.select("key", "r.*")


def get_cursor(spark: SparkSession, path: str, key: str) -> int:
    """The last id of a key; 0 when it was never set."""
    try:
        row = cursors(spark, path).filter(F.col("key") == key).first()
    except AnalysisException:  # nothing written yet
        row = None
    return row["last_id"] if row else 0


def set_cursor(spark: SparkSession, path: str, key: str, last_id: int, synced: int, at: datetime) -> None:
    row = spark.range(1).select(
        F.lit(key).alias("key"),
        F.lit(last_id).cast("bigint").alias("last_id"),
        F.lit(synced).cast("bigint").alias("synced"),
        F.lit(at).cast("timestamp").alias("updated_at"),
    )
    row.coalesce(1).write.mode("append").parquet(path)
