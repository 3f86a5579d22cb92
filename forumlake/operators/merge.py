"""Merging changes into items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.schema import ID_BUCKET_WIDTH
from forumlake.session import stage

LITERAL_BUCKETS = 10_000


def newest(rows: DataFrame, version: Column) -> DataFrame:
    """One row per id, the one with the greatest version. An aggregate, not a
    window: repeats of one id collapse before the shuffle."""
    columns = rows.columns
    packed = rows.select("id", F.struct(*columns).alias("_row"), version.alias("_version"))
    return packed.groupBy("id").agg(F.max_by("_row", "_version").alias("_row")).select("_row.*").select(*columns)


def upsert(items: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (one row per id) replace the rows of their ids, all columns;
    new ids are added."""
    kept = items.join(changes.select("id"), "id", "left_anti")
    return kept.select(*items.columns).unionByName(changes.select(*items.columns))


def absent(items: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose id is not in ``items``. Of several rows with
    one id the same one is kept on every run."""
    single = newest(new, F.xxhash64(*new.columns))
    return single.join(items.select("id"), "id", "left_anti").select(*new.columns)


def insert_if_absent(items: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows win."""
    return items.unionByName(absent(items, new).select(*items.columns))


def merge_into(path: str, changes: DataFrame) -> None:
    """Upsert into the stored items table: only the id buckets that ``changes``
    touch are read and rewritten.

    The new content is staged first and then swapped in bucket by bucket, so a
    run that dies can simply be repeated.
    """
    changes = add_bucket(changes)
    items = changes.sparkSession.read.schema(changes.schema).parquet(path)
    write_buckets(stage(upsert(touched_buckets(items, changes), changes), "merge"), path, "overwrite")


def append_absent(path: str, new: DataFrame) -> None:
    """Adds the rows whose ids the stored items table lacks; nothing is rewritten."""
    new = add_bucket(new)
    items = new.sparkSession.read.schema(new.schema).parquet(path)
    write_buckets(stage(absent(touched_buckets(items, new), new), "append"), path, "append")


def touched_buckets(items: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored rows in the id buckets of ``changes``. Up to ``LITERAL_BUCKETS``
    of them are named in the filter, which leaves all other folders unread."""
    touched = changes.select("id_bucket").distinct()
    named = [row["id_bucket"] for row in touched.limit(LITERAL_BUCKETS + 1).collect()]
    if len(named) <= LITERAL_BUCKETS:
        return items.filter(F.col("id_bucket").isin(*named)) if named else items.limit(0)
    return items.join(touched, "id_bucket", "left_semi")


def add_bucket(items: DataFrame) -> DataFrame:
    return items.withColumn("id_bucket", F.floor(F.col("id") / ID_BUCKET_WIDTH).cast("bigint"))


def write_buckets(items: DataFrame, path: str, mode: str, replaces: str = "dynamic") -> None:
    """One folder per id bucket; overfull buckets are cut into several files and
    ids are sorted inside each, so an id is found by its file's bounds. An
    overwrite replaces the buckets at hand (``dynamic``) or the table
    (``static``). Bloom filters let the pages of one author skip the row groups without them."""
    even = items.hint("rebalance", "id_bucket").sortWithinPartitions("id_bucket", "id")
    writer = even.write.mode(mode).option("partitionOverwriteMode", replaces).partitionBy("id_bucket")
    writer.option("parquet.bloom.filter.enabled#by", "true").option("parquet.bloom.filter.expected.ndv#by", "20000").parquet(path)

