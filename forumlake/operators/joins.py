"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forumlake.schema import ID_BUCKET_WIDTH
from forumlake.session import stage

BROADCAST_ROWS = 100_000
SALTS = 64
HOT_KEYS = 10_000
HOT_ROWS = 100_000
LITERAL_IDS = 1_000


def count_up_to(df: DataFrame, max_rows: int) -> int:
    """The number of rows, or ``max_rows`` + 1 if there are more; reads no more."""
    return df.limit(max_rows + 1).count()


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return count_up_to(df, max_rows) <= max_rows


def join_small(
    large: DataFrame, small: DataFrame, on: list[str], salt_by: str, max_rows: int = BROADCAST_ROWS, rows: int | None = None
) -> DataFrame:
    """Inner join of a skewed table with a usually small one of narrow rows.

    Up to ``max_rows`` the small side is broadcast. Beyond it both sides are
    shuffled, with every key of the large side cut into ``SALTS`` parts by
    ``salt_by`` and the small side copied to each part. ``rows`` is the size of
    the small side where it is already known.
    """
    if fits_broadcast(small, max_rows) if rows is None else rows <= max_rows:
        return large.join(F.broadcast(small), on)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def hot_keys(df: DataFrame, key: str, total: int) -> list:
    """Keys holding more than 1/``HOT_KEYS`` of ``total`` rows: never more than
    ``HOT_KEYS`` of them, counted with one row per key and task."""
    limit = max(total // HOT_KEYS, HOT_ROWS)
    if total <= limit:
        return []
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > limit)
    return [row[0] for row in counted.collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Left join to a table with one row per ``key``.

    The right rows of hot left keys are broadcast, which takes one row per hot
    key; all other keys are shuffled in even parts.
    """
    hot = hot_keys(left, key, total)
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False))
    warm = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, "left")
    return left.filter(~is_hot).join(right, key, "left").unionByName(warm)


def rows_of(items: DataFrame, found: DataFrame) -> DataFrame:
    """The items of a few rows (id, ...) that fit a broadcast.

    Stored items are sorted by id inside id buckets: up to ``LITERAL_IDS`` ids
    are put into the filter, so that only the row groups holding them are read.
    """
    if "id_bucket" in items.columns:
        ids = [row["id"] for row in found.select("id").limit(LITERAL_IDS + 1).collect()]
        if len(ids) <= LITERAL_IDS:
            items = items.filter(F.col("id_bucket").isin(*{id_ // ID_BUCKET_WIDTH for id_ in ids}) & F.col("id").isin(*ids))
    return items.join(F.broadcast(found), "id")
