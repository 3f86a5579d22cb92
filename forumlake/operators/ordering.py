"""Orders and pages. ``id`` ends every order, so pages are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlake.schema import PAGE_SIZE
from forumlake.session import stage


def newest() -> list[Column]:
    return [F.col("time").desc_nulls_first(), F.col("id")]


def highest() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("time").desc_nulls_first(), F.col("id")]


def most_relevant() -> list[Column]:
    """Scores are sums in no fixed order: equal rows differ in the last digits."""
    return [F.round("bm25", 9).desc(), F.col("id")]


ORDERS = {"date": newest, "score": highest, "relevance": most_relevant}


SHALLOW = 10_000  # rows that one task may hold


def offset_of(page: int) -> int:
    return (page - 1) * PAGE_SIZE


def page_of(df: DataFrame, order: list[Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of ``df``. For a page near the top every task keeps only its best
    offset + size rows; further down the rows are sorted by ranges and counted
    range by range, so no task holds what lies before the page."""
    offset = offset_of(page)
    if offset + size <= SHALLOW:
        return df.orderBy(*order).offset(offset).limit(size)
    part, place = "_part", "_place"
    rows = stage(df.orderBy(*order).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)), "ordered")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"), F.min(place).alias("first")).orderBy(part).collect()  # one row a range
    wanted, before = F.lit(False), 0
    for row in sizes:
        low, high = max(offset - before, 0), min(offset + size - before, row["n"])
        if low < high:
            wanted |= (F.col(part) == row[part]) & F.col(place).between(row["first"] + low, row["first"] + high - 1)
        before += row["n"]
    return rows.where(wanted).drop(part, place)


def ranked(page_rows: DataFrame, order: list[Column], page: int) -> DataFrame:
    """Numbers the rows of one page (at most a page of them) from its offset."""
    index = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return page_rows.withColumn("rank", index + F.lit(offset_of(page)))


def page_flags(df: DataFrame, page: int) -> DataFrame:
    """Whether there is a page before and after; from the number of rows."""
    left = F.greatest(F.count("*") - F.lit(offset_of(page)), F.lit(0))
    seen = df.agg(F.least(left, F.lit(PAGE_SIZE + 1)).cast("bigint").alias("seen"))
    return seen.select(
        F.lit(page).cast("bigint").alias("page"),
        F.least(F.col("seen"), F.lit(PAGE_SIZE)).alias("rows"),
        F.lit(page > 1).alias("has_previous"),
        (F.col("seen") > PAGE_SIZE).alias("has_next"),
    )


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered; tasks cut groups to k rows
    before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def grouped_positions(df: DataFrame, group: str, width: int = 1_000_000) -> DataFrame:
    """Numbers the rows of each group by ``id`` in ``position``, from 1.

    A group is counted in id blocks of ``width`` and numbered block by block.
    Ids are unique, so no task ever orders more than ``width`` rows of a group,
    however large the group.
    """
    blocked = df.withColumn("_block", F.floor(F.col("id") / width))
    sizes = blocked.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(group, "_block").orderBy("id"))
    numbered = blocked.withColumn("_inner", inner).join(starts, [group, "_block"])
    return numbered.withColumn("position", (F.col("_start") + F.col("_inner")).cast("bigint")).drop("_block", "_start", "_inner")
