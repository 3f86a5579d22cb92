"""Raw rows to typed items, with nothing lost: what cannot be kept is told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.functions.cleaning import blank_to_null, strip_nul, to_bool, to_long, to_long_array, to_ts
from forumlake.schema import ITEM_COLUMNS, ITEM_TYPES

INT_MAX = 2**31 - 1
NO_LONGS = "array<bigint>"


def _typed(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """All 15 text columns by the column rules; integers still wide."""
    c = F.col
    return df.select(
        to_long(c("id")).alias("id"),
        to_bool(c("deleted")).alias("deleted"),
        F.lower(strip_nul(c("type"))).alias("type"),
        blank_to_null(c("by")).alias("by"),
        to_ts(c("time")).alias("time"),
        blank_to_null(c("text")).alias("text"),
        to_bool(c("dead")).alias("dead"),
        to_long(c("parent"), zero_as_null=True).alias("parent"),
        to_long(c("poll"), zero_as_null=True).alias("poll"),
        to_long_array(c("kids")).alias("kids"),
        blank_to_null(c("url")).alias("url"),
        to_long(c("score")).alias("score"),
        blank_to_null(c("title")).alias("title"),
        to_long_array(c("parts")).alias("parts"),
        to_long(c("descendants")).alias("descendants"),
        F.struct(*ITEM_COLUMNS).alias("raw"),
        *keep,
    )


def _reason(strict_type: Column) -> Column:
    def too_wide(name: str) -> Column:
        return F.abs(F.col(name)) > INT_MAX

    return (
        F.when(F.col("id").isNull(), "no numeric id")
        .when(~F.coalesce(strict_type, F.lit(False)), "unknown type")
        .when(too_wide("score"), "score out of range")
        .when(too_wide("descendants"), "descendants out of range")
    )


def _split(typed: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    judged = typed.withColumn("reject_reason", _reason(F.col("type").isin(*ITEM_TYPES)))
    ints = {"score": F.col("score").try_cast("int"), "descendants": F.col("descendants").try_cast("int")}
    good = judged.filter("reject_reason IS NULL").withColumns(ints).select(*ITEM_COLUMNS, *keep)
    rejected = judged.filter("reject_reason IS NOT NULL").select("reject_reason", "raw.*", *keep)
    return good, rejected


def split_dump(df: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of a dump read as text; rejected rows keep their raw
    values next to ``reject_reason``. Columns named in ``keep`` stay as they are."""
    return _split(_typed(df, keep), keep)


def clean_dump(df: DataFrame, *keep: str) -> DataFrame:
    return split_dump(df, *keep)[0]


def split_feed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of API items. Types must be spelled exactly; absent
    values become NULL, false or an empty list."""
    c = F.col

    def longs(name: str) -> Column:
        return F.coalesce(F.filter(c(name), lambda x: x.isNotNull()), F.array().cast(NO_LONGS)).alias(name)

    micros = (c("time") * 1_000_000).try_cast("bigint")
    typed = df.select(
        "id",
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        "type",
        blank_to_null(c("by")).alias("by"),
        F.timestamp_micros(micros).alias("time"),
        blank_to_null(c("text")).alias("text"),
        F.coalesce("dead", F.lit(False)).alias("dead"),
        "parent",
        "poll",
        longs("kids"),
        blank_to_null(c("url")).alias("url"),
        "score",
        blank_to_null(c("title")).alias("title"),
        longs("parts"),
        "descendants",
        F.struct(*ITEM_COLUMNS).alias("raw"),
    )
    return _split(typed)


def clean_feed(df: DataFrame) -> DataFrame:
    return split_feed(df)[0]


def check_items(items: DataFrame) -> DataFrame:
    """Violations of the table's rules as (rule, id, n); none for a sound table.

    The rules on single rows are judged in one pass. Repeated ids are found by a
    count, which adds up before the shuffle.
    """
    required = [name for name in ("id", "deleted", "type", "dead", "kids", "parts") if name in items.columns]
    judged = [F.when(~F.col("type").isin(*ITEM_TYPES), "unknown type")]
    judged += [F.when(F.col(name).isNull(), f"{name} is null") for name in required]
    one = F.lit(1).cast("bigint").alias("n")
    rows = items.select(F.explode(F.filter(F.array(*judged), lambda rule: rule.isNotNull())).alias("rule"), "id", one)
    repeated = items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 AND id IS NOT NULL")
    size = items.agg(F.count("*").alias("n")).filter("n = 0")
    empty = size.select(F.lit("empty table").alias("rule"), F.lit(None).cast("bigint").alias("id"), "n")
    return rows.unionByName(repeated.select(F.lit("repeated id").alias("rule"), "id", "n")).unionByName(empty)
