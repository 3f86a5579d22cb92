"""Result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.functions.cleaning import to_int, to_long
from forumlake.functions.display import snippet

HIT = ("id", "type", "by", "time", "url", "score", "title", "descendants", "parent")
THREAD = ("id", "type", "by", "time", "url", "score", "title", "text", "descendants", "parent", "deleted", "dead")


def snippet_column(with_snippet: bool) -> Column:
    return (snippet(F.col("text")) if with_snippet else F.lit(None).cast("string")).alias("snippet")


def hit_columns(df: DataFrame, with_snippet: bool, *extra: str) -> DataFrame:
    return df.select(*HIT, snippet_column(with_snippet), *extra)


def thread_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*THREAD, *extra)


def coerce_results(rows: DataFrame) -> DataFrame:
    """Typed results out of rows whose numbers came as text: what is no number
    is NULL, an id that is none is 0, an absent type is ''."""
    return rows.withColumns(
        {
            "id": F.coalesce(to_long(F.col("id")), F.lit(0)),
            "type": F.coalesce("type", F.lit("")),
            "score": to_int(F.col("score")),
            "descendants": to_int(F.col("descendants")),
            "parent": to_long(F.col("parent")),
        }
    )
