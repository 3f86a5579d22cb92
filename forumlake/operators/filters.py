"""Predicates on items and their composition into one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.functions.requests import SINCE_DAYS, SearchFilters
from forumlake.schema import ITEM_TYPES


def is_live() -> Column:
    return ~F.col("deleted") & ~F.col("dead")


def live(df: DataFrame) -> DataFrame:
    return df.filter(is_live())


def of_type(type_: str) -> Column:
    return F.col("type") == type_ if type_ in ITEM_TYPES else F.lit(True)


def by_author(author: str | None) -> Column:
    return F.col("by") == author if author else F.lit(True)


def since(window: str, as_of: datetime) -> Column:
    """Rows at or after the start of the window; rows without a time drop out."""
    if window not in SINCE_DAYS:
        return F.lit(True)
    return F.col("time") >= F.lit(SearchFilters(since=window).cutoff(as_of))


def has_prefix(q: str) -> Column:
    prefix = F.lower(F.lit(q))
    return F.lower("title").startswith(prefix) | F.lower("by").startswith(prefix)


def browsable(type_: str) -> Column:
    return F.lit(True) if type_ == "comment" else F.col("title") != ""


def residual(f: SearchFilters, as_of: datetime) -> Column:
    """The part of a full-text search that the postings cannot answer."""
    return by_author(f.by) & since(f.since, as_of)


def build_filter(f: SearchFilters, as_of: datetime) -> Column:
    """Everything but the text match of a full-text query."""
    clauses = is_live() & of_type(f.type) & residual(f, as_of)
    if f.is_full_text:
        return clauses
    return clauses & (has_prefix(f.text) if f.text else browsable(f.type))
