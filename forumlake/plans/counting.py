"""The match count of a search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from forumlake.functions.requests import SearchFilters
from forumlake.operators.counts import counted, estimate_matches, full_count
from forumlake.operators.filters import build_filter
from forumlake.operators.match import Query, analyse_query
from forumlake.plans.lake import Lake
from forumlake.plans.search import matches
from forumlake.schema import RANKED_TYPES


def _whole_scope(f: SearchFilters) -> bool:
    """Whether the request covers the live rows of a ranked type, whose number the index holds."""
    return f.type in RANKED_TYPES and not f.by and f.since == "all"


def estimate(lake: Lake, f: SearchFilters, as_of: datetime) -> DataFrame:
    """Expected matches from the stored statistics. The rows are counted, in a
    scan of the filter's columns, only where the index does not hold their number."""
    if not f.is_full_text:
        return lake.items.filter(build_filter(f, as_of)).agg(F.count("*").alias("estimate"))
    query = analyse_query(lake.spark, f.text, lake.index.config)
    counts = lake.index.counts(query.terms, f.scope)
    rows = lake.index.corpus_stats().filter(F.col("scope") == f.scope).select("n") if _whole_scope(f) else full_count(lake.items.filter(build_filter(f, as_of)))
    return estimate_matches(query, counts, rows)


def _one_word(query: Query) -> str | None:
    """The word, where the query is one word and nothing else."""
    if len(query.groups) == 1 and len(query.groups[0]) == 1:
        clause = query.groups[0][0]
        if not clause.negated and len(clause.terms) == 1:
            return clause.terms[0][1]
    return None


def match_count(lake: Lake, f: SearchFilters, as_of: datetime) -> DataFrame:
    """(count, estimate): always the exact number of matches, next to what the
    statistics say; both NULL when browsing. The document frequency of a word is
    its number of matches, so one word alone reads no postings."""
    if not f.q:
        null = F.lit(None).cast("bigint")
        return lake.spark.range(1).select(null.alias("count"), null.alias("estimate"))
    if f.is_full_text and _whole_scope(f):
        word = _one_word(analyse_query(lake.spark, f.text, lake.index.config))
        if word is not None:
            found = lake.index.term_stats([word], f.scope).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("count"))
            return found.select("count", F.col("count").alias("estimate"))
    return counted(matches(lake, f, as_of).select("id"), estimate(lake, f, as_of))
