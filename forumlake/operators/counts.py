"""Counts: exact and estimated; load totals."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import DataFrame, functions as F

from forumlake.operators.match import Clause, Query
from forumlake.operators.rank import TermCounts


def full_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def corpus_size(items: DataFrame) -> DataFrame:
    """The number of items; NULL for an empty table."""
    return full_count(items).select(F.nullif("n", F.lit(0)).alias("n"))


def max_id(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


def share_of(query: Query, share: dict[str, float]) -> float:
    """The expected share of rows that match, words taken as independent."""

    def clause(c: Clause) -> float:
        found = prod(share[t] for t in {t for _, t in c.terms})
        return 1 - found if c.negated else found

    return 1 - prod(1 - prod(clause(c) for c in g) for g in query.groups)


def estimate_matches(query: Query, counts: TermCounts, rows: DataFrame) -> DataFrame:
    """One row ``estimate``: the number of rows (summed up in ``n``) times the
    expected share of text matches. Texts and postings are not read."""
    share = {t: counts.df.get(t, 0) / counts.n if counts.n else 0.0 for t in query.terms}
    expected = share_of(query, share) if query.groups else 0.0
    return rows.select(F.floor(F.col("n") * F.lit(expected) + 0.5).alias("estimate"))


def counted(matches: DataFrame, estimate: DataFrame) -> DataFrame:
    """One row (count, estimate): the exact number of matches next to the
    estimate. One-row tables are stacked and collapsed, which needs no join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (full_count(matches), estimate))
    return both.agg(F.max("n").alias("count"), F.max("estimate").alias("estimate"))


def load_totals(processed: DataFrame, inserted: DataFrame, shard: str) -> DataFrame:
    """Rows read and rows added per shard."""
    read = processed.groupBy(shard).agg(F.count("*").alias("processed"))
    added = inserted.groupBy(shard).agg(F.count("*").alias("inserted"))
    return read.join(added, shard, "left").select(shard, "processed", F.coalesce("inserted", F.lit(0)).alias("inserted"))
