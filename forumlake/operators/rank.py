"""BM25."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The usual BM25 constants.
K1 = 1.2
B = 0.75


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def part(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What one term adds to a row's score, before its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weights(term_stats: DataFrame, corpus_stats: DataFrame) -> DataFrame:
    """(scope, term, df, idf, avgdl). There are at most four scopes, one row each,
    so the corpus side of the join is broadcast."""
    corpus = corpus_stats.select("scope", "n", (F.col("total_dl") / F.col("n")).alias("avgdl"))
    joined = term_stats.join(F.broadcast(corpus), "scope")
    return joined.select("scope", "term", "df", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")


def score() -> Column:
    """The score part of a posting joined to its term's weight."""
    return F.col("idf") * part(F.col("tf"), F.col("dl"), F.col("avgdl"))


@dataclass(frozen=True)
class TermCounts:
    """What one query needs of a scope's statistics: its documents, their total
    length, and the documents of each query term."""

    n: int
    total_dl: int
    df: dict[str, int]

    def idf(self, term: str) -> float:
        df = self.df.get(term, 0)
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def score(self, terms: list[str]) -> Column:
        """The score part of a posting of one of a few known terms."""
        if not terms or not self.total_dl:
            return F.lit(0.0)
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(self.idf(t))) for t in terms], F.lit(0.0))
        return weight * part(F.col("tf"), F.col("dl"), F.lit(self.total_dl / self.n))
