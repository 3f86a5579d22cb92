"""Counts of boolean queries from theta sketches of the ids that hold a word.

Sketches are intersected for words that must stand together, united for ``or`` and
subtracted for exclusions, so that words which like or shun each other are counted as
they are, where the product of their shares takes them as independent.

A sketch keeps about 2 ** ``LOG_SIZE`` ids and is exact below that many. Words with that
many live rows of a type have a stored sketch (64 KB at most, which is less than their
postings take); the ids of rarer ones are read from the postings, a bounded number a word.
Phrases count as all of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.operators.filters import is_live
from forumlake.operators.joins import join_small
from forumlake.operators.match import mark_clauses, query_clauses
from forumlake.plans.batch import searched_types
from forumlake.plans.index import SearchIndex, bucket_of
from forumlake.session import stage

LOG_SIZE = 12
DEVIATIONS = 2  # half the width of the bounds

TERM = ("type", "bucket", "term")
SKETCHES = "type string, bucket int, term string, n bigint, sketch binary"
WHOLE = "type string, n bigint, sketch binary"


@dataclass(frozen=True)
class Sketches:
    spark: SparkSession
    path: str
    index: SearchIndex
    log_size: int

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema(SKETCHES).parquet(f"{self.path}/terms")

    @property
    def whole(self) -> DataFrame:
        """One row per type: the sketch of its live rows."""
        return self.spark.read.schema(WHOLE).parquet(f"{self.path}/whole")


def sketched(rows: DataFrame, keys: tuple[str, ...], log_size: int) -> DataFrame:
    """The number of ids and their sketch by ``keys``; tasks sketch what they hold before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.theta_sketch_agg("id", log_size).alias("sketch"))


def build_sketches(index: SearchIndex, items: DataFrame, path: str, log_size: int = LOG_SIZE) -> Sketches:
    """Writes the sketches of an index as it is now; build them again after updates."""
    posts = index.postings().filter("live").select(*TERM, "id")
    often = stage(posts.groupBy(*TERM).count().filter(F.col("count") >= 2**log_size).select(*TERM), "often")
    held = sketched(join_small(posts, often, list(TERM), salt_by="id"), TERM, log_size)
    held.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    sketched(items.filter(is_live()).select("type", "id"), ("type",), log_size).write.mode("overwrite").parquet(f"{path}/whole")
    return Sketches(index.spark, path, index, log_size)


def sketch_of_terms(sketches: Sketches, asked: DataFrame) -> DataFrame:
    """(type, bucket, term, n, sketch) of the asked terms (one row each) that the corpus holds."""
    stored = sketches.terms.join(asked, list(TERM), "left_semi").select(*TERM, "n", "sketch")
    rare = stage(asked.join(sketches.terms.select(*TERM), list(TERM), "left_anti"), "rare")
    posts = sketches.index.postings().filter("live").select(*TERM, "id")
    return stored.unionByName(sketched(join_small(posts, rare, list(TERM), salt_by="id"), TERM, sketches.log_size))


def estimate_counts(sketches: Sketches, queries: DataFrame, operators: bool = True) -> DataFrame:
    """(qid, estimate, low, high) of a table (qid, q, type): how many live rows match, with bounds
    that hold in some 95 of 100 cases. Queries without a word count nothing."""
    index, size = sketches.index, 2**sketches.log_size
    clauses = mark_clauses(query_clauses(queries, index.config, operators)).withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    asked = clauses.join(queries.select("qid", F.explode(searched_types(F.col("type"))).alias("type")), "qid")
    asked = stage(asked, "asked")
    known = sketch_of_terms(sketches, asked.select(*TERM).distinct())
    whole = F.broadcast(sketches.whole.select("type", F.col("n").alias("rows"), F.col("sketch").alias("every")))  # one row a type
    found = asked.join(whole, "type").join(known, list(TERM), "left")

    # A word that the corpus lacks is held by no row.
    none = F.theta_difference("every", "every")
    found = found.withColumn("sketch", F.coalesce("sketch", none))
    group = ["qid", "type", "grp"]
    per_clause = found.groupBy(*group, "clause", "negated", "needed").agg(F.theta_intersection_agg("sketch").alias("sketch"), F.max("n").alias("n"))
    per_clause = stage(per_clause, "clauses")
    held = per_clause.filter("NOT negated").groupBy(*group).agg(F.theta_intersection_agg("sketch").alias("held"), F.max("n").alias("n_held"))
    barred = per_clause.filter("negated").groupBy(*group).agg(F.theta_union_agg("sketch", sketches.log_size).alias("barred"), F.max("n").alias("n_barred"))
    groups = per_clause.select(*group).distinct().join(held, group, "left").join(barred, group, "left").join(whole, "type")
    start = F.coalesce("held", "every")
    left = F.when(F.col("barred").isNull(), start).otherwise(F.theta_difference(start, F.coalesce("barred", "every")))
    most = F.greatest(F.when(F.col("held").isNull(), F.col("rows")), "n_held", "n_barred")
    per_query = groups.select("qid", left.alias("left"), most.alias("most")).groupBy("qid")
    counted = per_query.agg(F.theta_sketch_estimate(F.theta_union_agg("left", sketches.log_size)).alias("estimate"), F.max("most").alias("most"))

    # A sketch of n ids keeps each with a chance of size / n at least, so its estimate spreads like a binomial count.
    chance = F.least(F.lit(1.0), F.lit(float(size)) / F.greatest("most", "estimate", F.lit(1)))
    half = DEVIATIONS * F.sqrt((F.col("estimate") * chance + 1) * (1 - chance)) / chance
    bounded = counted.select(
        "qid",
        "estimate",
        F.greatest(F.floor(F.col("estimate") - half), F.lit(0)).alias("low"),
        F.ceil(F.col("estimate") + half).alias("high"),
    )
    zero = F.lit(0).cast("bigint")
    filled = [F.coalesce(c, zero).alias(c) for c in ("estimate", "low", "high")]
    return queries.select("qid").join(bounded, "qid", "left").select("qid", *filled)
