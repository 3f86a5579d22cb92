"""Positional postings and the corpus statistics that ranking needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.functions.runs import cut_packs, cut_runs
from forumlake.functions.stemming import remembered_terms
from forumlake.functions.text import known_config, search_document, words
from forumlake.schema import RANKED_TYPES

SCOPES = ("all", *RANKED_TYPES)
ROW = ("id", "type", "live", "time", "score")


def postings(items: DataFrame, config: str = "english") -> DataFrame:
    """One row per (id, term): id, type, live, time, score, term, tf, dl, positions.

    The sort keys of the other orders lie next to the words, so pages by date or
    score need no join.

    Each row's words are cut into runs inside the row, in Arrow and numpy, so a text
    of any length yields its postings without a shuffle.
    """
    return placed_runs(documents(items), config)


def documents(items: DataFrame) -> DataFrame:
    """Every item's sort keys and its words in order, in ``terms``."""
    return items.select(
        "id",
        "type",
        (~F.col("deleted") & ~F.col("dead")).alias("live"),
        F.col("time").cast("timestamp").alias("time"),
        "score",
        words(search_document()).alias("terms"),
    )


def pair_postings(items: DataFrame, config: str, frequent: list[str]) -> DataFrame:
    """Postings of pairs of neighbours of which one at least is a frequent word:
    the term is both words with a blank between, which no word holds. Rows as in
    :func:`postings`; a pair's position is its first word's."""
    return placed_runs(documents(items), config, frozenset(frequent))


def placed_runs(docs: DataFrame, config: str, frequent: frozenset[str] | None = None) -> DataFrame:
    """One row per id and distinct term of the words in ``terms``, or pair with a ``frequent`` word, with the places it holds.
    English words are stemmed where they are cut, so that no list of words crosses to Python twice."""
    names = remembered_terms if known_config(config) == "english" else None
    kinds = ", ".join(f"{name} {docs.schema[name].dataType.simpleString()}" for name in ROW)
    return docs.mapInArrow(cut_runs(ROW, frequent, names), f"{kinds}, term string, tf int, dl int, positions array<int>")


def packed(items: DataFrame, config: str, buckets: int, frequent: list[str] | None = None) -> DataFrame:
    """The rows of :func:`postings`, or of :func:`pair_postings` with ``frequent`` words, as few rows that are cheap to shuffle: those
    that a task cuts at once lie in one row for each type and ``bucket`` (:func:`bucket_of`), with each document's sort keys once."""
    docs = documents(items)
    names = remembered_terms if known_config(config) == "english" else None
    lists = ", ".join(f"{name} array<{docs.schema[name].dataType.simpleString()}>" for name in ROW if name != "type")
    more = "dl array<int>, terms string, until array<int>, doc array<smallint>, excess array<int>, near array<smallint>, far array<int>"
    cut = cut_packs(ROW, buckets, None if frequent is None else frozenset(frequent), names)
    return docs.mapInArrow(cut, f"type {docs.schema['type'].dataType.simpleString()}, bucket int, {lists}, {more}")


def unpacked(packs: DataFrame) -> DataFrame:
    """The postings in :func:`packed` rows, with their ``bucket``."""
    lists = [name for name in packs.columns if name != "terms"]
    one = packs.select(*lists, F.posexplode(F.split("terms", "\n")).alias("_k", "term"))
    k = F.col("_k")
    first = F.when(k == 0, F.lit(0)).otherwise(F.get("until", k - 1) + k)
    each = one.select(*lists, "term", F.explode(F.sequence(first, F.get("until", k) + k)).alias("_j"))
    doc, j = F.get("doc", F.col("_j")).cast("int"), F.col("_j")
    start = F.when(j == 0, F.lit(0)).otherwise(F.get("excess", j - 1) + j)
    tf = F.get("excess", j) + j + 1 - start
    places = F.when(F.size("far") > 0, F.slice("far", start + 1, tf)).otherwise(F.slice("near", start + 1, tf).cast("array<int>"))
    keys = [F.get(name, doc).alias(name) for name in ROW if name != "type"]
    return each.select("type", "bucket", *keys, "term", tf.alias("tf"), F.get("dl", doc).alias("dl"), places.alias("positions"))


def bucket_of(term: Column, buckets: int) -> Column:
    """As :func:`forumlake.functions.runs.ordered_words` deals terms."""
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def in_scope(scope: str) -> Column:
    """Whether a row belongs to a ranked scope: every row to ``all``, live rows
    of a ranked type also to that type's."""
    return F.lit(True) if scope == "all" else F.col("live") & (F.col("type") == scope)


def per_scope(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """One row per key and scope with the sums over the scope's rows. All scopes
    are summed in one pass, first where the rows lie, and split up afterwards."""
    aggs = [F.sum(F.when(in_scope(s), value)).alias(f"{name}_{s}") for s in SCOPES for name, value in sums.items()]
    wide = rows.groupBy(*keys).agg(*aggs)
    split = [F.struct(F.lit(s).alias("scope"), *[F.col(f"{name}_{s}").alias(name) for name in sums]) for s in SCOPES]
    long = wide.select(*keys, F.explode(F.array(*split)).alias("x")).select(*keys, "x.*")
    return long.filter(" OR ".join(f"{name} IS NOT NULL" for name in sums))


def term_stats(posts: DataFrame) -> DataFrame:
    """Documents per (scope, term). A term found in a third of all texts costs
    one row per task."""
    one = F.lit(1).cast("bigint")
    return per_scope(posts, ["term"], {"df": one})


def corpus_stats(items: DataFrame, posts: DataFrame) -> DataFrame:
    """Per scope: n documents and their total length, as additive sums."""
    none = F.lit(0).cast("bigint")
    docs = items.select("type", (~F.col("deleted") & ~F.col("dead")).alias("live"))
    counted = per_scope(docs, [], {"n": F.lit(1).cast("bigint")}).withColumn("total_dl", none)
    lengths = per_scope(posts, [], {"total_dl": F.col("tf").cast("bigint")}).withColumn("n", none)
    return counted.unionByName(lengths).groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total_dl").alias("total_dl"))
