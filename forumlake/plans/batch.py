"""A table of queries against the whole corpus at once."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlake.operators import ordering, rank
from forumlake.operators.filters import is_live
from forumlake.operators.joins import BROADCAST_ROWS, count_up_to, fits_broadcast, join_small
from forumlake.operators.match import judged_rows, mark_clauses, query_clauses
from forumlake.plans.index import bucket_of
from forumlake.plans.lake import Lake
from forumlake.schema import ITEM_TYPES, RANKED_TYPES
from forumlake.session import stage

MOST_BLOCKS, LEAST_WIDTH = 4096, 1024  # blocks of ids, and ids in one
TASK_HITS = 2_000_000  # hits that a task sums where they are laid out by id


def searched_types(type_: Column) -> Column:
    """The item types a request covers, so that requests join rows by type."""
    return F.when(type_ == "all", F.array(*[F.lit(t) for t in ITEM_TYPES])).otherwise(F.array(type_))


def asked_terms(lake: Lake, queries: DataFrame, operators: bool = True) -> DataFrame:
    """The clause terms of every query with their weights, by searched type.
    Terms the corpus does not hold keep a row without a weight."""
    index = lake.index
    clauses = mark_clauses(query_clauses(queries, index.config, operators))
    scope = F.when(F.col("type").isin(*RANKED_TYPES), F.col("type")).otherwise("all")
    asked = clauses.join(queries.select("qid", "type", scope.alias("scope")), "qid")
    asked = stage(asked.withColumn("bucket", bucket_of(F.col("term"), index.buckets)), "clauses")
    stats = index.term_stats().join(asked.select("scope", "bucket", "term").distinct(), ["scope", "bucket", "term"], "left_semi")
    asked = asked.join(rank.weights(stats, index.corpus_stats()), ["scope", "term"], "left").drop("scope")
    searched = asked.withColumn("searched", searched_types(F.col("type"))).withColumn("type", F.explode("searched"))
    return stage(searched.withColumn("df", F.col("df") / F.size("searched")).drop("searched"), "asked")


def seeds(lake: Lake, asked: DataFrame, n: int) -> DataFrame | None:
    """(qid, id) of the rows that hold the rarest required term of a group: every
    match is among them. Terms that the corpus does not hold come first, and
    leave their group without any. None where most of the ``n`` terms are alone
    in their group, as nothing would be spared."""
    rarest = Window.partitionBy("qid", "grp", "type").orderBy(F.col("idf").desc_nulls_first(), "term")
    anchors = asked.filter("NOT negated").withColumn("_nth", F.row_number().over(rarest)).filter("_nth = 1")
    anchors = stage(anchors.select("qid", "type", "bucket", "term").distinct(), "anchors")
    rows = anchors.count()
    if rows * 2 > n:
        return None
    posts = lake.index.postings().filter("live").select("type", "bucket", "term", "id")
    return stage(join_small(posts, anchors, ["type", "bucket", "term"], salt_by="id", rows=rows).select("qid", "id").distinct(), "seeds")


def hits_by_id(posts: DataFrame, asked: DataFrame, found: DataFrame | None, hits: int) -> DataFrame:
    """``posts`` joined to few ``asked`` terms, all of a row's hits in one task: the postings of the
    terms are shuffled, each once, and not a row for every query that asks for them. Only the rows ``found``
    (qid, id) of each query are kept. A task sums about ``TASK_HITS`` of the ``hits``, whatever the corpus."""
    key = ["type", "bucket", "term"]
    parts = max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits // TASK_HITS))
    laid = posts.join(F.broadcast(asked.select(*key).distinct()), key, "left_semi").repartition(parts, "id")
    if found is None:
        return laid.join(F.broadcast(asked), key)
    wanted = found.repartition(parts, "id").groupBy("id").agg(F.collect_list("qid").alias("_qids"))
    return laid.join(wanted, "id").join(F.broadcast(asked), key).filter(F.array_contains("_qids", F.col("qid"))).drop("_qids")


def judged(lake: Lake, queries: DataFrame, operators: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The judged rows of a table (qid, q, type) that hold a term of their
    query, and (qid, type) of the queries with groups of exclusions alone."""
    asked = asked_terms(lake, queries, operators)
    size = asked.agg(F.count("*").alias("n"), F.bool_or(F.col("clause_size") > 1).alias("phrases"), F.bool_or(F.col("needed") == 0).alias("open"), F.max("group_size").alias("clauses"), F.sum("df").alias("hits")).first()
    posts = lake.index.postings().filter("live")
    hits = uncut = join_small(posts, asked, ["type", "bucket", "term"], salt_by="id", rows=size["n"])
    alone, phrases, laid = size["clauses"] == 1, bool(size["phrases"]), False
    found = None if size["open"] else seeds(lake, asked, size["n"])
    if found is not None and fits_broadcast(found):
        hits = hits.join(F.broadcast(found), ["qid", "id"], "left_semi")
    elif size["n"] <= BROADCAST_ROWS:
        hits, laid = hits_by_id(posts, asked, found, int(size["hits"] or 0)), True
    elif found is not None:
        # Both sides are laid out by query and row, as the sums need it.
        hits = hits.join(found, ["qid", "id"], "left_semi")
    hits = hits.withColumn("part", F.when(F.col("ranks"), rank.score()).otherwise(0.0))
    hits = hits if laid or alone or phrases else hits.repartition("qid", "id")
    rows = judged_rows(hits, phrases, alone, uncut)
    if not size["open"]:
        return rows, None
    open_queries = queries.select("qid", "type").join(asked.filter("needed = 0").select("qid").distinct(), "qid", "left_semi")
    return stage(rows, "judged"), stage(open_queries, "open-queries")


def batch_matches(lake: Lake, queries: DataFrame, operators: bool = True) -> DataFrame:
    """(qid, id, bm25) of all live matches of a table (qid, q, type). A group of
    exclusions alone matches most of the corpus, and all of that is returned:
    :func:`batch_search` and :func:`free_summary` do without."""
    rows, open_queries = judged(lake, queries, operators)
    found = rows.filter("ok").select("qid", "id", "bm25")
    if open_queries is None:
        return found
    blocks = LiveBlocks(lake.items)
    free = blocks.rows_in(blocks.free(open_queries, rows.filter("barred")))
    untouched = free.join(rows.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("bm25"))
    return found.unionByName(untouched)


def batch_search(lake: Lake, queries: DataFrame, k: int, operators: bool = True) -> DataFrame:
    """The k most relevant rows of every query: (qid, rank, id, bm25)."""
    rows, open_queries = judged(lake, queries, operators)
    found = rows.filter("ok").select("qid", "id", "bm25")
    if open_queries is not None:
        # Rows without any term of the query score nothing and come by id: the first k free ones are enough.
        found = found.unionByName(first_free(lake, rows, open_queries, k)).groupBy("qid", "id").agg(F.max("bm25").alias("bm25"))
    return ordering.top_per_group(found, "qid", ordering.most_relevant(), k)


class LiveBlocks:
    """Live rows counted by type and block of ids, so that what a query does not
    exclude is known block by block without a look at the rows. There are at most
    ``MOST_BLOCKS`` blocks, however many the ids."""

    def __init__(self, items: DataFrame) -> None:
        self.items = items.filter(is_live()).select("id", "type")
        top = items.agg(F.max("id")).first()[0] or 0
        self.width = max(LEAST_WIDTH, -(-(top + 1) // MOST_BLOCKS))
        self.block = F.floor(F.col("id") / self.width)
        counted = self.items.groupBy("type", self.block.alias("block")).agg(F.count("*").alias("n")).collect()  # MOST_BLOCKS a type
        counts: dict[str, Counter] = {type_: Counter() for type_ in (*ITEM_TYPES, "all")}
        for row in counted:
            counts["all"][row["block"]] += row["n"]
            if row["type"] in ITEM_TYPES:
                counts[row["type"]][row["block"]] += row["n"]
        listed = [x for type_, found in counts.items() for x in (F.lit(type_), _blocks(found))]
        self.counts = F.create_map(*listed)

    def free(self, open_queries: DataFrame, barred: DataFrame) -> DataFrame:
        """(qid, type, block, free, before): the blocks in which a query leaves
        rows free, how many, and how many in the blocks before."""
        shut = barred.groupBy("qid", self.block.alias("block")).agg(F.count("*").alias("shut"))
        blocks = open_queries.select("qid", "type", F.inline(F.element_at(self.counts, F.col("type"))))
        free = blocks.join(shut, ["qid", "block"], "left").withColumn("free", F.col("live") - F.coalesce("shut", F.lit(0))).filter("free > 0")
        before = F.sum("free").over(Window.partitionBy("qid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        free = free.select("qid", "type", "block", "free", F.coalesce(before, F.lit(0)).alias("before"))
        self.barred = barred.select("qid", "id")
        return free

    def rows_in(self, opened: DataFrame) -> DataFrame:
        """(qid, id): the rows that the queries leave free in some of their blocks."""
        wanted = stage(opened.select("qid", F.col("type").alias("asked"), "block"), "opened")
        n = count_up_to(wanted, BROADCAST_ROWS)
        rows = join_small(self.items.withColumn("block", self.block), wanted, ["block"], salt_by="id", rows=n)
        rows = rows.filter("asked = 'all' OR asked = type").select("qid", "id")
        return rows.join(shut_in(self.barred.withColumn("block", self.block), wanted, n).select("qid", "id"), ["qid", "id"], "left_anti")


def shut_in(barred: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The ``barred`` rows (qid, id, block) of the ``n`` blocks that are looked into, so that the others are not
    shuffled: they meet no row. Beyond a broadcast all of them stay."""
    if n > BROADCAST_ROWS:
        return barred.hint("merge")  # few bytes as a file may be many rows
    return barred.join(F.broadcast(wanted.select("qid", "block")), ["qid", "block"], "left_semi")


def _blocks(found: Counter) -> Column:
    kind = "array<struct<block: bigint, live: bigint>>"
    return F.from_json(F.lit(json.dumps([{"block": b, "live": n} for b, n in sorted(found.items())])), kind)


def first_free(lake: Lake, rows: DataFrame, open_queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, bm25): the first k rows that each query leaves free, from its
    first blocks with free rows."""
    blocks = LiveBlocks(lake.items)
    opened = blocks.free(open_queries, rows.filter("barred")).filter(F.col("before") < k)
    first = ordering.top_per_group(blocks.rows_in(opened), "qid", [F.col("id")], k)
    return first.select("qid", "id", F.lit(0.0).alias("bm25"))


def free_summary(lake: Lake, queries: DataFrame, operators: bool = True) -> DataFrame:
    """(qid, n, first_id, last_id) of the rows that the groups of exclusions
    alone leave free. Whole blocks are counted; only a query's first and last
    block with free rows are opened."""
    rows, open_queries = judged(lake, queries, operators)
    if open_queries is None:
        open_queries = queries.select("qid", "type").limit(0)
    blocks = LiveBlocks(lake.items)
    free = stage(blocks.free(open_queries, rows.filter("barred")), "free")
    ends = free.groupBy("qid", "type").agg(F.sum("free").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    opened = ends.select("qid", "type", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    found = blocks.rows_in(opened).groupBy("qid").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return ends.select("qid", "n").join(found, "qid")
