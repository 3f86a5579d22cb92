"""Boolean text match over postings, for one query and for a table of queries.

A query is a set of groups joined by OR; a group is a set of clauses joined by
AND; a clause is a word or a phrase, possibly excluded.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from forumlake.functions.text import terms, words
from forumlake.operators.joins import fits_broadcast
from forumlake.session import stage

# Fixed value: the pieces of a query text - quoted phrases and bare words.
PIECE = r'(-?"[^"]*"?|[^\s"]+)'


def query_clauses(queries: DataFrame, config: str = "english", operators: bool = True) -> DataFrame:
    """The clauses of a table (qid, q): one row per term, with its group, its
    clause, its offset inside the clause and whether the clause is excluded.

    Without ``operators`` every word is required and quotes, ``-`` and ``or``
    have no meaning. Windows and arrays here span one query text only.
    """
    if operators:
        pieces = F.regexp_extract_all("q", F.lit(PIECE), F.lit(1))
    else:
        pieces = words(F.col("q"))
    df = queries.select("qid", pieces.alias("pieces"))
    if operators:
        # An "or" joins what is before and after it unless one side is missing.
        def follow(state, piece):
            joins = (F.lower(piece) == "or") & ~state["joins"] & (state["at"] + 1 < F.size("pieces"))
            grp = state["grp"] + joins.cast("int")
            return F.struct(
                joins.alias("joins"),
                (state["at"] + 1).alias("at"),
                grp.alias("grp"),
                F.concat(state["out"], F.array(F.when(joins, F.lit(-1)).otherwise(grp))).alias("out"),
            )

        start = F.struct(F.lit(True).alias("joins"), F.lit(0).alias("at"), F.lit(0).alias("grp"), F.array().cast("array<int>").alias("out"))
        df = df.withColumn("groups", F.aggregate("pieces", start, follow)["out"])
        df = df.select("qid", F.posexplode(F.arrays_zip("pieces", "groups")).alias("clause", "x"))
        df = df.select("qid", "clause", F.col("x.groups").alias("grp"), F.col("x.pieces").alias("piece")).filter("grp >= 0")
        df = df.withColumn("negated", F.col("piece").startswith("-"))
    else:
        df = df.select("qid", F.posexplode("pieces").alias("clause", "piece")).withColumns({"grp": F.lit(0), "negated": F.lit(False)})
    df = df.select("qid", "grp", "clause", "negated", F.posexplode(terms(words(F.col("piece")), config)).alias("off", "term"))
    return df.filter("term IS NOT NULL")


@dataclass(frozen=True)
class Clause:
    negated: bool
    terms: tuple[tuple[int, str], ...]


@dataclass(frozen=True)
class Query:
    """One analysed query. No groups means that nothing can match."""

    groups: tuple[tuple[Clause, ...], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({t for g in self.groups for c in g for _, t in c.terms})

    @property
    def ranking_terms(self) -> list[str]:
        return sorted({t for g in self.groups for c in g if not c.negated for _, t in c.terms})

    @property
    def has_phrases(self) -> bool:
        return any(len(c.terms) > 1 for g in self.groups for c in g)

    def placed_terms(self, frequent: frozenset[str] = frozenset()) -> list[str]:
        """The words and pairs whose positions tell where the query's phrases stand."""
        return sorted({t for g in self.groups for c in g if len(c.terms) > 1 for _, t in cover(c.terms, frequent)})

    def anchors(self, df: dict[str, int]) -> list[str] | None:
        """Per group, the rarest of its required terms: every match holds one of
        them. None where a group requires nothing."""
        required = [[t for c in g if not c.negated for _, t in c.terms] for g in self.groups]
        if not all(required):
            return None
        return sorted({min(ts, key=lambda t: (df.get(t, 0), t)) for ts in required})

    @property
    def needs_all_rows(self) -> bool:
        """Whether rows without any of the terms can match."""
        return any(all(c.negated for c in g) for g in self.groups)


def cover(phrase: tuple[tuple[int, str], ...], frequent: frozenset[str]) -> list[tuple[int, str]]:
    """The (offset, term) whose positions place a phrase. A frequent word is read
    as a pair with a neighbour, a rare one if it can, so that its own positions
    are needed only where the phrase leaves it without neighbours."""
    at = dict(phrase)
    units, covered = {}, set()
    for off, term in phrase:
        if term in frequent and off not in covered:
            beside = [o for o in (off - 1, off + 1) if o in at]
            if beside:
                partner = min(beside, key=lambda o: (at[o] in frequent, o in covered, o))
                first = min(off, partner)
                units[first] = f"{at[first]} {at[first + 1]}"
                covered |= {off, partner}
    single = {off: term for off, term in phrase if off not in covered}
    return sorted([*units.items(), *single.items()])


def analyse_query(spark: SparkSession, q: str, config: str = "english", operators: bool = True) -> Query:
    """The clauses of one query text, brought to the driver: a few rows."""
    table = spark.range(1).select(F.lit(0).alias("qid"), F.lit(q).alias("q"))
    clauses: dict[tuple[int, int], list] = defaultdict(list)
    for row in query_clauses(table, config, operators).collect():
        clauses[row["grp"], row["clause"]].append(row)
    groups: dict[int, list[Clause]] = defaultdict(list)
    for (grp, _), rows in sorted(clauses.items()):
        found = tuple(sorted((r["off"], r["term"]) for r in rows))
        groups[grp].append(Clause(rows[0]["negated"], found))
    return Query(tuple(tuple(groups[g]) for g in sorted(groups)))


def shift(positions: Column, offset: int) -> Column:
    return F.transform(positions, lambda p: p - offset)


def phrase_found(arrays: list[Column]) -> Column:
    """Whether shifted position arrays share a start."""
    return F.size(reduce(F.array_intersect, arrays)) > 0


def matched(query: Query, present: dict[str, Column], positions: dict[str, Column], frequent: frozenset[str] = frozenset()) -> Column:
    """The query over one row that knows which terms are present, and where."""

    def clause(c: Clause) -> Column:
        found = reduce(and_, [present[t] for _, t in c.terms])
        if len(c.terms) > 1:
            shifted = [shift(positions[t], off) for off, t in cover(c.terms, frequent)]
            found = F.coalesce(found & phrase_found(shifted), F.lit(False))
        return ~found if c.negated else found

    return reduce(or_, [reduce(and_, [clause(c) for c in g]) for g in query.groups])


def match(
    posts: DataFrame,
    query: Query,
    score: Column | None = None,
    all_rows: DataFrame | None = None,
    keys: tuple[str, ...] = (),
    frequent: frozenset[str] = frozenset(),
) -> DataFrame:
    """Ids matching one query, with their summed ``bm25`` and the row's ``keys``.

    ``posts`` holds the postings of the query's terms only, and of the pairs that
    stand for ``frequent`` words in its phrases. One shuffle on id
    brings the terms of a row together; a frequent term is spread over all
    tasks by it. ``all_rows`` (ids and keys) is read only when a group has nothing but
    exclusions.
    """
    placed = query.placed_terms(frequent)
    aggs = [F.sum(F.lit(0.0) if score is None else score).alias("bm25")]
    aggs += [F.bool_or(F.col("term") == t).alias(f"has_{i}") for i, t in enumerate(query.terms)]
    aggs += [F.any_value(F.when(F.col("term") == t, F.col("positions")), F.lit(True)).alias(f"at_{i}") for i, t in enumerate(placed)]
    aggs += [F.max(key).alias(key) for key in keys]
    rows = posts.groupBy("id").agg(*aggs)
    if query.needs_all_rows:
        if all_rows is None:
            raise ValueError("a query of exclusions alone needs the table of all rows")
        rows = all_rows.select("id", *keys).join(rows.drop(*keys), "id", "left")
    present = {t: F.coalesce(F.col(f"has_{i}"), F.lit(False)) for i, t in enumerate(query.terms)}
    positions = {t: F.col(f"at_{i}") for i, t in enumerate(placed)}
    return rows.filter(matched(query, present, positions, frequent)).select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), *keys)


def mark_clauses(clauses: DataFrame) -> DataFrame:
    """Adds what evaluating a table of queries needs: the words of each clause
    (``clause_size``), all and the required clauses of each group (``group_size``, ``needed``), the
    groups of its query that require nothing (``open_groups``), and ``ranks`` on
    one row per distinct term that is not excluded. The windows span one query
    text each."""
    group = Window.partitionBy("qid", "grp")
    first = Window.partitionBy("qid", "term").orderBy("negated", "grp", "clause", "off")
    marked = clauses.withColumns(
        {
            "clause_size": F.count("*").over(Window.partitionBy("qid", "grp", "clause")),
            "group_size": F.size(F.collect_set("clause").over(group)),
            "needed": F.size(F.collect_set(F.when(~F.col("negated"), F.col("clause"))).over(group)),
            "ranks": (F.row_number().over(first) == 1) & ~F.col("negated"),
        }
    )
    free = F.size(F.collect_set(F.when(F.col("needed") == 0, F.col("grp"))).over(Window.partitionBy("qid")))
    return marked.withColumn("open_groups", free)


GROUP_KEYS = ("qid", "id", "grp", "negated", "needed", "open_groups")


def phrase_hits(hits: DataFrame, uncut: DataFrame) -> DataFrame:
    """One row per phrase and row holding one of its words; ``ok`` where the
    words stand as in the phrase. ``uncut`` is ``hits`` as they are before rows were left out.

    Words are counted first, without their positions. Only rows that hold every
    word of a phrase have positions fetched and compared, so those of frequent
    words are gathered for the few rows that a phrase's rarest words leave over.
    """
    row = ["qid", "id", "clause"]
    found = stage(hits.groupBy(*GROUP_KEYS, "clause", "clause_size").agg(F.count("*").alias("n"), F.sum("part").alias("part")), "phrase-words")
    whole = found.filter("n = clause_size").select(*row)
    if fits_broadcast(whole):
        whole = F.broadcast(whole)
    else:  # postings of other rows are left out before they meet the queries
        uncut = uncut.join(whole.select("id").distinct(), "id", "left_semi")
    starts = F.transform("positions", lambda p: p - F.col("off"))
    at = uncut.select(*row, "off", "positions").join(whole, row, "left_semi").groupBy(*row).agg(F.collect_list(starts).alias("starts"))
    common = F.aggregate("starts", F.get("starts", F.lit(0)), F.array_intersect)
    standing = at.filter(F.size(common) > 0).select(*row, F.lit(True).alias("ok"))
    return found.join(standing, row, "left").select(*GROUP_KEYS, "part", F.coalesce("ok", F.lit(False)).alias("ok"))


def judged_rows(hits: DataFrame, has_phrases: bool, alone: bool = False, uncut: DataFrame | None = None) -> DataFrame:
    """(qid, id, ok, barred, bm25) of the rows that hold a term of a query.

    ``hits`` is postings joined to marked clauses, one row per clause term found
    in a row, with its score part in ``part``. They come laid out by id, or by
    (qid, id), which both steps reuse: from clauses to groups, from groups to
    rows; next to phrases they are laid out here. Only phrase words carry their positions. A row matches if it meets a
    group that requires something, or if a group of exclusions alone leaves it
    free; it is ``barred`` if there are such groups and all of them exclude it.
    Where every clause is ``alone`` in its group, groups need no step of their own.
    """
    found = hits.filter("clause_size = 1") if has_phrases else hits
    found = found.select(*GROUP_KEYS, "part", F.lit(True).alias("ok"))
    if has_phrases:
        found = found.unionByName(phrase_hits(hits.filter("clause_size > 1"), (hits if uncut is None else uncut).filter("clause_size > 1")))
    if alone:
        per_row = found.groupBy("qid", "id").agg(
            F.bool_or(F.col("ok") & ~F.col("negated")).alias("met"),
            F.count_if(F.col("ok") & F.col("negated")).alias("shut"),
            F.max("open_groups").alias("open_groups"),
            F.sum("part").alias("bm25"),
        )
        return _judged(per_row)
    per_group = (found.repartition("qid", "id") if has_phrases else found).groupBy("qid", "id", "grp").agg(
        F.max("needed").alias("needed"),
        F.max("open_groups").alias("open_groups"),
        F.count_if(F.col("ok") & ~F.col("negated")).alias("met"),
        F.count_if(F.col("ok") & F.col("negated")).alias("broken"),
        F.sum("part").alias("part"),
    )
    met = (F.col("needed") > 0) & (F.col("met") == F.col("needed")) & (F.col("broken") == 0)
    shut = (F.col("needed") == 0) & (F.col("broken") > 0)
    per_row = per_group.groupBy("qid", "id").agg(
        F.bool_or(met).alias("met"), F.count_if(shut).alias("shut"), F.max("open_groups").alias("open_groups"), F.sum("part").alias("bm25")
    )
    return _judged(per_row)


def _judged(per_row: DataFrame) -> DataFrame:
    barred = (F.col("open_groups") > 0) & (F.col("shut") == F.col("open_groups"))
    free = (F.col("open_groups") > 0) & (F.col("shut") < F.col("open_groups"))
    return per_row.select("qid", "id", (F.col("met") | free).alias("ok"), barred.alias("barred"), "bm25")
