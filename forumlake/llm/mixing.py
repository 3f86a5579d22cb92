"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Documents are summed up by cell (source, language, topic) once; the raking works on the
cells. A round scales the cells' token weights to the target share of each source, then of
each language, then of each topic; rounds go on until every value is within ``TOLERANCE`` of
its target. A document is then drawn ``rate * weight`` times on average: as many times as
that has whole parts, and once more with the probability of the rest. So scarce cells repeat,
nothing is cut at a probability of one, and the draw has the targets' shares in
expectation at any rate.

Targets are given shares, or the observed token shares tempered by an exponent below one.
Tempering leaves a value with less than ``LEAST_SHARE`` of the tokens at its own share: a
handful of documents is not repeated until it looks like a source. Targets that contradict
one another (a source in one language alone, say) hold at no weights; then the raking ends
after ``MOST_ROUNDS``, with a warning.

There are as many cells as combinations of the values met, whatever the rows. Up to
``SMALL_CELLS`` they are raked in one task, as windows of one plan; more are shuffled.

Defined results: NULL source, language, topic or text count as empty strings; a document
without tokens has its cell's weight, and a cell without tokens the weight 1; the draw
depends on the id alone (its MD5), so repeated rows share one fate, and NULL ids draw as
the empty string; other columns pass through, whatever their names; an empty table gives an
empty one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlake.llm.common import named_again, numbered
from forumlake.session import stage

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
LEAST_SHARE = 0.01  # of the tokens, below which tempering leaves a value alone
RATE = 0.5  # tokens drawn, as a share of all
TOLERANCE = 0.001  # of a value's target
ROUNDS, MOST_ROUNDS = 4, 48  # between two looks at the margins; in all
SMALL_CELLS = 100_000  # rows of three short strings and some numbers, for one task and for broadcasts


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form_topic(text: Column) -> Column:
    """Stands in for a topic column where a table has none: the text's form and size."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.length(text) < 500, "note")
        .when(F.length(text) < 2000, "article")
        .when(F.length(text) < 8000, "essay")
        .otherwise("book")
    )


def margins_of(topic: Column | None = None, id_col: str = "doc_id") -> list[Column]:
    """doc_id, source, lang, topic, tokens: what mixing looks at."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    topic = F.coalesce(topic if topic is not None else form_topic(F.col("text")), F.lit("")).alias("topic")
    return [F.col(id_col).alias("doc_id"), known("source"), known("lang"), topic, token_count(F.col("text")).alias("tokens")]


def with_margins(docs: DataFrame, topic: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every document."""
    return docs.select(*margins_of(topic, id_col))


def cells_of(rows: DataFrame) -> DataFrame:
    return stage(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")


def with_targets(cells: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` with the tokens that the value of each margin should have; over a margin's values these add up to all tokens."""
    everything = F.sum("tokens").over(Window.partitionBy())
    for m in MARGINS:
        of = Window.partitionBy(m)
        given = (shares or {}).get(m)
        # A value's figures stand at one of its cells, so that sums over cells are sums over values.
        first = F.row_number().over(of.orderBy(*MARGINS)) == 1
        seen = F.sum("tokens").over(of)
        cells = cells.withColumns({"seen": seen, "everything": everything, "first": first})
        if given is None:
            alone = F.col("seen") < LEAST_SHARE * F.col("everything")
            wish = F.when(~alone, F.pow(F.col("seen"), F.lit(TEMPER[m]))).otherwise(0.0)
        else:
            alone = F.lit(False)
            table = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
            wish = F.when(F.col("seen") > 0, F.coalesce(F.element_at(table, F.col(m)), F.lit(0.0))).otherwise(0.0)
        cells = cells.withColumns({"wish": wish, "own": F.when(alone, F.col("seen")).otherwise(0)})
        wishes = F.sum(F.when(F.col("first"), F.col("wish"))).over(Window.partitionBy())
        left = F.col("everything") - F.sum(F.when(F.col("first"), F.col("own"))).over(Window.partitionBy())
        cells = cells.withColumns({"wishes": wishes, "left": left})
        share = F.when(F.col("wishes") > 0, F.try_divide(F.col("wish"), F.col("wishes")) * F.col("left")).otherwise(F.col("seen").cast("double"))
        cells = cells.withColumn(f"target_{m}", F.when(F.col("own") > 0, F.col("own").cast("double")).otherwise(share))
        cells = cells.drop("seen", "everything", "first", "wish", "own", "wishes", "left")
    return cells


def now(margin: str) -> Column:
    """Weighted tokens of the margin's value."""
    return F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(margin))


def off_target() -> Column:
    """The largest difference between a value's tokens and its target, as a share of the target."""
    off = [F.when(F.col(f"target_{m}") > 0, F.abs(F.try_divide(F.col(f"now_{m}"), F.col(f"target_{m}")) - 1)).otherwise(0.0) for m in MARGINS]
    return F.max(F.greatest(*off))


def raked_cells(cells: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight) whose margins hold."""
    small = cells.count() <= SMALL_CELLS
    one = lambda df: df.coalesce(1) if small else df  # noqa: E731  (windows over one partition need no shuffle)
    cells = with_targets(one(cells), shares).withColumn("weight", F.lit(1.0))
    off = None
    for _ in range(MOST_ROUNDS // ROUNDS):
        for _ in range(ROUNDS):
            for m in MARGINS:
                scaled = F.when((F.col("now") > 0) & (F.col("tokens") > 0), F.col("weight") * F.try_divide(F.col(f"target_{m}"), F.col("now"))).otherwise(F.col("weight"))
                cells = cells.withColumn("now", now(m)).withColumn("weight", scaled).drop("now")
        cells = one(stage(cells, "raked"))
        off = cells.withColumns({f"now_{m}": now(m) for m in MARGINS}).agg(off_target()).first()[0] or 0.0
        if off <= TOLERANCE:
            break
    else:
        warnings.warn(f"the mixing targets contradict one another: some value is off by {off:.1%} of its target", stacklevel=2)
    return cells.select(*MARGINS, "tokens", "weight")


def draw(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(rows: DataFrame, shares: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """Rows of :func:`with_margins` with the ``weight`` of their cells, the ``expected`` number of draws, and ``copies``."""
    weights = raked_cells(cells_of(rows), shares).drop("tokens")
    if weights.count() <= SMALL_CELLS:
        weights = F.broadcast(weights)
    expected = F.lit(rate) * F.col("weight")
    copies = F.floor("expected") + (draw(F.col("doc_id")) < F.col("expected") - F.floor("expected")).cast("long")
    return rows.join(weights, list(MARGINS)).withColumn("expected", expected).withColumn("copies", copies)


def sampled_documents(
    docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, rate: float = RATE, id_col: str = "doc_id", topic: Column | None = None
) -> DataFrame:
    """The drawn rows of ``docs``, as often as they are drawn, columns as they were; their tokens have the target shares in expectation."""
    kept, names = numbered(docs)
    looked_at = docs.select("*", F.struct(*margins_of(topic, id_col)).alias("_")).toDF(*kept.columns, "margins")
    drawn = mixed(looked_at.select(*kept.columns, "margins.*"), shares, rate).where("copies > 0")
    return named_again(drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), names)
