"""Chat formatting in budgeted windows, with DataFrame functions alone.

The turns of a conversation get a cost (words and marks); prefix sums of it cut the
conversation into spans of whole turns. A span becomes a window: the system turn (kept
in every window), a limited history (turns of the span before that start at most
``history`` before this one), then the span's own turns. What a window repeats is
marked ``again`` and never trained on; of its own turns the assistant's texts are the
targets. Control strings inside roles and texts are escaped reversibly.

A window costs at most ``budget`` and its system turn, unless one turn alone costs more
than a span.

Prefix sums are taken in two levels (blocks of 64 turns, then their totals), so a
conversation of any length is spread over tasks; only a window is gathered into a row.

Defined results: NULL role or text is empty; rows are ordered by turn (NULL first), role
and text, and repeated rows are turns of their own; NULL conversation ids form one
conversation; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 64
MARKS = 4  # what the marks of a turn cost
OWN, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>"
_PIECE = r"(?s)<\|(turn|again)\|>(.*?)<\|text\|>(.*?)<\|end\|>"


def escape(text: Column) -> Column:
    """Every mark starts with ``<|``, which an escaped string cannot hold."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    opened = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """Turns with their number ``nth`` and the cost before them, ``start``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + MARKS).cast("long").alias("cost"),
        F.floor(F.col("turn") / BLOCK).alias("block"),
    )
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"in_nth": F.row_number().over(inner), "in_end": F.sum("cost").over(upto)})
    blocks = rows.groupBy(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block")).agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    before = Window.partitionBy("b_conv").orderBy(F.col("b_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "b_conv", "b_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_before")
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    return rows.join(blocks, same).select(
        "conv_id",
        (F.col("n_before") + F.col("in_nth")).alias("nth"),
        "role",
        "text",
        "cost",
        (F.col("c_before") + F.col("in_end") - F.col("cost")).alias("start"),
    )


def chat_windows(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """(conv_id, window, formatted, cost, n_own, loss): ``loss`` holds (start, length) in
    code points of ``formatted``, one for each assistant text among the window's own turns."""
    stride = max((budget - history) // 2, 1)
    placed = placed_turns(turns).withColumn("span", F.floor(F.col("start") / stride))
    spans = placed.groupBy(F.col("conv_id").alias("s_conv"), F.col("span").alias("s_span")).agg(F.min("start").alias("s_start"))
    order = Window.partitionBy("s_conv").orderBy("s_span")
    spans = spans.withColumns({"next_span": F.lead("s_span").over(order), "next_start": F.lead("s_start").over(order)})
    system = placed.where("nth = 1 AND role = 'system'")
    fixed = (F.col("nth") == 1) & (F.col("role") == "system")

    same = F.col("conv_id").eqNullSafe(F.col("s_conv"))
    rows = placed.join(spans, same & (F.col("span") == F.col("s_span")))
    kept_on = F.col("next_span").isNotNull() & (F.col("start") >= F.col("next_start") - history) & ~fixed
    shows = F.when(kept_on, F.array(F.struct(F.col("span").alias("window"), F.lit(True).alias("own")), F.struct(F.col("next_span").alias("window"), F.lit(False).alias("own"))))
    shows = shows.otherwise(F.array(F.struct(F.col("span").alias("window"), F.lit(True).alias("own"))))
    own = rows.select("conv_id", "nth", "role", "text", "cost", F.explode(shows).alias("show")).select("conv_id", "nth", "role", "text", "cost", "show.*")
    again = system.join(spans.where("s_span > 0"), same).select(
        "conv_id", "nth", "role", "text", "cost", F.col("s_span").alias("window"), F.lit(False).alias("own")
    )

    head = F.concat(F.when(F.col("own"), F.lit(OWN)).otherwise(F.lit(AGAIN)), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    pieces = own.unionByName(again).select(
        "conv_id", "window", "nth", "own", "cost", head.alias("head"), body.alias("body"), (F.col("own") & (F.col("role") == "assistant")).alias("target")
    )
    piece = F.concat("head", "body", F.lit(END))
    earlier = Window.partitionBy("conv_id", "window").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length(piece)).over(earlier), F.lit(0)))
    target = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    return (
        pieces.groupBy("conv_id", "window")
        .agg(
            F.array_sort(F.collect_list(F.struct("nth", piece.alias("piece")))).alias("pieces"),
            F.sum("cost").alias("cost"),
            F.sum(F.col("own").cast("long")).alias("n_own"),
            F.array_sort(F.collect_list(F.when(F.col("target"), target))).alias("loss"),
        )
        .select("conv_id", "window", F.array_join("pieces.piece", "").alias("formatted"), "cost", "n_own", "loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """``windows`` with what the formatted strings say: own ``turns`` (role, text) and ``targets``, the texts under the loss mask."""
    part = lambda k: F.regexp_extract_all(F.col("formatted"), F.lit(_PIECE), F.lit(k))
    parsed = F.arrays_zip(part(1).alias("kind"), part(2).alias("role"), part(3).alias("text"))
    own = F.filter(parsed, lambda x: x["kind"] == "turn")
    turns = F.transform(own, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.withColumns({"turns": turns, "targets": targets})


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted windows alone.

    A digest needs its conversation's text as one string; nothing else is gathered by conversation.
    """
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = read_back(windows).select(
        "conv_id",
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.struct("window", said.alias("said"), F.array_join("targets", "").alias("learnt")).alias("part"),
    )
    joined = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    whole = lambda name: F.array_join(F.col(f"parts.{name}"), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(whole("said"), 256).alias("turns_sha256"),
        F.length(whole("learnt")).cast("long").alias("loss_chars"),
        F.sha2(whole("learnt"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
