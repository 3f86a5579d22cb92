"""Small hand-made tables: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use themselves.
CLASHES = ("keep_id", "node", "shard", "bucket", "score", "weight", "group", "kept", "level", "start", "rest", "votes", "row", "id", "nth", "digest", "hash128", "body", "copies", "tokens", "topic", "expected", "margins", "copy", "c0", "c7")
CLASHES += ("__body", "__hash128", "__digest", "__nth", "__row", "__id", "__score", "__posterior", "__votes", "__weight")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


LONG = prose(1, 30_000, 5000)
PASSAGE = prose(2, 60, 10**6)

ROWS = [
    (1, prose(10, 120), "en", "a", 5),
    (2, prose(10, 120), "en", "b", 5),  # a copy
    (3, prose(10, 120).upper().replace("W", "w"), "en", "b", 5),  # equal but for case
    (4, prose(10, 120) + " more", "en", "a", None),  # a near copy
    (5, None, "en", "a", None),
    (6, "", None, None, 0),
    (7, "", "de", "a", 0),
    (8, "two words", "de", None, 9),
    (9, LONG, "de", "c", len(LONG)),
    (9, LONG, "de", "c", len(LONG)),  # a repeated row
    (10, prose(11, 50) + " " + PASSAGE + " " + prose(12, 40), "en", "a", 1),
    (11, prose(13, 30) + "\n" + PASSAGE + "\t" + prose(14, 30), "fr", "a", 1),
    (12, prose(15, 13), "fr", "a", 1),
    (12, prose(16, 90), "fr", "a", 1),  # one id, two texts
    (None, prose(17, 80), "fr", "a", 1),
    (None, prose(17, 80), "fr", "a", 1),
    (None, None, None, None, None),
    (-5, "Été, ça va très  bien \U0001f600 " + prose(18, 20), "fr", "a", 1),
]


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    """Documents with more columns, whose names the operators use too."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'x' AS {name}" for name in CLASHES])


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
