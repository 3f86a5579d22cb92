"""From raw documents to packed sequences: filter, dedup, near dedup, mix, pack.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.

In every stage a NULL text counts as empty and a NULL id is an id of its own kind; columns
beyond those of ``documents`` pass through under whatever names; an empty table gives an
empty one. What else a stage makes of odd rows stands at its function.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forumlake.llm import chosen_path, exact_dedup, mixing, packing, quality
from forumlake.llm.common import documents
from forumlake.session import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Equal texts have equal scores, so repeated rows stay or go
    together; without rows to learn from all stay."""
    return quality.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (A-Z in any case) stays: the one with the smallest id, NULL before all others; of rows
    that repeat it, the first by their other columns."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id, NULL last; of rows that repeat it,
    the first by their other columns. Texts of fewer than five words are near if all their words agree."""
    return chosen_path.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and forms have their target shares; scarce ones are drawn several
    times. Rows that repeat an id in one cell share one draw; NULL sources and languages are values of their own."""
    return mixing.sampled_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids. Rows that repeat a document are packed each; an empty text
    gives its end id alone; a text longer than a sequence is cut into several."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram join", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack", pack),
]

# A classifier, sketches and a tokenizer have no SQL counterpart; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
