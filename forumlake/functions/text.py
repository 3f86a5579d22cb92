"""From rows and query texts to positioned terms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from forumlake.functions.cleaning import let
from forumlake.functions.stemming import english_terms

# Markup that never holds words, and what a word is.
TAG = "<[^>]+>"
ENTITY = "&[#A-Za-z0-9]+;"
WORD = r"([\p{L}\p{N}]+)"

CONFIGS = ("english", "simple")


def search_document() -> Column:
    """Title, author and tag-stripped text in one string."""
    text = F.col("text")
    tagless = F.when(text.contains("<"), F.regexp_replace(text, TAG, " ")).otherwise(text)
    return F.concat_ws(" ", "title", "by", tagless)


def words(doc: Column) -> Column:
    """Lower-case letter and digit runs, in order; entities hold no words."""
    plain = let(doc, lambda d: F.when(d.contains("&"), F.regexp_replace(d, ENTITY, " ")).otherwise(d))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(1))


def known_config(config: str) -> str:
    if config not in CONFIGS:
        raise ValueError(f"unknown text config {config!r}")
    return config


def terms(word_array: Column, config: str) -> Column:
    """The term of every word; NULL where the word is not indexed, so positions
    keep counting it."""
    return english_terms(word_array) if known_config(config) == "english" else word_array
