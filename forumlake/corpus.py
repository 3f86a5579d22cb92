"""The ``items`` table as a view over the driver's pages, documents, labels and
conversations tables (column by column in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forumlake.schema import ITEM_COLUMNS

SOURCES = ("pages", "documents", "labels", "conversations")

# Stated schemas spare a look into the files before every plan.
TABLES = {
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# What an item column is where a source says nothing about it.
DEFAULTS = {
    "deleted": "false",
    "by": "CAST(NULL AS STRING)",
    "time": "CAST(NULL AS TIMESTAMP_NTZ)",
    "text": "CAST(NULL AS STRING)",
    "dead": "false",
    "parent": "CAST(NULL AS BIGINT)",
    "poll": "CAST(NULL AS BIGINT)",
    "kids": "CAST(array() AS ARRAY<BIGINT>)",
    "url": "CAST(NULL AS STRING)",
    "score": "CAST(NULL AS INT)",
    "title": "CAST(NULL AS STRING)",
    "parts": "CAST(array() AS ARRAY<BIGINT>)",
    "descendants": "CAST(NULL AS INT)",
}

PAGES = {
    "id": "page_id * 10 + 1",
    "type": "'story'",
    "text": "html",
    "kids": "CASE WHEN page_id % 4 = 0 THEN array(page_id * 10 + 2, page_id * 10 + 12) ELSE CAST(array() AS ARRAY<BIGINT>) END",
    "by": "concat('u', page_id % 15)",
    "time": "timestampadd(MINUTE, page_id * 60, timestamp_ntz'2024-01-01 00:00:00')",
    "url": "url",
    "score": "CASE WHEN page_id % 11 <> 0 THEN CAST(page_id * 37 % 500 AS INT) END",
    "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "descendants": "CASE WHEN page_id % 7 <> 0 THEN CAST(page_id * 13 % 40 AS INT) END",
}

DOCUMENTS = {
    "id": "doc_id * 10 + 2",
    "deleted": "doc_id % 53 = 0",
    "type": "CASE doc_id % 20 WHEN 0 THEN 'job' WHEN 1 THEN 'story' WHEN 2 THEN 'poll' WHEN 3 THEN 'pollopt' ELSE 'comment' END",
    "by": "source",
    "time": "CASE WHEN doc_id % 97 <> 0 THEN timestampadd(MINUTE, doc_id, timestamp_ntz'2024-01-01 00:00:00') END",
    "text": "text",
    "dead": "coalesce(toxic, 0) = 1",
    "parent": "CASE WHEN doc_id % 20 > 3 THEN doc_id % 50 * 10 + 1 END",
    "poll": "CASE WHEN doc_id % 20 = 3 THEN (doc_id - 1) * 10 + 2 END",
    "score": "CASE WHEN doc_id % 20 < 3 THEN CAST(doc_id % 300 AS INT) END",
    "title": "CASE WHEN doc_id % 20 < 3 THEN substring(text, 1, 60) END",
    "parts": "CASE WHEN doc_id % 20 = 2 THEN array((doc_id + 1) * 10 + 2) ELSE CAST(array() AS ARRAY<BIGINT>) END",
}

CONVERSATIONS = {
    "id": "(conv_id * 100 + turn) * 10 + 3",
    "type": "'comment'",
    "by": "role",
    "time": "timestampadd(MINUTE, conv_id * 10 + turn, timestamp_ntz'2024-01-01 00:00:00')",
    "text": "text",
    "parent": "CASE WHEN turn = 0 THEN conv_id % 200 * 10 + 2 ELSE (conv_id * 100 + turn - 1) * 10 + 3 END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _items(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    values = {**DEFAULTS, **rules}
    return df.selectExpr(*[f"{values[name]} AS `{name}`" for name in ITEM_COLUMNS])


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return (
        _items(table(spark, sf_dir, "pages"), PAGES)
        .union(_items(documents, DOCUMENTS))
        .union(_items(table(spark, sf_dir, "conversations"), CONVERSATIONS))
    )
