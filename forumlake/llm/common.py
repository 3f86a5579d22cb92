"""Small helpers that the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(CONVERSATIONS).parquet(f"{sf_dir}/conversations.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet")


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with more columns (name, DDL type)."""
    added = [T.StructField(name, T._parse_datatype_string(kind), True) for name, kind in fields]
    return T.StructType(list(df.schema.fields) + added)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., which no name of an operator's own clashes with, and each one's new name."""
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named_again(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of :func:`numbered` alone, under their old names."""
    return rows.select(*names.values()).toDF(*names)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
