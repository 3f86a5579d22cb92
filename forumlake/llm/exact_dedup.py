"""Exact dedup: 128-bit content hash, one kept id a group, bytes compared inside groups.

Texts are equal when they are the same after lower-casing A-Z. Texts meet by their
128-bit hash; rows count as copies only if their bytes are equal too, which the
aggregate over (hash, bytes) decides. It combines copies before the shuffle, so a
group of any size costs one row a task. Hashes that several texts share (none are
known) are joined by their bytes instead of by their hash.

Defined results: a NULL text is the empty text; a NULL id is smaller than every other
id; of rows that repeat one id and text exactly one is kept; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from forumlake.llm.common import byte_texts, named_again, numbered, with_fields
from forumlake.session import stage

HASH, BODY = "hash128", "body"


def with_content(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the normalised bytes and their 128-bit hash."""
    place = docs.columns.index(text)
    schema = with_fields(docs, (HASH, "binary"), (BODY, "binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b.lower() for b in byte_texts(batch.column(place))]
            hashes = [hashlib.md5(b, usedforsecurity=False).digest() for b in bodies]
            columns = [*batch.columns, pa.array(hashes, pa.binary()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, HASH, BODY])

    return docs.mapInArrow(add, schema)


def copy_groups(content: DataFrame, id_col: str, keep: str) -> DataFrame:
    """(hash, body, keep_id, group_size): one row for each distinct text."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    unknown = F.max(F.col(id_col).isNull())
    # The smallest id of a group with a NULL id is NULL.
    kept = F.when(unknown, None).otherwise(pick(id_col)) if keep == "smallest" else pick(id_col)
    return content.groupBy(HASH, BODY).agg(kept.alias("keep_id"), F.count("*").alias("group_size"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and the digest of the normalised text."""
    content = with_content(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    groups = copy_groups(content, "doc_id", keep)
    digest = F.sha2(F.col(BODY), 256).alias("text_sha256")
    groups = stage(groups.select(HASH, "keep_id", "group_size", digest), "copy-groups")
    shared = groups.groupBy(HASH).count().where("count > 1").select(HASH)

    members = content.groupBy(HASH, "doc_id").agg(F.count("*").alias("rows"))
    if shared.isEmpty():
        placed = members.join(groups, HASH)
    else:
        # Different texts of one hash: their rows are told apart by the texts' bytes.
        clear = groups.join(F.broadcast(shared) if shared.count() < 10_000 else shared, HASH, "left_anti")
        told = content.join(shared, HASH, "left_semi").groupBy(HASH, BODY, "doc_id").agg(F.count("*").alias("rows"))
        told_groups = copy_groups(content.join(shared, HASH, "left_semi"), "doc_id", keep)
        told = told.join(told_groups, [HASH, BODY]).withColumn("text_sha256", digest).drop(BODY)
        placed = members.join(clear, HASH).unionByName(told)
    chosen = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return copies.select("doc_id", "keep_id", "group_size", (chosen & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the copies, all columns as they were."""
    rows, names = numbered(docs)
    own, body = names[id_col], names[text]
    content = with_content(rows, body)
    digest = F.sha2(F.col(BODY), 256)
    groups = copy_groups(content, own, keep).select("keep_id", digest.alias("keep_digest"))
    marked = content.withColumn("digest", digest).drop(HASH, BODY)
    found = marked.join(groups, F.col(own).eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest")), "left_semi")
    # Rows that repeat one id and text are all found: the first of them stays, by their other columns.
    others = [F.col(c).cast("string") for c in names.values() if c not in (own, body)]
    first = Window.partitionBy(own, "digest").orderBy(*others, body)
    return named_again(found.withColumn("nth", F.row_number().over(first)).where("nth = 1"), names)
