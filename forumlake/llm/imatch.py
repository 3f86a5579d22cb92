"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms (lower-case words) whose document frequency lies in a band,
``RARE`` to ``COMMON`` as shares of all documents. A text's distinct lexicon terms, sorted,
are hashed whole and, for randomised subsets of the lexicon, by subset. A subset keeps a
share 2 ** -level of the lexicon; a text is hashed at the level where a subset holds about
one of its terms and at the two next, so that texts of nearly the same terms agree in many
subsets whatever their length. The likeness of two fingerprints is the share of their
filled subsets that are equal, which estimates the overlap of their terms.

Document frequencies are counted over all documents. The lexicon has at most
``LEXICON`` terms, whatever the corpus: its floor is at least (mean distinct terms a
document) / LEXICON of the documents, and no more terms than LEXICON can each be in that
many. So it may be handed to every task (8 bytes a term).

The edited text of a document takes its end from the next document in descending order of
id. Documents are cut into blocks of ids at quantiles, and a block also receives the first
document of the block after it, so neighbours meet in one pass over sorted blocks. There
are at most ``BLOCKS`` blocks; a block is streamed in order, never held, however large.

Defined results: a NULL text is empty; texts with fewer than ``FEW`` lexicon terms are
hashed by all their terms, and a text without words has the fingerprint "0"; equal
fingerprints have likeness 1; a NULL id comes after every other; rows of one id are
ordered by text; the next document of a lone row is itself; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumlake.llm.words import WordHashes, each_text, mix

RARE, COMMON = 2e-4, 0.1  # band of document frequency, as shares of the documents
LEXICON = 1 << 20
FEW, SUBSETS, LEVELS, BLOCK = 4, 48, 3, 512
BLOCKS = 1 << 16  # blocks of ids at most, so that the driver may hold their ends
_SEEDS = mix(np.arange(1, 2 * SUBSETS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_A, _B = _SEEDS[:SUBSETS] | np.uint64(1), _SEEDS[SUBSETS:]
TERMS_HELD = 500_000  # terms that a task counts before it hands the counts on

ROWS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_terms bigint"


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many documents each hashed term is."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            terms, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for words in each_text(batch.column(0)):
                held.append(np.unique(words))
                n += len(held[-1])
                if n > 8 * TERMS_HELD:
                    yield counted()
                    held, n = [], 0
        yield counted()

    return docs.select(F.col(text).alias("text")).mapInArrow(each, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of the terms in the band, at most ``LEXICON``."""
    total = docs.count()
    counts = term_counts(docs, text).persist()
    try:
        uses = counts.agg(F.sum("n")).first()[0] or 0
        floor = max(RARE * total, uses / LEXICON)
        held = counts.where((F.col("n") >= F.lit(floor)) & (F.col("n") <= F.lit(max(COMMON * total, 1.0)))).select("term").toArrow()
    finally:
        counts.unpersist()
    return np.sort(held.column("term").combine_chunks().to_numpy().view(np.uint64)) if held.num_rows else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Print:
    """A fingerprint: ``marks`` is [LEVELS, SUBSETS] (0: no term in the subset), from ``level`` on."""

    terms: int
    whole: int
    level: int
    marks: np.ndarray | None

    def text(self) -> str:
        if self.marks is None:
            return "0"
        return f"{self.terms:x}.{self.whole:016x}.{self.level:x}.{self.marks.astype('>u2').tobytes().hex()}"

    def likeness(self, other: Print) -> float:
        if self.whole == other.whole and self.terms == other.terms:
            return 1.0
        if self.marks is None or other.marks is None or abs(self.level - other.level) >= LEVELS:
            return 0.0
        up = max(self.level, other.level)
        a, b = self.marks[up - self.level :], other.marks[up - other.level :]
        depth = min(len(a), len(b))
        a, b = a[:depth], b[:depth]
        filled = int(((a > 0) | (b > 0)).sum())
        return float(((a == b) & (a > 0)).sum() / filled) if filled else 0.0


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> Print:
    """Of a text's sorted distinct term hashes."""
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        known = terms[lexicon[place] == terms]
        terms = known if len(known) >= FEW else terms
    if not len(terms):
        return Print(0, 0, 0, None)
    whole = int.from_bytes(hashlib.blake2b(terms.tobytes(), digest_size=8).digest(), "little")
    level = max(0, int(np.ceil(np.log2(len(terms)))))
    marks = np.zeros((LEVELS, SUBSETS), np.uint64)
    for i in range(0, len(terms), 2048):
        part = terms[i : i + 2048]
        draw = part[None, :] * _A[:, None] + _B[:, None]
        draw ^= draw >> np.uint64(32)
        draw *= np.uint64(0x9E3779B97F4A7C15)
        for k in range(LEVELS):
            kept = draw < np.uint64(min(2**64 >> (level + k), 2**64 - 1))
            row, at = np.nonzero(kept)
            np.add.at(marks[k], row, mix(part[at] + np.uint64(1)))
    short = (mix(marks) >> np.uint64(48)).astype(np.uint16)
    short[short == 0] = 1
    short[marks == 0] = 0
    return Print(len(terms), whole, level, short)


def edited(text: str, following: str) -> str:
    """The last third gives way to as much of the start of the next document."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, lent, doc_id, text): documents in blocks of ids, with the first one of the block that comes next, ``lent``."""
    total = docs.count()
    size = max(BLOCK, -(-total // BLOCKS))
    shares = [k * size / total for k in range(1, -(-total // size))] if total else []
    cuts = np.unique(docs.approxQuantile("doc_id", shares, min(0.25 * size / total, 0.01)) if shares else []).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            block = np.searchsorted(cuts, ids.fill_null(0).to_numpy(), "right") + 1
            block[np.asarray(ids.is_null())] = 0
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), *batch.columns], names=["block", *batch.schema.names])

    ids = docs.select("doc_id").mapInArrow(place, "block bigint, doc_id bigint")
    tops = ids.groupBy("block").agg(F.max("doc_id").alias("top")).orderBy("block").collect()  # one row a block, BLOCKS + 1 at most
    owner = {row["block"]: row["top"] for row in tops}
    blocks = sorted(owner)
    # The block after the lowest is the highest again.
    lender = {blocks[k]: blocks[k + 1] if k + 1 < len(blocks) else blocks[0] for k in range(len(blocks))}

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in place(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(batch.num_rows, np.int32)), *batch.columns[1:]], names=["block", "lent", "doc_id", "text"])
            found, own = batch.column("block").to_pylist(), batch.column("doc_id").to_pylist()
            first = [k for k, (b, d) in enumerate(zip(found, own)) if owner[b] == d]
            if first:
                some = batch.take(pa.array(first))
                to = pa.array([lender[found[k]] for k in first], pa.int64())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(first), np.int32)), *some.columns[1:]], names=["block", "lent", "doc_id", "text"])

    return docs.mapInArrow(lend, "block bigint, lent int, doc_id bigint, text string")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike it is to that and to the next document."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    ordered = in_blocks(docs).repartition("block").sortWithinPartitions("block", "lent", F.col("doc_id").desc_nulls_last(), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = shared.value, WordHashes()
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
            + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_terms", pa.int64())]
        )

        def printed(body: str) -> Print:
            return fingerprint(np.unique(hashes(body.encode().lower().split())), known)

        def row(doc_id: int | None, body: str, own: Print, following: str, after: Print) -> tuple:
            changed = edited(body, following)
            then = printed(changed) if changed != body else own
            digest = hashlib.sha256(changed.encode()).hexdigest()
            return doc_id, len(body), digest, own.text(), then.text(), own.likeness(then), own.likeness(after), own.terms

        held: tuple | None = None  # (block, doc_id, text, print) of a document that waits for the next
        for batch in batches:
            out = []
            for block, lent, doc_id, body in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None and lent:
                    continue
                own = printed(body)
                if held is not None and held[0] == block:
                    out.append(row(held[1], held[2], held[3], body, own))
                held = None if lent else (block, doc_id, body, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ordered.mapInArrow(each, ROWS)
