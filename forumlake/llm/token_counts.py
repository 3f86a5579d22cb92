"""Token counts from pre-token frequencies, without materialising ids.

A pre-token is what the tokenizer's own normaliser and pre-tokenizer make of a text; the
model cuts each apart from its neighbours, so a text's tokens are the sum of its pre-tokens'
pieces.

1. Pre-tokens of all texts are counted: in the task first, then by pre-token.
2. The model counts the pieces of each distinct pre-token once; the result is a table.
3. The frequencies of every document are joined to that table. Pre-tokens above a count that
   at most ``LOCAL`` of them reach (found from a histogram of the counts) go to every task and
   are summed there. A document carries the others as (pre-token, frequency) pairs, which
   Spark joins to the table and sums by row. None of those is frequent, so no key is hot.

Texts are cut at ASCII white space first, which no pre-token crosses and on which the
tokenizer's normaliser depends no further; each distinct chunk of a batch is read once. A
chunk that holds a special token's string goes through the whole tokenizer, which reads such
strings inside texts as special tokens by default; it counts as one pre-token, marked by a
line break in front. A chunk of Latin letters with or without marks behind them is cut by a
pattern, where a probe shows that the tokenizer reads such chunks in the same way.

Defined results: a NULL text is empty and has no tokens and no bytes; NULL ids and repeated
rows give one row each; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from forumlake.llm.packing import _LETTERS, slices
from forumlake.session import stage

LIMIT = 2048  # tokens
LOCAL = 1 << 17  # pre-tokens whose pieces every task knows
LOCAL_BYTES = 64  # a longer pre-token is never among them
COUNTED = 200_000  # pre-tokens that a task counts before it hands them on
CHUNKS = 100_000  # chunks that a worker remembers
WHOLE = "\n"  # marks a chunk for the whole tokenizer; no pre-token holds a line break
# Letters whose case and normal form no version of Unicode changes, and marks; U+0130 has two lower-case letters.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,;:!?*#$%&|]*)")
_PROBES = ["Plain", "ÉTÉ", "Œuvre,", "straße...", "word:|", "a", "Ŀſ", "zŻ!?", "".join(c for c in map(chr, range(0x41, 0x180)) if _PLAIN.fullmatch(c))]
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads

HELD = "row bigint, doc_id bigint, n_bytes bigint, local_tokens bigint, others array<struct<pretoken: string, uses: bigint>>"
_OTHERS = pa.list_(pa.struct([("pretoken", pa.string()), ("uses", pa.int64())]))


class Reader:
    """The tokenizer's reading of a chunk, and the model's of a pre-token."""

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_pattern = all(self.plain(x) == self.read(x) for x in _PROBES)

    @staticmethod
    def plain(chunk: str) -> list[str] | None:
        """Letters in lower case, bytes as a byte-level model writes them, and the marks behind; None for other chunks."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        found = _PLAIN.fullmatch(chunk)
        if not found:
            return None
        letters, marks = found.groups()
        letters = letters.lower()
        if not letters.isascii():
            letters = "".join(map(_LETTERS.__getitem__, letters.encode()))
        return [letters, marks] if marks else [letters]

    def pretokens(self, chunk: str) -> list[str]:
        found = self.plain(chunk) if self.by_pattern else None
        return self.read(chunk) if found is None else found

    def read(self, chunk: str) -> list[str]:
        if any(x in chunk for x in self.special):
            return [WHOLE + chunk]
        read = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        return [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(read)]

    def pieces(self, pretoken: str) -> int:
        if pretoken.startswith(WHOLE):
            return len(self.tokenizer.encode(pretoken[1:], add_special_tokens=False).ids)
        return len(self.tokenizer.model.tokenize(pretoken))


class Memory:
    """What ``make`` says of a chunk, remembered for the chunks in use."""

    def __init__(self, make: Callable[[str], object]):
        self.make, self.known, self.old = make, {}, {}

    def __call__(self, chunks: list[str]) -> list:
        if len(self.known) > CHUNKS:
            self.known, self.old = {}, self.known
        for chunk in chunks:
            if chunk not in self.known:
                self.known[chunk] = self.old[chunk] if chunk in self.old else self.make(chunk)
        return [self.known[chunk] for chunk in chunks]


def chunks_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, the number of the chunk at every place of all texts, and where each text begins (and ends)."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def pretoken_counts(docs: DataFrame, model) -> DataFrame:
    """(pretoken, n) over all texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Memory(Reader(model.value).pretokens)
        counts: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pretoken", "n"])

        for batch in batches:
            for texts in slices(batch.column(0)):
                chunks, which, _ = chunks_of(texts)
                for parts, n in zip(read(chunks), np.bincount(which, minlength=len(chunks)).tolist()):
                    for part in parts:
                        counts[part] += n
                if len(counts) > COUNTED:
                    yield handed()
                    counts.clear()
        yield handed()

    return docs.select("text").mapInArrow(each, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))


def with_pieces(counts: DataFrame, model) -> DataFrame:
    """(pretoken, n, pieces): the model reads each distinct pre-token once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for batch in batches:
            pieces = pa.array([reader.pieces(x) for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=["pretoken", "n", "pieces"])

    return counts.select("pretoken", "n").mapInArrow(each, "pretoken string, n bigint, pieces bigint")


def frequent(pieces: DataFrame, most: int) -> tuple[dict[str, int], bool]:
    """Pieces of ``most`` frequent pre-tokens at most, and whether these are all there are."""
    step = F.floor(F.log2("n") * 8).cast("int")
    short = F.octet_length("pretoken") <= LOCAL_BYTES
    levels = pieces.groupBy(step.alias("level")).agg(F.count_if(short).alias("n"), F.count("*").alias("rows")).orderBy(F.desc("level")).collect()  # 8 a doubling
    least, held = None, 0
    for row in levels:
        if held + row["n"] > most:
            break
        least, held = row["level"], held + row["n"]
    if least is None:
        return {}, not levels
    rows = pieces.where((step >= least) & short).select("pretoken", "pieces").toArrow()
    found = dict(zip(rows.column("pretoken").to_pylist(), rows.column("pieces").to_pylist()))
    return found, held == sum(row["rows"] for row in levels)


def held_counts(docs: DataFrame, model, local) -> DataFrame:
    """One row per document: the sum over frequent pre-tokens, and the others with their frequencies."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(model.value), local.value

        def of(chunk: str) -> tuple[int, list[str]]:
            parts = reader.pretokens(chunk)
            return sum(known.get(p, 0) for p in parts), [p for p in parts if p not in known]

        read = Memory(of)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            sums, others = [], []
            for texts in slices(batch.column(1)):
                chunks, which, offsets = chunks_of(texts)
                found = read(chunks)
                pieces = np.fromiter((n for n, _ in found), np.int64, len(found))
                ends = np.append(0, np.cumsum(pieces[which]))
                sums += np.diff(ends[offsets]).tolist()
                rare = np.fromiter((bool(x) for _, x in found), bool, len(found))
                uses: list[Counter[str]] = [Counter() for _ in texts]
                at = np.flatnonzero(rare[which])
                for text, chunk in zip((np.searchsorted(offsets, at, "right") - 1).tolist(), which[at].tolist()):
                    uses[text].update(found[chunk][1])
                others += [[{"pretoken": p, "uses": n} for p, n in x.items()] for x in uses]
            rows = pa.array(range(row, row + len(sums)), pa.int64())
            row += len(sums)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), sizes, pa.array(sums, pa.int64()), pa.array(others, _OTHERS)], names=["row", "doc_id", "n_bytes", "local_tokens", "others"]
            )

    return docs.mapInArrow(each, HELD)


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text", local: int = LOCAL) -> DataFrame:
    """One row per document: ``n_bytes``, ``n_tokens`` and whether these are more than ``limit``."""
    with open(tokenizer_file, encoding="utf-8") as f:
        model = f.read()
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = stage(with_pieces(pretoken_counts(docs, shared), shared), "pieces")
    known, all_known = frequent(pieces, local)
    held = held_counts(docs, shared, context.broadcast(known))
    if all_known:
        tokens = F.col("local_tokens")
    else:
        held = stage(held, "held-counts")
        uses = held.select("row", F.inline("others"))
        rest = uses.join(pieces.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("uses") * F.col("pieces")).alias("rest"))
        held = held.drop("others").join(rest, "row", "left")
        tokens = F.col("local_tokens") + F.coalesce("rest", F.lit(0))
    counted = held.select("doc_id", "n_bytes", tokens.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
