"""Cost-balanced packing of token ids into sequences of at most ``length`` tokens.

A document's ids (and its end id) are cut into full pieces of ``length``, each a sequence
of its own, and a rest. The rests are packed in groups of about ``GROUP`` documents: a
group's sequences hold exactly its tokens (as many of ``length`` as fill up, and powers of
two for what is left, which need no padding). In descending order a rest goes to the
sequence of the lowest cost, linear plus quadratic (attention inside a piece), that has
room for it; when none has, it is cut at the room of the cheapest.

Words between white space are looked up in a bounded table of their ids; only words
unseen by a Python worker reach the tokenizer. The tokenizer must ignore case and treat
white space and the end of a run of letters or digits as boundaries, as
``word_bpe_49k.json`` does; :func:`tokenised` compares both ways on a few words first.

Groups are dealt by a hash of id and content, so neither one source nor one id can fill
a group; where documents are long, a group has fewer (about ``GROUP_BYTES`` of text). A
piece carries its ids, so a sequence is read back by joining its pieces by ``offset``, and
a document by ``start``. Defined results: a NULL text is empty and gives the end id alone; repeated rows
and NULL ids are packed as documents of their own; other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

LENGTH, END_ID, GROUP = 2048, 1, 2048
GROUP_BYTES = 32 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # cost of a token; of a pair of tokens in one piece
KNOWN_WORDS = 600_000  # entries of each of a worker's two tables
SLICE = 8 << 20  # bytes of text that are looked up at once
_TAIL = b".,;:!?*#$%&|"
# Byte-level models write a byte as a printable character: its own, or the next one free from 256 on.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = [chr(b) if b in _OWN else chr(256 + sum(x not in _OWN for x in range(b))) for b in range(256)]
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads

# The ids of a piece are little-endian unsigned numbers of four bytes.
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Word -> its ids as little-endian bytes of ``width``.

    When the table is full it becomes the old one, from which words in use move to a new one.
    """

    def __init__(self, model: str, width: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.width, self.code = width, {"<u2": "H", "<u4": "I"}[width]
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> None:
        """A word of letters alone that normalising leaves as it is goes to the model as it is; others take the whole way."""
        known, model, others = self.known, self.tokenizer.model, []
        for word in words:
            text = word.decode()
            if word.isalpha() or (text.isalpha() and is_normalized("NFC", text) and text.lower() == text):
                found = model.tokenize(text if word.isascii() else "".join(map(_LETTERS.__getitem__, word)))
                known[word] = array(self.code, [x.id for x in found]).tobytes()
            else:
                others.append(word)
        for i in range(0, len(others), 2000):
            some = others[i : i + 2000]
            for word, found in zip(some, self.tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False)):
                known[word] = np.asarray(found.ids, self.width).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Ids of words that are not among the known ones."""
        known, old = self.known, self.old
        missing = words.difference(old)
        for word in words - missing:
            known[word] = old[word]
        # Marks behind a letter or digit are tokens of their own: the word before them may be known.
        parts = {}
        for word in missing:
            body = word.rstrip(_TAIL)
            if len(body) < len(word) and body and body[-1] < 128 and body[-1:].isalnum():
                parts[word] = (body, word[len(body) :])
        needed = missing.difference(parts)
        needed.update(x for pair in parts.values() for x in pair)
        needed = needed.difference(known)
        new = needed.difference(old)
        for word in needed - new:
            known[word] = old[word]
        self.encode(list(new))
        for word, (body, tail) in parts.items():
            known[word] = known[body] + known[tail]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text. Each distinct word is looked up once; the rest is Arrow and NumPy."""
        # The tokenizer ignores case, and A-Z are one byte each.
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.known, self.old = {}, self.known
        found = list(map(self.known.get, words))
        if None in found:
            self.learn({word for word, ids in zip(words, found) if ids is None})
            found = list(map(self.known.__getitem__, words))
        ids = np.frombuffer(b"".join(found), self.width)
        step = int(self.width[-1])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // step
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[which]
        ends = np.cumsum(each)
        ids = ids[np.repeat(starts[which] - (ends - each), each) + np.arange(int(each.sum()))]
        offsets = split.offsets.to_numpy()
        return np.split(ids, np.append(0, ends)[offsets[1:-1] - offsets[0]])


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about ``SLICE`` bytes."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=0)) if len(sizes) else np.zeros(0, np.int64)
    edges = [0, *[int(c) for c in cuts if c], len(sizes)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield texts.slice(lo, hi - lo)


def tokenised(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, ids, deal, width): the ids of every document, ``width`` each."""
    with open(tokenizer_file, encoding="utf-8") as f:
        model = f.read()
    tokenizer = Tokenizer.from_str(model)
    width = "<u2" if tokenizer.get_vocab_size() <= 65536 else "<u4"
    probe = "It is, as SAID: half-done!! 3.5% of Été und schließlich | it's $5... übermäßig ñandú e\u0301t\u00e9 ΑΣ"
    if WordIds(model, "<u4")(pa.array([probe]))[0].tolist() != tokenizer.encode(probe, add_special_tokens=False).ids:
        raise ValueError("this tokenizer does not read words apart from each other")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    loaded: dict[str, WordIds] = {}

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if width not in loaded:
            loaded[width] = WordIds(shared.value, width)
        known, end = loaded[width], np.asarray([end_id], width)
        for batch in batches:
            sizes, held, deals = [], [], []
            for ids in (ids for texts in slices(batch.column(1)) for ids in known(texts)):
                tokens = np.append(ids, end).tobytes()
                held.append(tokens)
                sizes.append(len(ids) + 1)
                deals.append(zlib.crc32(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(held, pa.binary()), pa.array(deals, pa.int64())],
                names=["doc_id", "doc_tokens", "ids", "deal"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(ids, "doc_id bigint, doc_tokens bigint, ids binary, deal bigint")
    return out.withColumn("width", F.lit(width))


def capacities(total: int, length: int) -> list[int]:
    """Room of the sequences that together hold exactly ``total`` tokens."""
    full, left = divmod(total, length)
    return [length] * full + [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]


def assign(sizes: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, size, sequence, offset) of every piece."""
    limits = np.asarray(capacities(int(sizes.sum()), length), np.int64)
    room, cost, pieces = limits.copy(), np.zeros(len(limits)), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        start, left = 0, int(sizes[item])
        while left:
            at = int(np.where(room >= left, cost, np.inf).argmin())
            if room[at] < left:
                at = int(np.where(room > 0, cost, np.inf).argmin())
            size = min(left, int(room[at]))
            pieces.append((item, start, size, at, int(limits[at] - room[at])))
            room[at] -= size
            cost[at] += LINEAR * size + QUADRATIC * size * size
            start, left = start + size, left - size
    return pieces


def packed(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it comes from, its ids and their CRC, and where it lies."""
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text)))).first()
    groups = max(1, -(-n_docs // GROUP), -(-(size or 0) // GROUP_BYTES))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "deal", "doc_tokens"], kind="stable").reset_index(drop=True)
        base, out = int(rows["group"].iat[0]) << 32, []
        held = [np.frombuffer(ids, rows["width"].iat[0]) for ids in rows["ids"]]
        tokens = rows["doc_tokens"].to_numpy(np.int64)
        sizes = tokens % length
        before = tokens - sizes

        def add(item: int, start: int, size: int, at: int, offset: int) -> None:
            out.append((item, start, size, held[item][start : start + size].astype("<u4").tobytes(), base + at, offset))

        for item, start, size, at, offset in assign(sizes, length):
            add(item, int(before[item]) + start, size, at, offset)
        after = len(capacities(int(sizes.sum()), length))
        for item, end in enumerate(before.tolist()):
            for start in range(0, end, length):
                add(item, start, length, after, 0)
                after += 1
        made = pd.DataFrame(out, columns=["item", "start", "length", "ids", "sequence_id", "offset"])
        made["doc_id"] = rows["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)[made["item"]]
        made["doc_tokens"] = rows["doc_tokens"].to_numpy()[made["item"]]
        return made[["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]]

    rows = tokenised(docs, tokenizer_file, end_id, id_col, text)
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "deal"), F.lit(groups)))
    pieces = dealt.groupBy("group").applyInPandas(pack, PIECES)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
