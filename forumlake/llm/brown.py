"""LM scoring with Brown's class-based bigrams.

P(text) is the product over its tokens (words, then an end) of
P(class | class before) * P(word | class).

1. Words of the training documents are counted, all of them.
2. Core words, those with ``CORE_SHARE`` of the training tokens or more (at most 1 / share of
   them, at any size), are clustered by exchange: types move to the class that raises the
   likelihood of the class bigrams most. A pass counts, over the whole training text and in
   parallel, the classes before and after every type; moves are made on that table (half the
   types a pass, so that neighbours do not swap for ever) until a pass gains less than
   ``LEAST_GAIN`` a token. Other words stand in as types of their last three bytes meanwhile.
3. Every other word that the training text has more than once then moves by its own
   contexts: the classes beside it are counted over the whole text, summed by word in buckets
   that grow in number with the corpus, and the word takes the class that raises the
   likelihood most, beside the broadcast table of classes. Words met once, and words met in no training text,
   keep the class of their last three bytes.
4. Transitions are counted anew under all words' classes and smoothed towards the class
   frequencies, emissions by adding one, with one unseen word a class; both sum to one.
5. Counts and classes of the end and of the most frequent words (at most ``LOCAL``, by a histogram of the
   counts) go to every task. A document carries its other words, each once, to a join with
   the table of words. None of these is frequent, so no key is hot.

A document is training text unless crc32(id as text) mod 7 is 2. Words are told apart by a
64-bit hash. Defined results: a NULL text has no words and still has its end; a NULL id
counts as the empty string; repeated rows count and score as often as they are there;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from forumlake.llm.words import coded_words
from forumlake.session import stage

CORE_SHARE = 2e-5  # of the training tokens
SUFFIXES, CLASSES = 1024, 64
MOST_PASSES, LEAST_GAIN = 20, 1e-3  # of the exchange; natural log likelihood a token
LOCAL = 1 << 17
BUCKET = 2_000_000  # training tokens to a bucket of words
SMOOTH = 50.0  # weight of the class frequencies in a transition
ROWS = 1000  # texts whose words are looked up together
COUNTED = 500_000  # words that a task counts before it hands them on
CONTEXTS = 2_000_000  # contexts that a task gathers before it hands them on
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line break


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIXES


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, suffix, n) of the training text; the end has suffix -1."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        ends = 0

        def handed() -> pa.RecordBatch:
            terms = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
            kinds = np.fromiter(map(suffix, counts), np.int32, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))
            if ends:
                terms, kinds, n = np.append(terms, np.uint64(END)), np.append(kinds, np.int32(-1)), np.append(n, ends)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(kinds), pa.array(n)], names=["term", "suffix", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                texts = batch.column(0).slice(k, ROWS)
                words, which, _ = coded_words(texts, lower=True)
                ends += len(texts)
                for word, n in zip(words, np.bincount(which, minlength=len(words)).tolist()):
                    if n:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield handed()
                    counts, ends = {}, 0
        yield handed()

    rows = docs.select("text").mapInArrow(each, "term bigint, suffix int, n bigint")
    return rows.groupBy("term", "suffix").agg(F.sum("n").alias("n"))


class Table:
    """Columns of numbers by term, looked up by binary search."""

    def __init__(self, terms: np.ndarray, **columns: np.ndarray):
        by = np.argsort(terms)
        self.terms, self.columns = terms[by], {name: x[by] for name, x in columns.items()}

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each term is; -1 where it is not."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def look_up(self, name: str, terms: np.ndarray, missing: np.ndarray | int) -> np.ndarray:
        at = self.places(terms)
        return np.where(at >= 0, self.columns[name][at], missing) if len(self.terms) else np.broadcast_to(missing, terms.shape)


@dataclass(frozen=True)
class Vocabulary:
    """The size of the training text, the types of the core words, and the least count of words that go to every task."""

    tokens: int
    distinct: int
    core: Table
    local_from: int

    @property
    def suffix_type(self) -> int:
        """The first type of a word end; type 0 is the end, the core words lie between."""
        return 1 + len(self.core.terms)

    @property
    def types(self) -> int:
        return self.suffix_type + SUFFIXES


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: their number, distinct terms, their suffixes, the place of each word's term, and the words of each text."""
    for k in range(0, len(column), ROWS):
        words, which, sizes = coded_words(column.slice(k, ROWS), lower=True)
        terms = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        yield len(sizes), terms, np.fromiter(map(suffix, words), np.int64, len(words)), which, sizes


def with_ends(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The words' values with ``end`` behind each text's."""
    out = np.full(len(tokens) + len(sizes), end, tokens.dtype)
    out[np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)] = tokens
    return out


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens = total[0] or 0
    least = max(2, -(-tokens * CORE_SHARE // 1))
    words = counts.where((F.col("n") >= least) & (F.col("suffix") >= 0)).select("term", "n").orderBy(F.desc("n"), "term").toArrow()
    core = words.column("term").to_numpy().view(np.uint64)
    level = F.floor(F.log2("n") * 8)
    local_from, held = 1 << 62, 0
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():  # 8 a doubling
        if held + row["words"] > LOCAL:
            break
        local_from, held = row["n"], held + row["words"]
    return Vocabulary(tokens, total[1], Table(core, type=np.arange(1, len(core) + 1)), local_from)


def encoded(docs: DataFrame, vocabulary) -> DataFrame:
    """The types of all tokens of some texts, one after the other; an end closes every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary.value
        for batch in batches:
            rows = []
            for _, terms, ends, which, sizes in texts_of(batch.column(0)):
                kinds = held.core.look_up("type", terms, held.suffix_type + ends)
                rows.append(with_ends(kinds[which], sizes, 0).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["types"])

    return docs.select("text").mapInArrow(each, "types binary")


def contexts(codes: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts [type, class] of the classes before and after every type, over the whole training text."""
    shared = codes.sparkSession.sparkContext.broadcast(classes)
    types = len(classes)
    pieces = 16
    step = -(-types // pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        before, after = np.zeros(types * CLASSES, np.int64), np.zeros(types * CLASSES, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                now = np.frombuffer(row, "<u4").astype(np.int64)
                last = np.append(0, now[:-1])  # an end stands before every text
                before += np.bincount(now * CLASSES + of[last], minlength=len(before))
                after += np.bincount(last * CLASSES + of[now], minlength=len(after))
        both = np.stack([before.reshape(types, CLASSES), after.reshape(types, CLASSES)], axis=1)
        made = [zlib.compress(both[k * step : (k + 1) * step].tobytes(), 1) for k in range(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(made, pa.binary())], names=["piece", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in rows["counts"])
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "counts": [total.tobytes()]})

    schema = "piece int, counts binary"
    summed = codes.mapInArrow(count, schema).groupBy("piece").applyInPandas(add, schema).toArrow()  # core types, whatever the corpus
    found = dict(zip(summed.column("piece").to_pylist(), summed.column("counts").to_pylist()))
    empty = np.zeros((types, 2, CLASSES), np.int64)
    both = np.concatenate([np.frombuffer(found[k], np.int64).reshape(-1, 2, CLASSES) for k in range(pieces)]) if found else empty
    return both[:, 0], both[:, 1]


def by_class(table: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES, table.shape[1]), table.dtype)
    np.add.at(out, classes, table)
    return out


def association(pairs: np.ndarray) -> np.ndarray:
    """log P(class, class after) / (P(class) * P(class after)) of a table of counts."""
    pairs = pairs.astype(float) + 0.1
    return np.log(pairs / np.outer(pairs.sum(axis=1), pairs.sum(axis=0)) * pairs.sum())


def likelihood(pairs: np.ndarray) -> float:
    """Of the class bigrams, a token."""
    return float((pairs * association(pairs)).sum() / max(1, pairs.sum()))


def moved(classes: np.ndarray, before: np.ndarray, after: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Classes after each of the ``open_`` types went where the bigram likelihood gains most; the end stays alone."""
    lone = association(by_class(after, classes))
    gain = before @ lone + after @ lone.T
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    rows = np.arange(len(classes))
    stay = (gain[rows, best] <= gain[rows, classes] + 1e-9) | (before.sum(axis=1) == 0) | ~open_
    stay[0] = True
    return np.where(stay, classes, best)


def clustered(codes: DataFrame, types: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Classes of all types, the counts of class bigrams under them, and what the last pass gained a token. The most frequent
    types start as classes of their own, the others together in the last class."""
    classes = np.minimum(np.arange(types), CLASSES - 1)
    before, after = contexts(codes, classes)
    gained, low, now = np.inf, 0, likelihood(by_class(after, classes))
    for k in range(MOST_PASSES):
        turn = np.ones(types, bool) if k == 0 else np.arange(types) % 2 == k % 2
        classes = moved(classes, before, after, turn)
        before, after = contexts(codes, classes)
        last, now = now, likelihood(by_class(after, classes))
        gained = now - last
        low = low + 1 if gained < LEAST_GAIN else 0
        if low == 2:  # both halves
            break
    return classes, by_class(after, classes), gained


def summed_contexts(gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """A row per bucket with its distinct words, the number of cells of each, the cells and their counts, of words' hashes
    and the cells ahead of and behind each. Empties ``gathered``, and copies little more than it held."""
    terms, ahead, behind = map(np.concatenate, zip(*gathered))
    gathered.clear()
    order = np.argsort(terms)
    terms = terms[order]
    first = np.append(True, terms[1:] != terms[:-1])
    known = terms[first]
    bucket = ((known >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")  # words lie by bucket, then by hash
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by), dtype=np.int32)
    which = np.empty(len(order), np.int32)
    which[order] = place[np.cumsum(first, dtype=np.int32) - 1]
    del terms, order, first
    pair = np.concatenate([which, which]).astype(np.int64)
    pair *= 2 * CLASSES
    pair[: len(ahead)] += ahead
    pair[len(ahead) :] += behind
    pair.sort()
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    n = np.diff(np.append(starts, len(pair))).astype("<u4")
    pair = pair[starts]
    which, cells = (pair // (2 * CLASSES)).astype(np.int32), (pair % (2 * CLASSES)).astype("<u1")
    known, bucket = known[by], bucket[by]
    sizes = np.bincount(which, minlength=len(known)).astype("<u1")
    rows, words = [], np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    cuts = np.searchsorted(which, np.append(words, len(known)))
    for k, (low, high) in enumerate(zip(words, np.append(words[1:], len(known)))):
        s, e = cuts[k : k + 2]
        parts = (known[low:high].astype("<u8"), sizes[low:high], cells[s:e], n[s:e])
        rows.append((int(bucket[low]), *(zlib.compress(x.tobytes(), 1) for x in parts)))
    kinds = (pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "terms", "sizes", "cells", "n"])


def own_contexts(docs: DataFrame, vocabulary, classes) -> DataFrame:
    """(bucket, terms, sizes, cells, n): for the words outside the core, the classes before (cells below ``CLASSES``) and after."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = vocabulary.value, classes.value
        buckets = max(1, -(-held.tokens // BUCKET))
        gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ten bytes a word
        size = 0
        for batch in batches:
            for _, terms, ends, which, sizes in texts_of(batch.column(0)):
                kinds = held.core.look_up("type", terms, held.suffix_type + ends)
                rare = with_ends((kinds >= held.suffix_type)[which], sizes, False)
                now = with_ends(of[kinds].astype(np.uint8)[which], sizes, 0)
                at = np.flatnonzero(rare)  # a word has an end behind it at the latest, and one before its text
                gathered.append((with_ends(terms[which], sizes, END)[at], np.where(at > 0, now[at - 1], np.uint8(0)), now[at + 1] + np.uint8(CLASSES)))
                size += 2 * len(at)
                if size > CONTEXTS:
                    yield summed_contexts(gathered, buckets)
                    size = 0
        if size:
            yield summed_contexts(gathered, buckets)

    return docs.select("text").mapInArrow(each, "bucket bigint, terms binary, sizes binary, cells binary, n binary")


def placed(sent: DataFrame, lone) -> DataFrame:
    """(term, cls): the class that raises the likelihood most, for every word met more than once; of equally good ones the first."""

    def unpack(column, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(zlib.decompress(x), kind) for x in column])

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        terms = np.repeat(unpack(rows["terms"], "<u8"), unpack(rows["sizes"], "<u1"))
        cells, n = unpack(rows["cells"], "<u1").astype(np.int64), unpack(rows["n"], "<u4").astype(np.float64)
        known, which = np.unique(terms, return_inverse=True)
        uses = np.bincount(which, n * (cells < CLASSES))
        gains = np.concatenate([lone.value, lone.value.T])  # [cell, class]
        best = np.zeros(len(known), np.int64)
        order = np.argsort(which, kind="stable")
        which, cells, n = which[order], cells[order], n[order]
        for low in range(0, len(known), 20_000):
            high = min(len(known), low + 20_000)
            part = slice(*np.searchsorted(which, [low, high]))
            table = np.bincount((which[part] - low) * (2 * CLASSES) + cells[part], n[part], (high - low) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            gain = table @ gains
            gain[:, 0] = -np.inf
            best[low:high] = gain.argmax(axis=1)
        more = uses > 1
        return pd.DataFrame({"term": known[more].view(np.int64), "cls": best[more]})

    return sent.groupBy("bucket").applyInPandas(place, "term bigint, cls bigint")


def classed(docs: DataFrame, local, by_suffix) -> DataFrame:
    """One row per document: the classes of its tokens and sums over the local words; its other words, each once, and where they stand."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = local.value, by_suffix.value
        end = int(known.look_up("n", np.asarray([END], np.uint64), 0)[0])
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for size, terms, ends, which, sizes in texts_of(batch.column(2)):
                at = known.places(terms)
                counts = known.look_up("n", terms, -1)
                classes = known.look_up("cls", terms, of[ends])
                cuts = np.append(0, np.cumsum(sizes))
                logs = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 1.0), 0.0)[which]
                log_sums = np.bincount(np.repeat(np.arange(size), sizes), logs, size)  # of each text alone, so that no long one rounds its neighbours' sums
                seen = np.append(0, np.cumsum((counts > 0)[which]))
                out = {"classes": [], "rare": [], "place": [], "which": []}
                for s, e in zip(cuts[:-1], cuts[1:]):
                    mine = which[s:e]
                    place = np.flatnonzero(at[mine] < 0)
                    rare, back = np.unique(mine[place], return_inverse=True)
                    out["classes"].append(np.append(classes[mine], 0).astype("<u1").tobytes())
                    out["rare"].append(terms[rare].view(np.int64))
                    out["place"].append(place.astype("<u4").tobytes())
                    out["which"].append(back.astype("<u4").tobytes())
                rows = pa.array(range(row, row + size), pa.int64())
                row += size
                columns = [
                    rows,
                    *[c.slice(done, size) for c in batch.columns[:2]],
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(log_sums + np.log10(end + 1.0), pa.float64()),
                    pa.array(np.diff(seen[cuts]) + (end > 0), pa.int64()),
                    pa.array(out["classes"], pa.binary()),
                    pa.array(out["rare"], pa.list_(pa.int64())),
                    *[pa.array(out[k], pa.binary()) for k in ("place", "which")],
                ]
                done += size
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "log_sum", "n_known", "classes", "rare", "place", "which"])

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, log_sum double, n_known bigint, classes binary, rare array<bigint>, place binary, which binary"
    return docs.select("doc_id", "held_out", "text").mapInArrow(each, schema)


FINAL = "doc_id bigint, held_out boolean, n_tokens bigint, log_sum double, n_known bigint, classes binary"
FINAL_COLUMNS = [part.split()[0] for part in FINAL.split(", ")]


def with_rare(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` of :func:`classed` with the classes and sums of all words."""
    uses = rows.select("row", F.posexplode("rare").alias("k", "term"))
    found = uses.join(words.select("term", "n", "cls"), "term").groupBy("row").agg(F.collect_list(F.struct("k", "n", "cls")).alias("found"))  # a document's own words

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, seen, classes = [], [], []
            columns = [batch.column(name).to_pylist() for name in ("log_sum", "n_known", "classes", "place", "which", "rare_words")]
            found = batch.column("found")
            ends = np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            k, counted, placed_in = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
            for start, end, log, n, code, place, which, size in zip([0, *ends], ends, *columns):
                if end > start:
                    place, which = np.frombuffer(place, "<u4"), np.frombuffer(which, "<u4")
                    counts, of = np.zeros(size, np.int64), np.full(size, -1, np.int64)
                    met = slice(start, end)
                    counts[k[met]], of[k[met]] = counted[met], placed_in[met]
                    own = np.frombuffer(code, "<u1").copy()
                    own[place] = np.where(of[which] >= 0, of[which], own[place])
                    code, log, n = own.tobytes(), log + float(np.log10(counts[which] + 1.0).sum()), n + int((counts[which] > 0).sum())
                sums.append(log)
                seen.append(n)
                classes.append(code)
            kept = [batch.column(name) for name in ("doc_id", "held_out", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.float64()), pa.array(seen, pa.int64()), pa.array(classes, pa.binary())], names=["doc_id", "held_out", "n_tokens", "log_sum", "n_known", "classes"])

    slim = rows.withColumn("rare_words", F.size("rare")).drop("rare")
    return slim.join(found, "row", "left").mapInArrow(each, FINAL)


def class_bigrams(codes: DataFrame) -> np.ndarray:
    """Counts of class and class after over the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            now = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u1").astype(np.int64)  # every text ends with the end's class
            if len(now):
                pairs += np.bincount(np.append(0, now[:-1]) * CLASSES + now, minlength=len(pairs))
        cells = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(pairs[cells], pa.int64())], names=["cell", "n"])

    out = np.zeros(CLASSES * CLASSES, np.int64)
    for cell, n in codes.where(~F.col("held_out")).select("classes").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():  # classes squared
        out[cell] = n
    return out.reshape(CLASSES, CLASSES)


@dataclass(frozen=True)
class ClassModel:
    """log10 of the transitions and of the emissions' denominators."""

    steps: np.ndarray
    totals: np.ndarray


def model_of(pairs: np.ndarray, distinct: np.ndarray) -> ClassModel:
    uses = pairs.sum(axis=0).astype(float)  # tokens of a class
    share = (uses + 1) / (uses + 1).sum()
    steps = np.log10((pairs + SMOOTH * share[None, :]) / (pairs.sum(axis=1, keepdims=True) + SMOOTH))
    return ClassModel(steps, np.log10(uses + distinct + 1))


def class_scores(codes: DataFrame, model) -> DataFrame:
    """``codes`` with ``class_sum`` instead of the classes: transitions less the emissions' denominators."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, totals = model.value.steps, model.value.totals
        for batch in batches:
            sums = []
            for code in batch.column(5).to_pylist():
                now = np.frombuffer(code, "<u1")
                sums.append(float(steps[np.append(0, now[:-1]), now].sum() - totals[now].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.float64())], names=["doc_id", "held_out", "n_tokens", "log_sum", "n_known", "class_sum"])

    return codes.mapInArrow(each, "doc_id bigint, held_out boolean, n_tokens bigint, log_sum double, n_known bigint, class_sum double")


def word_classes(train: DataFrame, counts: DataFrame, vocabulary) -> tuple[DataFrame, np.ndarray, float]:
    """(term, n, cls) of all training words, the class of every word end, and what the last pass of the exchange gained."""
    spark, held = train.sparkSession, vocabulary.value
    codes = stage(encoded(train, vocabulary), "codes")
    classes, pairs, gained = clustered(codes, held.types)
    lone = spark.sparkContext.broadcast(association(pairs))
    own = placed(own_contexts(train, vocabulary, spark.sparkContext.broadcast(classes)), lone)
    core_classes = classes[held.core.columns["type"]] if len(held.core.terms) else np.zeros(0, np.int64)
    core = spark.createDataFrame(pd.DataFrame({"term": held.core.terms.view(np.int64), "cls": core_classes.astype(np.int64)}), "term bigint, cls bigint")
    by_suffix = classes[held.suffix_type :]
    ends = F.element_at(F.lit([int(c) for c in by_suffix]), F.col("suffix") + 1).cast("bigint")
    cls = F.when(F.col("suffix") < 0, F.lit(0)).otherwise(F.coalesce("cls", ends))
    return counts.join(own.unionByName(core), "term", "left").select("term", "n", cls.alias("cls")), by_suffix, gained


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its length, known tokens, and log10 probability under the add-one unigram (``base_score``)
    and under the class model (``score``); ``last_gain`` is what the last pass of the exchange gained a token."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("text"))
    train = docs.where(~F.col("held_out"))
    counts = stage(word_counts(train), "word-counts")
    vocabulary = vocabulary_of(counts)
    words, by_suffix, gained = word_classes(train, counts, context.broadcast(vocabulary))
    words = stage(words, "words")
    end = int(np.uint64(END).view(np.int64))
    rows = words.where((F.col("n") >= vocabulary.local_from) | (F.col("term") == end)).toArrow()  # at most LOCAL and the end, which few long texts make rare
    local = Table(rows.column("term").to_numpy().view(np.uint64), n=rows.column("n").to_numpy(), cls=rows.column("cls").to_numpy())
    coded = classed(docs, context.broadcast(local), context.broadcast(by_suffix))
    coded = coded.select(*FINAL_COLUMNS) if len(rows) == vocabulary.distinct else with_rare(stage(coded, "classes"), words)
    coded = stage(coded, "all-classes")
    distinct = np.zeros(CLASSES)
    for cls, n in words.groupBy("cls").count().collect():  # one row a class
        distinct[cls] = n
    model = context.broadcast(model_of(class_bigrams(coded), distinct))
    per_token = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1))
    return (
        class_scores(coded, model)
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
            (F.col("log_sum") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
            (F.col("log_sum") + F.col("class_sum")).alias("score"),
        )
        .withColumns({"perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")), "last_gain": F.lit(gained)})
    )
