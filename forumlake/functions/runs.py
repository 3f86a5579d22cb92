"""Terms of documents cut into runs of equal ones, a batch of documents at a time."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers get this small module with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 1_000_000  # words that are cut at once; one document may have more
DOCUMENTS = 2**15  # documents that are cut at once, so that a short number tells them apart


def pairs_of(codes: np.ndarray, doc: np.ndarray, words: pa.Array, frequent: frozenset[str]) -> tuple[np.ndarray, pa.Array]:
    """The code of the pair that every word (-1: none) makes with the next of its document, -1 where neither is ``frequent``, and the pairs."""
    often = np.fromiter((w in frequent for w in words.to_pylist()), bool, len(words))
    often = np.append(often, False)  # for code -1
    after = np.append(codes[1:], -1) if len(codes) else codes
    made = (codes >= 0) & (after >= 0) & (np.append(doc[1:], -1)[: len(doc)] == doc) & (often[codes] | often[after])
    known, which = np.unique(codes[made] * len(words) + after[made], return_inverse=True)
    out = np.full(len(codes), -1, np.int64)
    out[made] = which
    first, second = np.divmod(known, max(1, len(words)))
    return out, pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")


def terms_of(codes: np.ndarray, words: pa.Array, named: Callable[[list[str]], list[str | None]]) -> tuple[np.ndarray, pa.Array]:
    """The code of every word's term, -1 where it has none, and the terms."""
    coded = pa.array(named(words.to_pylist()), pa.string()).dictionary_encode()
    of = np.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), -1)  # the last for code -1
    return of[codes], coded.dictionary


Names = Callable[[], Callable[[list[str]], list[str | None]]]
Cut = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def ordered_words(batch: pa.RecordBatch, frequent: frozenset[str] | None, named: Callable | None, buckets: int = 1) -> tuple:
    """The terms' words by type, bucket, term and document: each one's document, code and place, a number for type and bucket together,
    and the documents' lengths and the terms."""
    lists = batch.column("terms")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if named is not None:
        codes, words = terms_of(codes, words, named)
    if frequent is not None:
        codes, words = pairs_of(codes, doc, words, frequent)
    if len(codes) and codes.min() < 0:
        there = codes >= 0
        doc, at, codes = doc[there], at[there], codes[there]
    # The sort of the stored table merges these runs instead of comparing single rows.
    place = np.empty(len(words), np.int64)
    place[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    bucket = np.zeros(len(words), np.int64)
    if buckets > 1:
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
    types = batch.column("type").dictionary_encode()
    kind = types.indices.fill_null(len(types.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    group = kind[doc] * buckets + bucket[codes]
    order = np.argsort((group * max(1, len(words)) + place[codes]) * len(sizes) + doc, kind="stable")
    return doc[order], codes[order], at[order], group[order], np.bincount(doc, minlength=len(sizes)), words


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a key differs from the one before, and 0."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    differs = np.zeros(len(keys[0]), bool)
    differs[0] = True
    for key in keys:
        differs[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(differs)


def nexts(starts: np.ndarray, end: int) -> np.ndarray:
    """Where the next one starts, or ``end``."""
    return np.append(starts[1:], end)[: len(starts)]


def in_batches(batches: Iterator[pa.RecordBatch], cut: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.cumsum(batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            before = total[low - 1] if low else 0
            high = min(low + DOCUMENTS, max(low + 1, int(np.searchsorted(total, before + WORDS, "right"))))
            yield cut(batch.slice(low, high - low))
            low = high


def lists_of(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)


def cut_runs(row: tuple[str, ...], frequent: frozenset[str] | None = None, names: Names | None = None) -> Cut:
    """For ``mapInArrow`` over the columns ``row`` and ``terms``: one row per document and distinct term with tf, dl and positions.
    With ``frequent`` words the terms are the pairs of neighbours with one of them. ``names``, called once a task, gives what turns
    distinct words into terms (None: not indexed) where ``terms`` are words yet."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = names() if names is not None else None

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, codes, at, _, lengths, words = ordered_words(batch, frequent, named)
            starts = firsts(doc, codes)
            ends = np.append(starts, len(doc))
            of = pa.array(doc[starts])
            columns = {name: batch.column(name).take(of) for name in row}
            columns["term"] = words.take(pa.array(codes[starts]))
            columns["tf"] = pa.array(np.diff(ends), pa.int32())
            columns["dl"] = pa.array(lengths[doc[starts]], pa.int32())
            columns["positions"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return in_batches(batches, cut)

    return each


def cut_packs(row: tuple[str, ...], buckets: int, frequent: frozenset[str] | None = None, names: Names | None = None) -> Cut:
    """The rows of :func:`cut_runs`, those of a type and bucket in one row: ``type``, ``bucket``, a list of each other column of
    ``row`` and ``dl`` with one entry a document, and

    ``terms``, one a line, and for each by how many the postings up to its last exceed the terms (``until``);
    for each posting its ``doc`` in those lists and by how many its words up to here exceed its postings (``excess``);
    the places of all words, in ``near`` as short numbers, or in ``far`` where some are too large."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = names() if names is not None else None

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, codes, at, group, lengths, words = ordered_words(batch, frequent, named, buckets)
            starts = firsts(doc, codes)
            of, term, number = doc[starts], codes[starts], group[starts]
            packs = firsts(number)  # first posting of each
            ends = nexts(packs, len(of))
            sizes = ends - packs
            term_starts = firsts(term, number)
            term_ends = nexts(term_starts, len(of))
            word_ends = nexts(starts, len(doc))
            first_word = starts[packs]
            pack = np.repeat(np.arange(len(packs)), sizes)
            held, which = np.unique(pack * max(1, batch.num_rows) + of, return_inverse=True)
            held_pack, held_doc = np.divmod(held, max(1, batch.num_rows))
            held_ends = np.searchsorted(held_pack, np.arange(len(packs)), "right")
            held_starts = np.append(0, held_ends)[: len(packs)]
            places_end = nexts(first_word, len(doc))
            long = len(at) > 0 and at.max() >= 2**15
            none = np.zeros(len(packs), np.int64)
            columns = {"type": batch.column("type").take(pa.array(of[packs])), "bucket": pa.array(number[packs] % buckets, pa.int32())}
            columns |= {name: lists_of(held_ends, batch.column(name).take(pa.array(held_doc))) for name in row if name != "type"}
            columns["dl"] = lists_of(held_ends, pa.array(lengths[held_doc], pa.int32()))
            term_lists = np.searchsorted(term_starts, ends, "left")
            term_pack = pack[term_starts]
            before = np.append(0, term_lists)[: len(packs)]
            columns["terms"] = pc.binary_join(lists_of(term_lists, words.take(pa.array(term[term_starts]))), "\n")
            columns["until"] = lists_of(term_lists, pa.array((term_ends - packs[term_pack]) - (np.arange(len(term_starts)) - before[term_pack] + 1), pa.int32()))
            columns["doc"] = lists_of(ends, pa.array(which - held_starts[pack], pa.int16()))
            columns["excess"] = lists_of(ends, pa.array((word_ends - first_word[pack]) - (np.arange(len(of)) - packs[pack] + 1), pa.int32()))
            columns["near"] = lists_of(none if long else places_end, pa.array(at[:0] if long else at, pa.int16()))
            columns["far"] = lists_of(places_end if long else none, pa.array(at if long else at[:0], pa.int32()))
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return in_batches(batches, cut)

    return each
