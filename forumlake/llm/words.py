"""Hashed words and word windows of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS_KEPT = 300_000  # entries of each of a worker's two tables of word hashes
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the code of every word of all texts one after the other, and the number of words of each text.

    Words lie between the characters x20 and x09 to x0D; NULL has none. The empty word may be listed, but has no code.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    # A cast slice keeps its place in the buffer, and ascii_lower then reads other bytes: a copy begins at 0.
    texts = pc.fill_null(pa.concat_arrays([texts.cast(pa.large_string())]), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    filled = which != words.index(b"") if b"" in words else np.ones(len(which), bool)  # white space at the ends
    return words, which[filled], np.diff(np.append(0, np.cumsum(filled))[offsets])


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each text. Each distinct word is hashed once."""
    words, which, sizes = coded_words(texts, lower)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[which], sizes


def each_text(texts: pa.Array, rows: int = 1000) -> Iterator[np.ndarray]:
    """Hashes of the lower-case (A-Z) words of every text, some rows at a time."""
    for k in range(0, len(texts), rows):
        hashes, sizes = hashed_words(texts.slice(k, rows), lower=True)
        yield from np.split(hashes, np.cumsum(sizes)[:-1])


class WordHashes:
    """Word -> 64-bit hash, with a bounded memory of the words met: a full table becomes the old one, from which
    words in use move to a new one."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > WORDS_KEPT:
            self.known, self.old = {}, self.known
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for word in {w for w, h in zip(words, found) if h is None}:
                h = self.old.get(word)
                known[word] = xxhash.xxh3_64_intdigest(word) if h is None else h
            found = list(map(known.__getitem__, words))
        return np.fromiter(found, np.uint64, len(found))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _FACTOR
        out += hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct window hashes; a text of fewer words is one window of all its words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(size, len(hashes))))
