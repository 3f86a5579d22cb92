"""Periodic runs of words, found with a dictionary of basic factors.

A basic factor is a stretch of 2^k words of one document. Its name at level k is the rank of
the pair of names of its halves, so equal names mean equal words. At each level:

- A factor's successor is the next place in its document with the same name. Successors
  that begin within the factor, so that both lie in twice its length, and whose own
  successor is as far off again, form arithmetic progressions; their step proposes a period.
- Neighbouring places with one step are one proposal. Its stretch is extended to both sides
  while words a period apart are identical.
- A run is proposed at every level from that of its period on, while three factors fit in;
  equal proposals are made one.

No run is lost: let its period be q, its length 4q or more, and L the least power of two of
q or more, so L < 2q. Inside the run a factor of L words comes again after exactly q words (a
smaller step would be a smaller period), and the first of them twice, since 2q + L <= 4q. A
step that survives as the period of four times its length is the smallest period: a smaller
one would divide it and be the successor's step.

Names of places whose factor is unique in its document are dropped level by level, so plain
prose is done after a few. Names are made for some megabytes of documents at once; a name
never spans two documents.

A word is dropped from ``collapsed_text`` if a run contains it after that run's first period.

Defined results: a NULL text has no words; a NULL id seeds as the empty string; rows that
repeat an id and a text have equal results; other columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumlake.llm.packing import slices
from forumlake.llm.words import coded_words

LEAST_WORDS, LEAST_PERIODS = 6, 4
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
COLLAPSED = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string"


def named(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose key comes more than once, their names from 1 on, and each one's successor (-1: none); by name and place."""
    if not len(keys):
        return places, places, places
    by = np.argsort(keys, kind="stable")
    keys, places = keys[by], places[by]
    same = keys[1:] == keys[:-1]
    kept = np.append(same, False) | np.append(False, same)
    after = np.append(np.where(same, places[1:], -1), -1)[kept]
    names = np.cumsum(np.append(True, ~same))[kept]
    return places[kept], names, after


def proposals(level: int, places: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the stretches whose places have successors one step apart."""
    step = np.zeros(size, np.int64)
    near = (after >= 0) & (after - places <= 1 << level)
    step[places[near]] = (after - places)[near]
    at = np.flatnonzero(step)
    at = at[step[at + step[at]] == step[at]]  # three in progression
    if not len(at):
        return at, at, at
    first = np.append(True, (np.diff(at) != 1) | (np.diff(step[at]) != 0))
    starts = at[first]
    lasts = at[np.append(first[1:], True)]
    return starts, lasts + 2 * step[starts] + (1 << level), step[starts]


def extended(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches carried on to both sides while words a period apart are identical."""
    starts, ends = starts.copy(), ends.copy()
    open_ = np.arange(len(starts))
    while len(open_):
        at = starts[open_] - 1
        on = at >= 0
        on[on] = words[at[on]] == words[at[on] + periods[open_[on]]]
        open_ = open_[on]
        starts[open_] -= 1
    open_ = np.arange(len(ends))
    while len(open_):
        at = ends[open_]
        on = at < len(words)
        on[on] = words[at[on]] == words[at[on] - periods[open_[on]]]
        open_ = open_[on]
        ends[open_] += 1
    return starts, ends


def periodic_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period, of documents whose word numbers lie one after the other.

    Words of different documents are made different numbers first.
    """
    nothing = np.zeros((0, 3), np.int64)
    if not len(words):
        return nothing
    doc = np.repeat(np.arange(len(sizes)), sizes)
    words = doc * (int(words.max()) + 1) + words
    places, names, after = named(words, np.arange(len(words)))
    found, level = [nothing], 0
    while len(places):
        starts, ends, periods = proposals(level, places, after, len(words))
        if len(starts):
            starts, ends = extended(words, starts, ends, periods)
            found.append(np.stack([starts, ends - starts, periods], axis=1))
        name = np.zeros(len(words), np.int64)
        name[places] = names
        half = 1 << level
        places = np.sort(places[places < len(words) - half])
        places = places[name[places + half] > 0]
        places, names, after = named(name[places] * (int(names.max()) + 1) + name[places + half], places)
        level += 1
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * runs[:, 2])]
    return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def repeated_tail(n: int, seed: int) -> np.ndarray | None:
    """Which original word each of ``n`` words becomes under the seed; None leaves them as they are."""
    g, change = divmod(seed, 10)
    if change or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seeded: bool = False) -> DataFrame:
    """One row per document: its words' number, its runs by start and period, and its text with each run cut to one period.

    With ``seeded``, the documents that a hash of the id picks have the words from one place on replaced by a repeated
    stretch of their own before they are searched, which plants runs of known periods.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0), 0
            for texts in slices(batch.column(1)):
                some = ids.slice(done, len(texts))
                done += len(texts)
                words, which, sizes = coded_words(texts)
                ends = np.cumsum(sizes)
                seeds = [zlib.crc32(b"" if i is None else b"%d" % i) for i in some.to_pylist()] if seeded else []
                changed = set()
                for k, seed in enumerate(seeds):
                    source = repeated_tail(int(sizes[k]), seed)
                    if source is not None:
                        part = slice(ends[k] - sizes[k], ends[k])
                        which[part] = which[part][source]
                        changed.add(k)
                runs = periodic_runs(which, sizes)
                of = np.searchsorted(runs[:, 0], np.append(0, ends))
                all_runs, bodies = [], []
                for k, body in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                    begin = int(ends[k] - sizes[k])
                    mine = runs[of[k] : of[k + 1]] - [begin, 0, 0]
                    if k in changed or len(mine):
                        codes = which[begin : ends[k]]
                        bodies.append(b" ".join([words[c] for c in codes[kept_words(len(codes), mine)].tolist()]))
                    else:
                        bodies.append(b" ".join(body.split()))
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()])
                columns = [some, pa.array(sizes, pa.int64()), pa.array(all_runs, _RUNS), pa.array(bodies, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed_text"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(each, COLLAPSED)


def digests(collapsed: DataFrame) -> DataFrame:
    """The longest run (of these the first, of these the one of the smallest period) and digests of all runs and of the text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return collapsed.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
