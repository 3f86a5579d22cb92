"""Substring dedup: passages found again by FM-indexes, one a shard of documents.

A window is ``WINDOW`` (or another given number of) consecutive words. Every word under a
window that also begins in a document with a smaller id is removed. The operator returns
the text that is kept, its words one space apart, and the removed spans: the stretches of
such windows that follow one another and have one least id, which may overlap.

The documents are dealt into shards of about ``SHARD`` bytes by a hash. Streaming every
document against every shard's index would square the work, so hashes first say where a
passage can be found:

1. Sieve by anchors: the least 6-word hash of every window (shorter windows are their own). A shard sends its distinct
   anchors once each to buckets, which answer with those that several documents have.
2. Sieve by windows: of the windows on such anchors a shard sends the distinct hashes
   with the least id that holds them; buckets answer with the owner, the shard of the
   least id, of each hash that several documents have.
3. Each shard indexes the passages that it owns (a compressed FM-index: wavelet matrix of
   the BWT, packed bits with ranks) and the other shards stream theirs to it, each text
   once. Backward search gives the matching statistics; where a whole window matches, the
   least id in its interval of suffixes is the answer.
4. Each shard removes what was found in smaller ids.

A passage of any number of documents is sent at most once by a shard, so no bucket or
owner gathers the copies. Rows of a shard may reach its steps in any order (another executor,
a task that is run again), and steps speak of places in the shard: it is ordered by id and
text each time it is made. Words are compared by 32 bits of their hash within passages
whose anchors and windows agree by 64.

Defined results: a NULL text has no words; a NULL id is larger than every other and
never smaller than another NULL; rows that repeat an id and a text get equal results and
do not count as each other's earlier document; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumlake.llm.common import byte_texts
from forumlake.llm.fm_index import FMIndex
from forumlake.llm.words import hashed_words, mix, windows

WINDOW, ANCHOR = 13, 6
SHARD = 8 << 20  # bytes of text
ASKED_AT_ONCE = 2_000_000  # words
BUCKET_SHARDS = 8  # shards' worth of hashes to a bucket
SMALLEST = np.iinfo(np.int64).max  # stands for a NULL id
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

SENT = "bucket bigint, shard bigint, hashes binary, least binary, several binary"
ANSWER = "shard bigint, hashes binary, owners binary"
PASSAGES = "shard bigint, kind int, source bigint, words binary, sizes binary, orders binary, marks binary"
# Words ``start`` to ``end`` (from 0, ``end`` not included) are in ``least_id`` too, the smallest id that has them.
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("least_id", pa.int64())]))
REMOVED = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start: bigint, end: bigint, least_id: bigint>>"


class Shard:
    """The documents of a shard: hashed words one after the other, their windows and anchors."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.table = table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").to_pylist()
        self.orders = table.column("order").to_numpy()
        self.hashes, self.sizes = hashed_words(table.column("text"))
        self.offsets = np.append(0, np.cumsum(self.sizes))
        n = max(0, len(self.hashes) - window + 1)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        start = np.arange(n)
        self.start = start[doc[start] == doc[start + window - 1]]  # windows within one document
        self.doc = doc[self.start]
        self.order = self.orders[self.doc]

    def anchors(self) -> np.ndarray:
        """The anchor of every window."""
        anchor = min(ANCHOR, self.window)
        short = windows(self.hashes, anchor)
        best = np.zeros(0, np.uint64)
        if len(self.start):
            best = short[self.start]
            for k in range(1, self.window - anchor + 1):
                np.minimum(best, short[self.start + k], out=best)
        return best

    def window_hashes(self) -> np.ndarray:
        return windows(self.hashes, self.window)[self.start] if len(self.start) else np.zeros(0, np.uint64)


def summed(hashes: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the least order of each, and whether it has several."""
    by = np.lexsort((orders, hashes))
    hashes, orders = hashes[by], orders[by]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(hashes))
    return hashes[starts], orders[starts], orders[starts] != orders[ends - 1] if len(starts) else np.zeros(0, bool)


def to_buckets(shard: int, hashes: np.ndarray, orders: np.ndarray, buckets: int) -> pa.Table:
    found, least, several = summed(hashes, orders)
    bucket = ((found >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    found, least, several, bucket = found[by], least[by], several[by], bucket[by]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)  # at most one a hash
    rows = [(int(bucket[s]), shard, found[s:e].tobytes(), least[s:e].tobytes(), several[s:e].tobytes()) for s, e in zip(cuts, np.append(cuts[1:], len(bucket)))]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("bucket", "shard", "hashes", "least", "several"), kinds))})


def answers(table: pa.Table) -> pa.Table:
    """For each shard of a bucket, its hashes that several documents have, and the shard of the least order."""
    shards = table.column("shard").to_numpy()
    parts = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    shard = np.repeat(shards, [len(p) for p in parts])
    least = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("least").to_pylist()])
    several = np.concatenate([np.frombuffer(x, bool) for x in table.column("several").to_pylist()])
    by = np.lexsort((shard, least, hashes))
    hashes, shard, least, several = hashes[by], shard[by], least[by], several[by]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    group = np.cumsum(np.append(False, hashes[1:] != hashes[:-1]))
    ends = np.append(starts[1:], len(hashes))
    shared = (least[starts] != least[ends - 1]) | np.logical_or.reduceat(several, starts)
    kept = shared[group]
    hashes, owner, shard = hashes[kept], shard[starts][group][kept], shard[kept]
    by = np.argsort(shard, kind="stable")
    hashes, owner, shard = hashes[by], owner[by], shard[by]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    rows = [(int(shard[s]), hashes[s:e].tobytes(), owner[s:e].astype("<u4").tobytes()) for s, e in zip(cuts, np.append(cuts[1:], len(shard)))]
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "owners": pa.array([r[2] for r in rows], pa.binary())})


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def runs(shard: Shard, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (by place among the shard's windows) of the stretches with one owner; -1 has none."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (owner[1:] != owner[:-1]) | (shard.doc[1:] != shard.doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    kept = owner[first] >= 0
    return first[kept], last[kept]


def passage_rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ("shard", "kind", "source", "words", "sizes", "orders", "marks")
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


OWN, ASKED, PLACES, FOUND = range(4)


def passages(shard_no: int, shard: Shard, answer: pa.Table) -> pa.Table:
    """What a shard owns (to itself), what it asks of owners (each text once), and where its passages lie (to itself)."""
    hashes, owners = joined(answer, "hashes", "<u8"), joined(answer, "owners", "<u4").astype(np.int64)
    by = np.argsort(hashes)
    hashes, owners = hashes[by], owners[by]
    mine = shard.window_hashes()
    owner = np.full(len(mine), -1, np.int64)
    if len(hashes):
        place = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
        hit = hashes[place] == mine
        owner[hit] = owners[place[hit]]
    words = (shard.hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
    first, last = runs(shard, owner)
    to = owner[first]
    cut = [words[shard.start[a] : shard.start[b] + shard.window] for a, b in zip(first, last)]
    out = []
    own = np.flatnonzero(to == shard_no)
    if len(own):
        # Of equal passages, the one with the least order is enough.
        seen: dict[bytes, int] = {}
        for k in own[np.argsort(shard.order[first[own]], kind="stable")]:
            seen.setdefault(cut[k].tobytes(), int(shard.order[first[k]]))
        out.append((shard_no, OWN, shard_no, b"".join(seen), np.asarray([len(x) // 4 for x in seen], "<u4").tobytes(), np.asarray(list(seen.values()), "<i8").tobytes(), b""))
    marks = np.asarray([int.from_bytes(hashlib.md5(c.tobytes(), usedforsecurity=False).digest()[:8], "little") for c in cut], "<u8")
    for owner_no in np.unique(to):
        here = np.flatnonzero(to == owner_no)
        _, once = np.unique(marks[here], return_index=True)
        some = here[once]
        out.append((int(owner_no), ASKED, shard_no, b"".join(cut[k].tobytes() for k in some), np.asarray([len(cut[k]) for k in some], "<u4").tobytes(), b"", marks[some].tobytes()))
    if len(first):
        where = np.stack([first, last], axis=1).astype("<u4")
        out.append((shard_no, PLACES, shard_no, where.tobytes(), b"", b"", marks.tobytes()))
    return passage_rows(out)


def search(table: pa.Table, window: int) -> pa.Table:
    """A shard's FM-index searched for what is asked of it; places pass through.

    Answers hold, for each window of a passage, the least order of a document that has it (or none).
    """
    rows = table.to_pylist()
    shard_no = rows[0]["shard"]
    out = [tuple(r[n] for n in ("shard", "kind", "source", "words", "sizes", "orders", "marks")) for r in rows if r["kind"] == PLACES]
    own = [r for r in rows if r["kind"] == OWN]
    parts, orders = [], []
    for r in own:
        sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
        parts += np.split(np.frombuffer(r["words"], "<u4"), np.cumsum(sizes)[:-1])
        orders += np.frombuffer(r["orders"], "<i8").tolist()
    asked = [r for r in rows if r["kind"] == ASKED]
    if not asked:
        return passage_rows(out)
    index = FMIndex(parts, window)
    # The order of the document of every place of the indexed text (gaps belong to none).
    of = np.concatenate([[SMALLEST], *[np.append(np.full(len(p), o), SMALLEST) for p, o in zip(parts, orders)]]).astype(np.int64)
    sorted_orders = np.append(of[index.suffixes], SMALLEST)
    # Runs of askers are searched together: equal windows of theirs only once.
    run, size = [], 0
    for r in asked:
        run.append(r)
        size += len(r["words"]) // 4
        if size > ASKED_AT_ONCE or r is asked[-1]:
            out += found_orders(index, sorted_orders, run, shard_no, window)
            run, size = [], 0
    return passage_rows(out)


def found_orders(index: FMIndex, sorted_orders: np.ndarray, asked: list[dict], shard_no: int, window: int) -> list[tuple]:
    sizes = np.concatenate([np.frombuffer(r["sizes"], "<u4") for r in asked]).astype(np.int64)
    text = np.concatenate([np.frombuffer(r["words"], "<u4") for r in asked])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    counts = sizes - window + 1
    at = np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum()) + window - 1
    same = np.zeros(len(at), np.uint64)
    for k in range(window):
        same = same * _FACTOR + text[at - k]
    _, first, back = np.unique(mix(same), return_index=True, return_inverse=True)
    found, low, high = index.matching(text, at[first], window)
    least = np.full(len(first), SMALLEST, np.int64)
    whole = np.flatnonzero(found == window)
    if len(whole):
        lows, which = np.unique(low[whole], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high[whole]
        least[whole] = np.minimum.reduceat(sorted_orders, np.stack([lows, highs], axis=1).ravel())[::2][which]
    least, out, at, passage = least[back], [], 0, 0
    for r in asked:
        mine = counts[passage : passage + len(r["sizes"]) // 4]
        part = least[at : at + int(mine.sum())]
        out.append((r["source"], FOUND, shard_no, b"", mine.astype("<u4").tobytes(), zlib.compress(part.astype("<i8").tobytes(), 1), r["marks"]))
        at, passage = at + len(part), passage + len(mine)
    return out


def removed(table: pa.Table, found: pa.Table, window: int) -> pa.Table:
    """Results of a shard's documents."""
    shard = Shard(table, window)
    rows = found.to_pylist()
    known: dict[int, np.ndarray] = {}
    for r in rows:
        if r["kind"] == FOUND:
            counts = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            least = np.frombuffer(zlib.decompress(r["orders"]), "<i8")
            known |= zip(np.frombuffer(r["marks"], "<u8").tolist(), np.split(least, np.cumsum(counts)[:-1]))
    least = np.full(len(shard.start), SMALLEST, np.int64)
    for r in rows:
        if r["kind"] == PLACES:
            where = np.frombuffer(r["words"], "<u4").reshape(-1, 2)
            for (a, b), mark in zip(where.tolist(), np.frombuffer(r["marks"], "<u8").tolist()):
                least[a : b + 1] = known[mark]
    hit = np.flatnonzero(least < shard.order)
    at, least, doc = shard.start[hit], least[hit], shard.doc[hit]
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))) if len(at) else at
    last = np.append(new[1:], len(at)) - 1 if len(at) else at
    doc, start, end, least = doc[new], at[new], at[last] + window, least[new]
    cover = np.zeros(len(shard.hashes) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)
    gone = np.cumsum(cover[:-1]) > 0
    first = np.searchsorted(doc, np.arange(len(shard.sizes) + 1))
    out = []
    for k, body in enumerate(byte_texts(shard.table.column("text"))):
        words = body.split()
        off = gone[shard.offsets[k] : shard.offsets[k + 1]]
        n = int(off.sum())
        kept = [w for w, x in zip(words, off) if not x] if n else words
        mine, before = slice(first[k], first[k + 1]), int(shard.offsets[k])
        spans = [{"start": s - before, "end": e - before, "least_id": x} for s, e, x in zip(start[mine].tolist(), end[mine].tolist(), least[mine].tolist())]
        out.append((shard.ids[k], len(words), n, b" ".join(kept), spans))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), SPANS)
    names = ("doc_id", "n_words", "n_removed", "kept_text", "spans")
    made = pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds))})
    return made.set_column(3, "kept_text", made.column("kept_text").cast(pa.string()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, words removed, the text kept and its digest, and the removed spans."""
    if window < 1:
        raise ValueError("a window has at least one word")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    buckets = max(1, -(-shards // BUCKET_SHARDS))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("bigint"), F.col(text)), F.lit(shards)).alias("shard"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(SMALLEST)).cast("bigint")).alias("order"),
        F.col(text).alias("text"),
    )
    dealt = rows.repartition(shards, "shard")

    def anchors(table: pa.Table) -> pa.Table:
        shard = Shard(table, window)
        return to_buckets(table.column("shard")[0].as_py(), shard.anchors(), shard.order, buckets)

    def repeats(table: pa.Table, answer: pa.Table) -> pa.Table:
        shard = Shard(table, window)
        known = np.sort(joined(answer, "hashes", "<u8"))
        own = shard.anchors()
        place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        on = known[place] == own if len(known) else np.zeros(len(own), bool)
        return to_buckets(table.column("shard")[0].as_py(), shard.window_hashes()[on], shard.order[on], buckets)

    def owned(table: pa.Table, answer: pa.Table) -> pa.Table:
        return passages(table.column("shard")[0].as_py(), Shard(table, window), answer)

    def searched(table: pa.Table) -> pa.Table:
        return search(table, window)

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        return removed(table, found, window)

    by_shard = dealt.groupBy("shard")
    sieved = by_shard.applyInArrow(anchors, SENT).groupBy("bucket").applyInArrow(answers, ANSWER)
    sieved = by_shard.cogroup(sieved.groupBy("shard")).applyInArrow(repeats, SENT).groupBy("bucket").applyInArrow(answers, ANSWER)
    found = by_shard.cogroup(sieved.groupBy("shard")).applyInArrow(owned, PASSAGES).groupBy("shard").applyInArrow(searched, PASSAGES)
    done = by_shard.cogroup(found.groupBy("shard")).applyInArrow(finish, REMOVED)
    return done.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256))
