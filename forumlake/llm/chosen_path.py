"""N-gram Jaccard join by chosen paths.

A text is the set of its word shingles; equal sets are one node. A node is embedded as
``POSITIONS`` min-hash values, two nodes agreeing at a position with the probability of
their Jaccard similarity.

1. Each of ``RUNS`` runs splits all nodes on the value at one position. Buckets of more
   than ``SMALL`` nodes are split again on positions drawn for the bucket (1 / similarity
   of them in expectation), down to ``DEPTH``: nodes of one path share every value on it.
2. Small buckets are searched by brute force on the sketches; what stays larger at the
   last depth is searched in blocks. A bucket gives a forest of candidate links: a breadth-
   first search compares nodes only with those not yet reached, so a bucket full of copies
   costs about one comparison a node, and never emits all its pairs.
3. Connected candidates are verified on their whole shingle sets, block against block:
   exact similarities give each node's links and a forest of true links, whose components
   are the classes.

Two sets at the threshold meet in a run with probability 0.8 at the first level and, if
the bucket is split to the last depth, 0.8 * 0.468; 16 runs miss them with probability
0.0006 at most, more similar ones far less. Sketches pass a pair at 0.6 (four standard
deviations below). Nodes are the first 8 bytes of a set's MD5.

Defined results: an empty or NULL text is the empty set, equal to itself only; texts of
fewer than five words are one shingle; a NULL id counts as the hash of its text and is
never a class id unless all ids of the class are NULL; repeated rows are copies of each
other; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlake.llm.common import named_again, numbered
from forumlake.llm.components import components
from forumlake.llm.words import each_text, mix, shingles
from forumlake.operators.joins import BROADCAST_ROWS, SALTS, count_up_to, join_small
from forumlake.session import stage

SHINGLE, SIMILARITY = 5, 0.8
POSITIONS, RUNS, DEPTH, SMALL, BLOCK = 64, 16, 3, 1024, 8192
SKETCH_PASS = 0.6
VERIFY = 512  # nodes of a block of whole sets
HEAVY = 512  # rows of a key beyond which they are not brought into one task
_SEEDS = mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_A, _B = _SEEDS[:POSITIONS] | np.uint64(1), _SEEDS[POSITIONS:]


def uid(id_col: str, text: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(F.col(text)))


def node_of(shingle_set: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(shingle_set.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True)


def min_hashes(shingle_set: np.ndarray) -> np.ndarray:
    """``POSITIONS`` 32-bit minima."""
    best = np.full(POSITIONS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingle_set), 512):
        part = shingle_set[i : i + 512]
        np.minimum(best, ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=best)
    return best.astype(np.uint32)


def sketched(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(uid, doc_id, node, n_shingles, sketch, firsts): 16-bit values of all positions, 32-bit ones of the first ``RUNS``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, sketches, firsts = [], [], [], []
            for words in each_text(batch.column(2)):
                found = shingles(words, SHINGLE)
                low = min_hashes(found)
                nodes.append(node_of(found))
                sizes.append(len(found))
                sketches.append(low.astype("<u2").tobytes())
                firsts.append(low[:RUNS].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(firsts, pa.binary())],
                names=["uid", "doc_id", "node", "n_shingles", "sketch", "firsts"],
            )

    rows = docs.select(uid(id_col, text).alias("uid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, "uid bigint, doc_id bigint, node bigint, n_shingles bigint, sketch binary, firsts binary")


def first_paths(nodes: DataFrame) -> DataFrame:
    """(path, node) of every run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = mix(np.arange(1, RUNS + 1, dtype=np.uint64))
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, RUNS).astype(np.uint64)
            paths = mix(values + runs[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(paths.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), RUNS))], names=["path", "node"])

    return nodes.select("node", "firsts").mapInArrow(each, "path bigint, node bigint")


def next_paths(members: DataFrame) -> DataFrame:
    """Children of (path, node, sketch): the positions are drawn for the path, so all its nodes split alike."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = mix(np.arange(101, 101 + POSITIONS, dtype=np.uint64))
        chance = np.uint64(int(2**64 / (SIMILARITY * POSITIONS)))
        for batch in batches:
            path = batch.column(0).to_numpy().view(np.uint64)
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, POSITIONS).astype(np.uint64)
            drawn = mix(path[:, None] ^ places[None, :])
            row, at = np.nonzero(drawn < chance)
            children = mix(drawn[row, at] + values[row, at] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(children), pa.array(batch.column(1).to_numpy()[row])], names=["path", "node"])

    return members.select("path", "node", "sketch").mapInArrow(each, "path bigint, node bigint")


def leaves(nodes: DataFrame) -> list[DataFrame]:
    """Tables (path, node, n) of the buckets to search, level by level."""
    found, members = [], first_paths(nodes)
    for depth in range(1, DEPTH + 1):
        members = stage(members, f"paths-{depth}")
        sizes = stage(members.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"buckets-{depth}")
        placed = members.join(sizes, "path")
        if depth == DEPTH or sizes.where(F.col("n") > SMALL).isEmpty():
            return [*found, placed]
        found.append(placed.where(F.col("n") <= SMALL))
        members = next_paths(placed.where(F.col("n") > SMALL).join(nodes.select("node", "sketch"), "node"))
    return found


def forest(sketches: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever pairs at or above ``SKETCH_PASS`` connect (only pairs across sides, if given)."""
    least, left, links = int(np.ceil(SKETCH_PASS * POSITIONS)), np.arange(len(sketches)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (sketches[left] == sketches[at]).sum(axis=1) >= least
            if side is not None:
                near &= side[left] != side[at]
            links += [(int(at), int(x)) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return links


def bucket_links(members: DataFrame) -> DataFrame:
    """Candidate links (a, b) of the buckets in (path, node, n, sketch)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    rows = members.withColumn("blocks", blocks).withColumn("mine", mine)
    rows = rows.select("path", "node", "sketch", "mine", F.explode(others).alias("pair")).select("path", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "mine", "node", "sketch")
    ordered = rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(table: pa.Table) -> pa.RecordBatch:
            keys = np.stack([table.column(k).to_numpy() for k in ("path", "i", "j")], axis=1)
            node, mine = table.column("node").to_numpy(), table.column("mine").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(-1, POSITIONS)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(keys))
            a, b = [], []
            for size in range(2, 6):  # all pairs of the many tiny buckets at once
                at = starts[ends - starts == size]
                for x in range(size):
                    for y in range(x + 1, size):
                        near = (sketch[at + x] == sketch[at + y]).sum(axis=1) >= SKETCH_PASS * POSITIONS
                        a.append(node[at[near] + x])
                        b.append(node[at[near] + y])
            for s, e in zip(starts[ends - starts >= 6].tolist(), ends[ends - starts >= 6].tolist()):
                across = mine[s:e] if keys[s, 1] != keys[s, 2] else None
                links = np.asarray(forest(sketch[s:e], across), np.int64).reshape(-1, 2)
                a.append(node[s + links[:, 0]])
                b.append(node[s + links[:, 1]])
            pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            # The last bucket may go on in the next batch.
            last = [held.column(k)[-1].as_py() for k in ("path", "i", "j")]
            same = np.ones(held.num_rows, bool)
            for k, v in zip(("path", "i", "j"), last):
                same &= held.column(k).to_numpy() == v
            whole = int(np.argmax(same))
            if whole:
                yield search(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield search(held)

    return ordered.mapInArrow(each, "a bigint, b bigint")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of blocks of the incidence matrices."""
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    used = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(used) - 1
    keep = used[place]
    place, row = number[place[keep]], row[keep]
    out, step = np.zeros((len(left), len(right)), np.float32), 4096
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for start in range(0, int(used.sum()), step):
        lo, hi = np.searchsorted(place, [start, start + step])
        grid = np.zeros((len(left) + len(right), step), np.float32)
        grid[row[lo:hi], place[lo:hi] - start] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a pair of blocks: (node, texts, documents, other), ``other`` a true link of the node or NULL."""
    rows = rows.drop_duplicates(["node", "mine"]).sort_values("node", kind="stable").reset_index(drop=True)
    i, j = int(rows["i"].iat[0]), int(rows["j"].iat[0])
    left, right = rows[rows["mine"] == i], rows[rows["mine"] == j]
    made = []
    if len(left) and len(right):
        a, b = ([np.frombuffer(x, "<u8") for x in side["shingles"]] for side in (left, right))
        common = common_counts(a, b)
        union = np.asarray([len(x) for x in a], np.float32)[:, None] + np.asarray([len(x) for x in b], np.float32)[None, :] - common
        linked = common >= SIMILARITY * union - 1e-6
        left_nodes, right_nodes = left["node"].to_numpy(), right["node"].to_numpy()
        if i == j:
            np.fill_diagonal(linked, False)
        sides = [(left_nodes, right_nodes, right["size"].to_numpy(), linked)]
        if i != j:
            sides.append((right_nodes, left_nodes, left["size"].to_numpy(), linked.T))
        for own, other, sizes, near in sides:
            texts, docs = near.sum(axis=1), near @ sizes
            # A forest is enough for the classes: each node's link to the first node that it is linked to,
            first = near.argmax(axis=1)
            for k in np.flatnonzero(texts):
                made.append((own[k], int(texts[k]), int(docs[k]), other[first[k]]))
        # and the links that connect what those leave apart.
        made += [(x, 0, 0, y) for x, y in joins(left_nodes, right_nodes, linked)]
    return pd.DataFrame(made, columns=["node", "texts", "documents", "other"]).astype("int64")


def joins(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks."""
    open_, out = np.ones(len(right), bool), []
    unseen = np.ones(len(left), bool)
    for start in range(len(left)):
        if not unseen[start]:
            continue
        queue = [start]
        unseen[start] = False
        while queue:
            at = queue.pop()
            near = np.flatnonzero(linked[at] & open_)
            open_[near] = False
            out += [(left[at], right[k]) for k in near]
            for k in near:
                back = np.flatnonzero(linked[:, k] & unseen)
                unseen[back] = False
                out += [(left[x], right[k]) for x in back]
                queue += back.tolist()
    return out


def looked_up(rows: DataFrame, found: DataFrame, key: str, salt_by: str) -> DataFrame:
    """Inner join of ``rows`` to a table with one row for each ``key``, whose ``n`` says how many rows the key has.

    Rows of heavy keys meet theirs by a broadcast of a checked size, or salted beyond it; only the others are
    brought together by key, ``HEAVY`` at most.
    """
    heavy = found.where(F.col("n") > HEAVY)
    many = count_up_to(heavy, BROADCAST_ROWS)
    if not many:
        return rows.join(found, key)
    hot = join_small(rows, heavy, [key], salt_by, BROADCAST_ROWS, many)
    if many <= BROADCAST_ROWS:
        others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    else:
        copies = heavy.select(key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
        others = salted.join(copies, [key, "salt"], "left_anti").drop("salt")
    return hot.unionByName(others.join(found.where(F.col("n") <= HEAVY), key))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``class_id`` (the least id of its class), ``class_size``, ``n_links`` (other documents
    at the similarity or above, copies counted), ``n_texts`` (other shingle sets among them), ``n_shingles``."""
    rows = stage(sketched(docs, id_col, text), "sketches")
    nodes = rows.groupBy("node", "n_shingles", "sketch", "firsts").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"), F.count("*").alias("size"))
    nodes = stage(nodes, "nodes")
    found = leaves(nodes)
    links = [bucket_links(x.join(nodes.select("node", "sketch"), "node")) for x in found]
    candidates = links[0]
    for more in links[1:]:
        candidates = candidates.unionByName(more)
    near = stage(components(candidates), "candidates")

    # The candidates' whole sets, block against block.
    groups = stage(near.groupBy("root").agg(F.count("*").alias("n")), "candidate-groups")
    wanted = looked_up(near, groups, "root", "node").join(nodes.select("node", "uid", "size"), "node").withColumnRenamed("uid", "w_uid")
    texts = docs.select(uid(id_col, text).alias("uid"), F.col(text).alias("text"))
    fetched = texts.join(wanted, F.col("uid") == F.col("w_uid")).select("root", "n", "node", "size", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(words, SHINGLE) for words in each_text(batch.column(4))]
            own = pa.array([node_of(s) for s in found], pa.int64()).to_numpy() == batch.column(2).to_numpy()
            whole = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["root", "n", "node", "size", "shingles"])
            yield whole.filter(pa.array(own))

    held = fetched.mapInArrow(sets, "root bigint, n bigint, node bigint, size bigint, shingles binary")
    blocks = F.ceil(F.col("n") / VERIFY).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    dealt = held.withColumn("blocks", blocks).withColumn("mine", mine).select("root", "node", "size", "shingles", "mine", F.explode(others).alias("pair"))
    dealt = dealt.select("root", "pair.i", "pair.j", "mine", "node", "size", "shingles")
    proven = stage(dealt.groupBy("root", "i", "j").applyInPandas(verify, "node bigint, texts bigint, documents bigint, other bigint"), "proven")

    roots = components(proven.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = proven.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    placed = nodes.select("node", "least", "size").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stage(placed, "placed")
    classes = placed.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("size").alias("class_size"), F.count("*").alias("n"))
    known = looked_up(placed, stage(classes, "classes"), "root", "node").select(
        "node", "class_id", "class_size", (F.coalesce("documents", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_texts"), F.col("size").alias("n")
    )
    known = stage(known, "node-classes")
    found = looked_up(rows.select("doc_id", "node", "n_shingles"), known, "node", "doc_id")
    return found.select("doc_id", "class_id", "class_size", "n_links", "n_texts", "n_shingles")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one with the least id (NULL last), columns as they were.

    Of rows that repeat that id and text, the first by their other columns stays.
    """
    rows, names = numbered(docs)
    own, body = names[id_col], names[text]
    marked = rows.withColumn("row", F.xxhash64(F.col(own).cast("bigint"), F.col(body)))
    classes = near_groups(marked.select("row", body), "row", body).select(F.col("doc_id").alias("row"), "class_id").distinct()
    ids = marked.select("row", F.col(own).alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), F.col("id"), F.col("row")))
    kept = classes.join(ids, "row").groupBy("class_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    # Texts are told apart by themselves, so that no row falls to another one's hash.
    others = [F.col(c).cast("string") for c in names.values() if c not in (own, body)]
    nth = Window.partitionBy("row", own, body).orderBy(*others, "row")
    found = marked.join(kept, "row", "left_semi").withColumn("nth", F.row_number().over(nth)).where("nth = 1")
    return named_again(found, names)
