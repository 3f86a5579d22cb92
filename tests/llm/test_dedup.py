"""Exact copies, near copies and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh3_64_intdigest

from forumlake.llm import chosen_path, exact_dedup, substrings
from forumlake.llm.components import components
from forumlake.llm.fm_index import FMIndex
from forumlake.llm.words import coded_words, each_text
from tests.llm.fixtures import PASSAGE, ROWS, documents, empty, prose


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_copies(spark, keep):
    groups = defaultdict(list)
    for row in ROWS:
        groups[ascii_lower(row[1])].append(row[0])
    pick = min if keep == "smallest" else max
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        kept = None if not known or keep == "smallest" and None in ids else pick(known)
        left = 1
        for i in ids:
            want.append((str(i), str(kept), len(ids), i == kept and left == 1, hashlib.sha256(text.encode()).hexdigest()))
            left -= i == kept
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_copies(documents(spark), keep=keep).collect()]
    assert sorted(got) == sorted(want)


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    class Same:
        def __init__(self, body, **_):
            self.body = body

        def digest(self):
            return bytes([len(self.body) % 2]) * 16

    monkeypatch.setattr(exact_dedup, "hashlib", type("h", (), {"md5": Same}))
    rows = [(1, "aa"), (2, "bb"), (3, "AA"), (4, "a"), (5, "cc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_copies(df).collect()}
    # Workers import the module anew, so the stand-in may not reach them; groups must be right either way.
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}


def test_drop_exact_copies_keeps_columns(spark):
    docs = documents(spark)
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert len({ascii_lower(r.text) for r in got.collect()}) == got.count() == len({ascii_lower(r[1]) for r in ROWS})
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0
    assert exact_dedup.exact_copies(empty(spark)).count() == 0


def shingle_set(text: str | None) -> frozenset:
    w = words(ascii_lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(a: frozenset, b: frozenset) -> bool:
    return a == b or bool(a | b) and len(a & b) >= 0.8 * len(a | b)


def brute_classes(rows) -> tuple[list[int], list[int]]:
    sets = [shingle_set(r[1]) for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))], links


def test_words_of_any_slice():
    texts = [None, "", *(f"Word{k} AND  Wörd{k % 7}\tÄ{k}" * (k % 5) for k in range(2500))]
    want = [[xxh3_64_intdigest(w.encode()) for w in words(ascii_lower(text))] for text in texts]
    column = pa.array(texts)
    for lo in (0, 1, 1000, 2100):
        assert [h.tolist() for h in each_text(column.slice(lo))] == want[lo:]
        listed, which, sizes = coded_words(column.slice(lo, 300), lower=True)
        assert [listed[k].decode() for k in which] == [w for text in texts[lo : lo + 300] for w in words(ascii_lower(text))]
        assert sizes.tolist() == [len(found) for found in want[lo : lo + 300]]


def test_copies_far_into_a_batch_are_linked(spark):
    rows = [(k, prose(k // 2, 40), "en", "a", 0) for k in range(5000)]
    found = chosen_path.near_groups(documents(spark, rows).coalesce(1)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in found} == {(k, k - k % 2, 1) for k in range(5000)}


def test_near_groups(spark):
    rows = list(ROWS)
    base = words(ROWS[0][1])
    for k in range(40):  # variants of one text, each near all others
        rows.append((100 + k, " ".join(base[: 3 * k] + ["changed"] + base[3 * k + 1 :]), "en", "a", 1))
    tops, links = brute_classes(rows)
    members = defaultdict(list)
    for t, r in zip(tops, rows):
        members[t].append(r[0])
    want = Counter()
    for t, n, r in zip(tops, links, rows):
        ids = [i for i in members[t] if i is not None]
        want[(r[0], min(ids) if ids else None, len(members[t]), n)] += 1
    got = chosen_path.near_groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in got) == want


def test_near_groups_of_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    tops, links = brute_classes(rows)
    least = {}
    for t, r in zip(tops, rows):
        least[t] = min(least.get(t, r[0]), r[0])
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == {r[0]: (least[t], n) for t, n, r in zip(tops, links, rows)}


def test_one_of_each(spark):
    docs = documents(spark)
    got = chosen_path.one_of_each(docs)
    assert got.columns == docs.columns
    tops, _ = brute_classes(ROWS)
    assert got.count() == len(set(tops))
    assert chosen_path.one_of_each(empty(spark)).count() == 0
    assert chosen_path.near_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_large_buckets_and_blocks(spark, monkeypatch, broadcast):
    """The paths of deeper levels, several blocks of a bucket and of a group, heavy groups and many copies of one text."""
    for name, value in (("SMALL", 8), ("BLOCK", 16), ("VERIFY", 16), ("HEAVY", 16), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(chosen_path, name, value)
    base = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :]), "en", "a", 1) for k in range(60)]
    rows += [(60 + k, rows[3][1], "en", "a", 1) for k in range(20)] + [(80 + k, f"alone {k} of five words", "en", "a", 1) for k in range(5)]
    got = chosen_path.near_groups(documents(spark, rows)).collect()
    assert Counter((r.class_id, r.class_size) for r in got) == Counter({(0, 80): 80} | {(80 + k, 1): 1 for k in range(5)})
    _, links = brute_classes(rows)
    assert {r.doc_id: r.n_links for r in got} == dict(enumerate(links))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 2000 + i) for i in range(50)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in list(up)}


def test_fm_index():
    rng = np.random.default_rng(1)
    passages = [(rng.integers(0, 4, rng.integers(1, 60)) * 7).astype(np.uint32) for _ in range(20)]
    text = (rng.integers(0, 5, 300) * 7).astype(np.uint32)
    found, low, high = FMIndex(passages, 13).matching(text, np.arange(300), 13)
    held = Counter(tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, min(len(p), i + 13) + 1))
    for e in range(300):
        size = max([k for k in range(1, min(13, e + 1) + 1) if tuple(text[e - k + 1 : e + 1]) in held], default=0)
        assert found[e] == size
        assert not size or high[e] - low[e] == held[tuple(text[e - size + 1 : e + 1])]


def brute_removed(rows) -> Counter:
    least: dict = {}
    order = lambda i: float("inf") if i is None else i
    for i, text, *_ in rows:
        w = words(text)
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            least[key] = min(least.get(key, float("inf")), order(i))
    out = Counter()
    for i, text, *_ in rows:
        w = words(text)
        gone = {p for s in range(len(w) - 12) if least[tuple(w[s : s + 13])] < order(i) for p in range(s, s + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size", [1 << 23, 4000])
def test_remove_repeats(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "SHARD", size)  # one shard, and many
    got = substrings.remove_repeats(documents(spark)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(ROWS)


def brute_spans(rows, size) -> list[tuple]:
    """(id, kept text, spans): runs of windows with one least id, smaller than the document's."""
    least: dict = {}
    order = lambda i: float("inf") if i is None else i
    for i, text, *_ in rows:
        w = words(text)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            least[key] = min(least.get(key, float("inf")), order(i))
    out = []
    for i, text, *_ in rows:
        w, spans = words(text), []
        for s in range(len(w) - size + 1):
            first = least[tuple(w[s : s + size])]
            if first < order(i):
                if spans and spans[-1][2] == first and spans[-1][1] == s + size - 1:
                    spans[-1] = (spans[-1][0], s + size, first)
                else:
                    spans.append((s, s + size, first))
        gone = {p for a, b, _ in spans for p in range(a, b)}
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone), tuple(spans)))
    return out


@pytest.mark.parametrize(("size", "window"), [(1 << 23, 13), (4000, 13), (4000, 40), (1 << 23, 4)])
def test_kept_text_and_removed_spans(spark, monkeypatch, size, window):
    monkeypatch.setattr(substrings, "SHARD", size)
    # A passage whose halves have different first documents.
    halves = [(0, PASSAGE[200:] + " " + prose(31, 50), "en", "a", 1), (3, prose(32, 30) + " " + PASSAGE, "en", "a", 1)]
    rows = [*ROWS, *halves]
    got = substrings.remove_repeats(documents(spark, rows), window=window).collect()
    assert Counter((r.doc_id, r.kept_text, tuple(tuple(s) for s in r.spans)) for r in got) == Counter((i, t, s) for i, t, s in brute_spans(rows, window))
    if window == 13:
        assert [s.least_id for r in got if r.doc_id == 10 for s in r.spans] == [3, 0]


def test_remove_repeats_of_nothing(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0


def removed_by_hand(rows, shards: int, rng) -> list[dict]:
    """All steps of substring dedup, the rows of every step in another order."""
    import pyarrow as pa

    def any_order(table: pa.Table) -> pa.Table:
        return table.take(pa.array(rng.permutation(table.num_rows)))

    def regrouped(tables: list[pa.Table], key: str) -> dict[int, pa.Table]:
        whole = pa.concat_tables(tables)
        keys = whole.column(key).to_numpy()
        return {int(k): any_order(whole.filter(pa.array(keys == k))) for k in np.unique(keys)}

    order = [int(substrings.SMALLEST) if r[0] is None else r[0] for r in rows]
    held = {}
    for k in range(shards):
        at = [i for i, r in enumerate(rows) if hash((r[0], r[1])) % shards == k]
        columns = ([k] * len(at), [rows[i][0] for i in at], [order[i] for i in at], [rows[i][1] for i in at])
        if at:
            held[k] = pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "doc_id", "order", "text"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))})
    none = {"shard": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary()), "owners": pa.array([], pa.binary())}
    window, known = substrings.WINDOW, {k: pa.table(none) for k in held}
    for step in range(2):
        sent = []
        for k, table in held.items():
            shard = substrings.Shard(any_order(table), window)
            hashes, on = shard.anchors(), np.ones(len(shard.start), bool)
            if step:
                on = np.isin(hashes, substrings.joined(known[k], "hashes", "<u8"))
                hashes = shard.window_hashes()
            sent.append(substrings.to_buckets(k, hashes[on], shard.order[on], 3))
        answered = regrouped([substrings.answers(t) for t in regrouped(sent, "bucket").values()], "shard")
        known = {k: answered.get(k, pa.table(none)) for k in held}
    asked = regrouped([substrings.passages(k, substrings.Shard(any_order(t), window), known[k]) for k, t in held.items()], "shard")
    found = regrouped([substrings.search(t, window) for t in asked.values()], "shard")
    empty_found = substrings.passage_rows([])
    return [r for k, t in held.items() for r in substrings.removed(any_order(t), found.get(k, empty_found), window).to_pylist()]


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_remove_repeats_in_any_order_of_rows(spark, sf_dir, shards):
    rows = ROWS + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_removed(rows)
    for seed in range(3):
        got = removed_by_hand(rows, shards, np.random.default_rng(seed))
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got) == want


def test_of_rows_that_repeat_an_id_and_a_text_the_first_by_its_other_columns_stays(spark):
    rows = [(1, prose(90, 40), "en", s, 1) for s in "cab"] + [(2, prose(91, 40), "en", "z", 1)]
    for keep in (exact_dedup.drop_exact_copies, chosen_path.one_of_each):
        got = keep(documents(spark, rows))
        assert got.columns == documents(spark, rows).columns
        assert sorted((r.doc_id, r.source, r["__digest"], r["__nth"], r.c0) for r in got.collect()) == [(1, "a", "x", "x", "x"), (2, "z", "x", "x", "x")]
