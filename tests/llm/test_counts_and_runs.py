"""Token counts, periodic runs and whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from forumlake.llm import periodic_runs, token_counts
from forumlake.llm.queries import QUERIES
from tests.llm.fixtures import ROWS, documents, empty, prose

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (20, "Don't <|endoftext|>x <|ENDOFTEXT|> a<|startoftext|><|endoftext|> İstanbul ''s 12a ¹½", "en", "a", 1),
    (21, " ́x é Å ẛ̣ ΑΣ  nb sp\x0bvt\x1cfs\x85 \U0001f600‍\U0001f600!!'s", "en", "a", 1),
    (22, "x" * 5000 + "ü" * 3000 + "!" * 3000, "en", "a", 1),
    (23, "\n\t  \r\n", "en", "a", 1),
]


def wanted_counts(rows) -> Counter:
    tokenizer = Tokenizer.from_file(WORD_BPE)
    out = Counter()
    for doc_id, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        out[(doc_id, len((text or "").encode()), n, n > 2048)] += 1
    return out


@pytest.mark.parametrize("local", [token_counts.LOCAL, 50, 0])
def test_token_counts(spark, local):
    got = token_counts.token_counts(documents(spark, ROWS + ODD), WORD_BPE, local=local).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == wanted_counts(ROWS + ODD)
    assert token_counts.token_counts(empty(spark), WORD_BPE, local=local).count() == 0


def test_token_counts_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == wanted_counts(rows)


def test_plain_chunks_are_read_as_the_tokenizer_does():
    with open(WORD_BPE, encoding="utf-8") as f:
        reader = token_counts.Reader(f.read())
    assert reader.by_pattern
    letters = [c for c in map(chr, range(0x180)) if token_counts._PLAIN.fullmatch(c)]
    rng = random.Random(4)
    for _ in range(3000):
        chunk = "".join(rng.choices(letters, k=rng.randrange(1, 9))) + "".join(rng.choices(".,;:!?*#$%&|", k=rng.randrange(3)))
        assert reader.plain(chunk) == reader.read(chunk)
    assert reader.plain("don't") is None and reader.plain("<|endoftext|>") is None and reader.plain("a1") is None and reader.plain("") is None


def test_no_more_than_so_many_pretokens_go_to_every_task(spark):
    rows = spark.createDataFrame([(f"w{k}", k // 7 + 1, 1) for k in range(1000)], "pretoken string, n bigint, pieces bigint")
    found, everything = token_counts.frequent(rows, 300)
    assert 0 < len(found) <= 300 and not everything
    assert min(int(w[1:]) for w in found) > 600
    assert token_counts.frequent(rows, 1000) == ({f"w{k}": 1 for k in range(1000)}, True)


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every period and place."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:  # a smaller period of this stretch came first
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def wanted_runs(doc_id, text: str | None, seeded: bool = True) -> tuple:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if seeded and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words: list[int] = []
        for _ in range(rng.randrange(6)):
            unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
            words += unit * rng.randrange(1, 12) + unit[: rng.randrange(len(unit))]
        texts.append(words)
    flat, sizes = np.asarray([w for t in texts for w in t], np.int64), np.asarray([len(t) for t in texts], np.int64)
    runs = [tuple(r) for r in periodic_runs.periodic_runs(flat, sizes).tolist()]
    begin, want = 0, []
    for t in texts:
        want += [(begin + s, n, q) for s, n, q in brute_runs(t)]
        begin += len(t)
    assert runs == want


def run_rows():
    loop = " ".join(["a b c"] * 40)
    picked = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    more = [(i, prose(i, 40 + 7 * (i % 60)), "en", "a", 1) for i in picked]
    return ROWS + more + [
        (500, loop, "en", "a", 1),
        (501, f"x {loop} y\n{loop} " + "z " * 30, "en", "a", 1),
        (502, "q " * 5, "en", "a", 1),
        (502, "q " * 6, "en", "a", 1),
        (503, "q " * 40_000, "en", "a", 1),
        (504, "\x1c \x1c " * 20 + "é   " * 20, "en", "a", 1),
    ]


def test_periodic_runs(spark):
    rows = run_rows()
    got = periodic_runs.digests(periodic_runs.collapse_runs(documents(spark, rows), seeded=True)).collect()
    small = [r for r in rows if len(r[1] or "") < 50_000]
    key = lambda r: (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
    long = {9, 503}
    assert Counter(key(r) for r in got if r.doc_id not in long) == Counter(wanted_runs(r[0], r[1]) for r in small if r[0] not in long)
    whole = next(r for r in got if r.doc_id == 503)
    if zlib.crc32(b"503") % 10:
        assert (whole.n_runs, whole.start, whole.length, whole.period) == (1, 0, 40_000, 1)
        assert whole.collapsed_sha256 == hashlib.sha256(b"q").hexdigest()
    assert periodic_runs.collapse_runs(empty(spark)).count() == 0


def test_text_is_collapsed_to_one_period(spark):
    rows = [(1, "x " + "a b c " * 5 + "y", "en", "a", 1), (2, None, "en", "a", 1)]
    got = {r.doc_id: r for r in periodic_runs.collapse_runs(documents(spark, rows)).collect()}
    assert got[1].collapsed_text == "x a b c y" and [tuple(r) for r in got[1].runs] == [(1, 15, 3)]
    assert (got[2].n_words, got[2].runs, got[2].collapsed_text) == (0, [], "")


def test_periodic_runs_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_periodic_runs"](spark, sf_dir).collect()
    short = {i for i, t in rows if len(t or "") < 12_000}
    want = Counter(wanted_runs(i, t) for i, t in rows if i in short)
    assert len(got) == len(rows)
    assert Counter(tuple(r) for r in got if r.doc_id in short) == want
