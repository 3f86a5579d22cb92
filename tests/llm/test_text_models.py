"""Fingerprints, language model, quality classifier and license scans."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from forumlake.llm import brown, imatch, licenses, quality
from forumlake.llm.queries import QUERIES
from tests.llm.fixtures import PASSAGE, ROWS, documents, empty, prose


def key(i):
    return float("-inf") if i is None else i


def test_fingerprints(spark):
    got = imatch.fingerprints(documents(spark)).collect()
    rows = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda r: (-key(r[0]), r[1]))
    want = Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        want[(i, len(text), hashlib.sha256((text[: len(text) - len(text) // 3] + after[: len(text) // 3]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_id = {r.doc_id: r.fingerprint for r in got}
    assert by_id[1] == by_id[2] == by_id[3] and by_id[6] == by_id[7] == "0"
    assert len({by_id[i] for i in (1, 9, 10, 11, -5)}) == 5


def test_fingerprints_of_one_row_and_of_none(spark):
    text = "one two three four five six"
    one = imatch.fingerprints(documents(spark, [(5, text, "en", "a", 1)])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(imatch.edited(text, text).encode()).hexdigest()
    assert imatch.fingerprints(empty(spark)).count() == 0


@pytest.mark.parametrize("blocks", [3, 1 << 16])
def test_blocks_meet(spark, monkeypatch, blocks):
    monkeypatch.setattr(imatch, "BLOCK", 4)
    monkeypatch.setattr(imatch, "BLOCKS", blocks)
    rows = [(i * 7 % 101, prose(i, 20), "en", "a", 1) for i in range(101)]
    got = {r.doc_id: r.edited_sha256 for r in imatch.fingerprints(documents(spark, rows)).collect()}
    texts = {i: t for i, t, *_ in rows}
    ids = sorted(texts, reverse=True)
    want = {i: hashlib.sha256(imatch.edited(texts[i], texts[j]).encode()).hexdigest() for i, j in zip(ids, ids[1:] + ids[:1])}
    assert got == want


def test_lexicon_is_bounded_and_in_its_band(spark, monkeypatch, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = Counter(w for r in docs.collect() for w in set(r.text.encode().lower().split()))
    n, floor = docs.count(), max(imatch.RARE * docs.count(), sum(df.values()) / imatch.LEXICON)
    band = [w for w, k in df.items() if floor <= k <= max(imatch.COMMON * n, 1)]
    assert len(imatch.lexicon(docs)) == len(band)
    monkeypatch.setattr(imatch, "LEXICON", 500)
    assert len(imatch.lexicon(docs)) <= 500


def test_edited_texts_are_nearer_than_the_next(spark, sf_dir):
    got = imatch.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    long = [r for r in got if r.n_terms >= 20]
    assert np.mean([r.near_edited for r in long]) > 0.3 and np.mean([r.near_next for r in long]) < 0.02
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def out_of_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def base(rows):
    counts = Counter(w for i, t, *_ in rows if not out_of_training(i) for w in tokens(t))
    return counts, sum(counts.values()), len(counts)


def test_language_model(spark):
    got = brown.lm_scores(documents(spark)).collect()
    counts, n, v = base(ROWS)
    want = []
    for i, t, *_ in ROWS:
        w = tokens(t)
        want.append((str(i), out_of_training(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert brown.lm_scores(empty(spark)).count() == 0


@pytest.mark.parametrize("local", [50, 1 << 17])
def test_ends_of_few_long_texts_are_known(spark, monkeypatch, local):
    """The end is rarer there than the words that go to every task, or as rare as all of them."""
    monkeypatch.setattr(brown, "LOCAL", local)
    rows = [(i, " ".join(f"w{k}" for k in range(i * 3, i * 3 + 100))) for i in range(1, 4)]
    counts, n, v = base(rows)
    want = [(i, out_of_training(i), 101, sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 9)) for i, t in rows]
    got = brown.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == want


def test_language_model_beats_the_unigram_out_of_training(spark, sf_dir):
    got = [r for r in QUERIES["op4_brown_lm"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def brute_score(texts, train, cls) -> list[float]:
    """Class bigram scores from the words' classes alone; ``cls`` knows every token of ``texts``."""
    uses, pairs, words = Counter(), Counter(), Counter(w for t in train for w in t)
    for t in train:
        for a, b in zip([b"\n", *t], t):
            pairs[cls(a), cls(b)] += 1
            uses[cls(b)] += 1
    sizes = Counter(cls(w) for w in words)
    k = range(brown.CLASSES)
    share = {c: (uses[c] + 1) / sum(uses[x] + 1 for x in k) for c in k}
    out_of = {c: sum(pairs[c, x] for x in k) for c in k}
    step = {(c, x): math.log10((pairs[c, x] + brown.SMOOTH * share[x]) / (out_of[c] + brown.SMOOTH)) for c in k for x in k}
    for c in k:
        assert sum(10 ** step[c, x] for x in k) == pytest.approx(1)
        emitted = sum((n + 1) / (uses[c] + sizes[c] + 1) for w, n in words.items() if cls(w) == c)
        assert emitted + 1 / (uses[c] + sizes[c] + 1) == pytest.approx(1)  # one unseen word
    return [
        sum(step[cls(a), cls(b)] + math.log10((words[b] + 1) / (uses[cls(b)] + sizes[cls(b)] + 1)) for a, b in zip([b"\n", *t], t)) for t in texts
    ]


@pytest.mark.parametrize("words", [7, 400_000])
def test_contexts_are_summed_in_little_memory(words):
    """By brute force, and beside what was gathered in 80 bytes a word at most."""
    rng = np.random.default_rng(words)
    terms = rng.integers(0, 1 << 62, 1 + words // 4).astype(np.uint64)[rng.integers(0, 1 + words // 4, words)]
    ahead, behind = rng.integers(0, brown.CLASSES, (2, words)).astype(np.uint8)
    behind += np.uint8(brown.CLASSES)
    gathered = [(terms[k::2], ahead[k::2], behind[k::2]) for k in (0, 1)]
    tracemalloc.start()
    got = brown.summed_contexts(gathered, 5)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert not gathered and peak < 80 * words + 1_000_000
    want = Counter([*zip(terms.tolist(), ahead.tolist()), *zip(terms.tolist(), behind.tolist())])
    for row in got.to_pylist():
        known, sizes, cells, n = (np.frombuffer(zlib.decompress(row[k]), kind) for k, kind in (("terms", "<u8"), ("sizes", "<u1"), ("cells", "<u1"), ("n", "<u4")))
        assert set(((known >> np.uint64(40)) % np.uint64(5)).tolist()) == {row["bucket"]}
        for pair, times in zip(zip(np.repeat(known, sizes).tolist(), cells.tolist()), n.tolist(), strict=True):
            assert want.pop(pair) == times
    assert not want


@pytest.mark.parametrize(("local", "share"), [(1 << 17, 2e-5), (60, 2e-3)])
def test_scores_and_classes_by_brute_force(spark, sf_dir, monkeypatch, local, share):
    monkeypatch.setattr(brown, "LOCAL", local)
    monkeypatch.setattr(brown, "CORE_SHARE", share)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    rows = [(r.doc_id, tokens(r.text)) for r in docs.collect()]
    train = [t for i, t in rows if not out_of_training(i)]
    got = brown.lm_scores(docs).collect()
    kept = docs.where(~brown.held_out())
    counts = brown.word_counts(kept)
    vocabulary = brown.vocabulary_of(counts)
    words, ends, gained = brown.word_classes(kept, counts, spark.sparkContext.broadcast(vocabulary))
    known = {r.term: r.cls for r in words.collect()}
    number = lambda w: int(np.uint64(brown.xxhash.xxh3_64_intdigest(w)).view(np.int64))
    of = {w: known.get(number(w), int(ends[brown.suffix(w)]) if w != b"\n" else 0) for _, t in rows for w in t}
    want = brute_score([t for _, t in rows], train, of.__getitem__)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), round(x, 6)) for (i, _), x in zip(rows, want))
    assert all(r.last_gain == gained for r in got) and gained < 0.1

    # Words outside the core went where their own contexts say.
    times, n = Counter(w for t in train for w in t), sum(map(len, train))
    core = {w for w, c in times.items() if w != b"\n" and c >= max(2, math.ceil(n * share))}
    assert {number(w) for w in core} == set(vocabulary.core.terms.view(np.int64).tolist())
    first = lambda w: 0 if w == b"\n" else of[w] if w in core else int(ends[brown.suffix(w)])
    pairs = np.zeros((brown.CLASSES, brown.CLASSES))
    contexts: dict = {}
    for t in train:
        for a, b in zip([b"\n", *t], t):
            pairs[first(a), first(b)] += 1
            contexts.setdefault(b, ([], []))[0].append(first(a))
            if a != b"\n":
                contexts.setdefault(a, ([], []))[1].append(first(b))
    lone = brown.association(pairs)
    for w, (before, after) in contexts.items():
        if w == b"\n" or w in core:
            continue
        if times[w] == 1:
            assert of[w] == ends[brown.suffix(w)]
            continue
        gain = lone[before].sum(axis=0) + lone[:, after].sum(axis=1)
        gain[0] = -np.inf
        assert gain[of[w]] >= gain.max() - 1e-6


def test_one_round_of_moves(spark):
    """Each open type goes to the class with the greatest gain, reckoned type by type."""
    rng = np.random.default_rng(3)
    types = 90
    rows = [np.append(rng.zipf(1.5, 60) % (types - 1) + 1, 0).astype("<u4") for _ in range(30)]
    classes = np.minimum(np.arange(types), brown.CLASSES - 1)
    classes[64:] = rng.integers(1, brown.CLASSES, types - 64)
    before, after = brown.contexts(spark.createDataFrame([(bytearray(r.tobytes()),) for r in rows], "types binary"), classes)
    want = np.zeros((2, types, brown.CLASSES), int)
    for r in rows:
        for a, b in zip([0, *r.tolist()], r.tolist()):
            want[0, b, classes[a]] += 1
            want[1, a, classes[b]] += 1
    assert (before == want[0]).all() and (after == want[1]).all()
    open_ = np.arange(types) % 2 == 0
    now = brown.moved(classes, before, after, open_)
    lone = brown.association(brown.by_class(after, classes))
    for t in range(types):
        gain = [-np.inf] + [sum(before[t, b] * lone[b, c] for b in range(brown.CLASSES)) + sum(after[t, a] * lone[c, a] for a in range(brown.CLASSES)) for c in range(1, brown.CLASSES)]
        if t == 0 or not open_[t] or not before[t].sum():
            assert now[t] == classes[t]
        else:
            assert gain[now[t]] == pytest.approx(max(gain))


def test_quality_against_the_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    gold = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, sf).collect()}
    right = [bool(q) == got[i].accepted for i, q in gold.items()]
    assert np.mean(right) > 0.97
    assert np.mean([got[i].accepted for i, q in gold.items() if q]) > 0.99


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    got = quality.scored(docs, quality.fit_quality(docs))
    own = ["__score", "__posterior", "__votes"]  # replaced
    assert got.columns == [c for c in docs.columns if c not in own] + own and got.count() == docs.count()
    assert quality.accepted(docs).columns == docs.columns
    assert quality.accepted(empty(spark)).count() == 0


def test_label_model_finds_the_accurate_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    patterns = np.zeros((4000, len(quality.LABELLERS)), np.int64)
    for k, accuracy in enumerate((0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65)):
        right = rng.random(4000) < accuracy
        patterns[:, k] = np.where(rng.random(4000) < 0.3, 0, np.where(right == truth, 1, -1))
    found, counts = np.unique(patterns, axis=0, return_counts=True)
    model = quality.fit_labels(found, counts.astype(float))
    assert np.mean((model.posterior(patterns) > 0.5) == truth) > 0.9
    accuracies = list(model.accuracies().values())
    assert accuracies[0] > accuracies[6]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_notice_is_found_whole(name):
    notice = licenses.words_of(licenses.TEMPLATES[name].encode())
    text = licenses.words_of(prose(5, 300).encode()) + notice + licenses.words_of(prose(6, 300).encode())
    places = {}
    for i, w in enumerate(text):
        places.setdefault(w, []).append(i)
    match = licenses.best_match(places, text, notice)
    assert [j for _, j in match] == list(range(len(notice))) and match[0][0] == 300


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit-text"]
    cut = mit.replace("free of charge, ", "at no cost ").replace("without limitation ", "")
    twice = "All rights reserved. " * 3
    rows = [
        (1, prose(1, 40) + "\n" + mit.upper() + "\n" + prose(2, 10), "en", "a", 1),
        (2, cut, "en", "a", 1),
        (3, "the license of the version is licensed under", "en", "a", 1),
        (4, twice, "en", "a", 1),
        (5, None, "en", "a", 1),
        (6, PASSAGE, "en", "a", 1),
        (6, PASSAGE, "en", "a", 1),
        (None, "Released under the MIT License.", "en", "a", 1),
        (8, prose(3, 30_000) + " Licensed under the Apache License, Version 2.0.", "en", "a", 1),
    ]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert (got[1].license, got[1].coverage, got[1].first_word) == ("mit-text", 1.0, 40)
    assert got[2].license == "mit-text" and 0.8 <= got[2].coverage < 1
    assert got[3].license is None and got[5].license is None and got[6].license is None
    assert got[4].license == "all-rights-reserved" and got[None].license == "mit"
    assert (got[8].license, got[8].first_word, got[8].last_word) == ("apache-2.0", 30_000, 30_006)
    assert licenses.scan(documents(spark, rows)).count() == len(rows) and licenses.scan(empty(spark)).count() == 0


def test_rare_words_elsewhere_hide_no_license(spark):
    """The notice has lost its first words, and those stand alone in other places of the text."""
    notice = licenses.TEMPLATES["mit-text"].split()
    body = " ".join(["We", "let", *notice[8:]])
    parts = ["permission", prose(1, 300), "hereby", prose(2, 300), "granted", prose(3, 300), body, prose(4, 300)]
    rows = [(1, " ".join(parts), "en", "a", 1), (2, " ".join(parts[::-1]), "en", "a", 1)]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, before in ((1, 905), (2, 302)):
        assert got[i].license == "mit-text" and got[i].matched_words == len(notice) - 8
        assert (got[i].first_word, got[i].last_word) == (before, before + len(notice) - 9)


def test_any_words_may_be_missing():
    """Every notice of which enough is left in one place is found, whichever words stray."""
    rng = np.random.default_rng(6)
    for name, body in licenses.TEMPLATES.items():
        notice = licenses.words_of(body.encode())
        may_miss = len(notice) - int(np.ceil(licenses.LEAST * len(notice)))
        for _ in range(20):
            gone = set(rng.choice(len(notice), may_miss, replace=False).tolist())
            strays = [w for k in gone for w in (notice[k], *licenses.words_of(prose(k, 60).encode()))]
            text = strays + [b"x" if k in gone else w for k, w in enumerate(notice)] + licenses.words_of(prose(7, 200).encode())
            places = {}
            for i, w in enumerate(text):
                places.setdefault(w, []).append(i)
            assert len(licenses.best_match(places, text, notice)) >= licenses.LEAST * len(notice), (name, gone)


def test_increasing():
    rng = np.random.default_rng(2)
    for _ in range(5):
        places = rng.permutation(12).tolist()
        chain = licenses.increasing(places)
        assert [places[i] for i in chain] == sorted(places[i] for i in chain)
        best = max(bin(m).count("1") for m in range(1 << 12) if (s := [places[i] for i in range(12) if m >> i & 1]) == sorted(s))
        assert len(chain) == best


def test_words_split_as_the_contract_says():
    text = "a\tb\x0bc\x0cd\re\x1cf\x85g\xa0h i"
    assert [w.decode() for w in text.encode().split()] == [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
