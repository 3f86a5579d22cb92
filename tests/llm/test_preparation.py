"""Mixing, chat windows, packing and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from forumlake.llm import chat_windows, mixing, packing
from forumlake.llm.queries import QUERIES, SQL
from tests.compare import compare, connect
from tests.llm.fixtures import ROWS, documents, empty

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, window string, span int, start int"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], SQL[name], sf_dir) is None


# Mixing.


def test_marginals_meet_their_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", f"s{min(i % 9, 4)}", 1) for i in range(900)]
    shares = {"source": {f"s{k}": 0.2 for k in range(5)}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mixed(mixing.with_margins(documents(spark, rows), F.lit("t")), shares, rate=0.3).collect()
    total = sum(r.tokens for r in got)
    for name, wish in shares.items():
        for value, share in wish.items():
            assert sum(r.tokens * r.weight for r in got if r[name] == value) == pytest.approx(share * total, rel=0.002)
    assert all(r.expected == pytest.approx(0.3 * r.weight) and r.copies in (int(r.expected), int(r.expected) + 1) for r in got)
    assert abs(sum(r.copies for r in got) - sum(r.expected for r in got)) < 4 * np.sqrt(len(got) / 4)


def brute_weights(rows, temper, least):
    """{cell: weight} by raking in plain Python until the margins hold to twelve digits; cells of tokens by (source, lang, topic)."""
    weights, total = dict.fromkeys(rows, 1.0), sum(rows.values())
    goals = []
    for m, power in enumerate(temper):
        seen = Counter()
        for cell, n in rows.items():
            seen[cell[m]] += n
        alone = {v for v, n in seen.items() if n < least * total}
        wishes = sum(n**power for v, n in seen.items() if v not in alone)
        left = total - sum(seen[v] for v in alone)
        goals.append({v: n if v in alone else n**power / wishes * left for v, n in seen.items()})
    for _ in range(400):
        for m, goal in enumerate(goals):
            now = Counter()
            for cell, n in rows.items():
                now[cell[m]] += n * weights[cell]
            weights = {c: w * goal[c[m]] / now[c[m]] if rows[c] else w for c, w in weights.items()}
    return weights, goals


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_weights_and_drawn_shares_of_the_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = mixing.mixed(mixing.with_margins(docs)).collect()
    cells = Counter()
    for r in got:
        cells[r.source, r.lang, r.topic] += r.tokens
    weights, goals = brute_weights(cells, list(mixing.TEMPER.values()), mixing.LEAST_SHARE)
    for r in got:
        assert r.weight == pytest.approx(weights[r.source, r.lang, r.topic], rel=0.02)
    total = sum(cells.values())
    for m, goal in enumerate(goals):
        for value, wish in goal.items():
            expected = sum(r.expected * r.tokens for r in got if (r.source, r.lang, r.topic)[m] == value)
            assert expected == pytest.approx(mixing.RATE * wish, rel=0.0011)
    assert sum(r.copies * r.tokens for r in got) >= 0.4 * total


def test_mixing_of_odd_rows(spark):
    docs = documents(spark)
    rows = mixing.mixed(mixing.with_margins(docs))
    assert rows.count() == docs.count() and rows.where("expected IS NULL OR copies IS NULL").count() == 0
    got = mixing.sampled_documents(docs)
    assert got.columns == docs.columns and {r.c0 for r in got.collect()} <= {"x"}
    times = {(r.doc_id, r.source, r.lang, r.topic): r.copies for r in rows.collect()}  # repeated rows share one fate
    drawn = Counter((r.doc_id, r.source or "", r.lang or "") for r in got.collect())
    want = Counter()
    for r in rows.collect():
        want[r.doc_id, r.source, r.lang] += times[r.doc_id, r.source, r.lang, r.topic]
    assert drawn == +want
    assert mixing.sampled_documents(empty(spark)).count() == 0


def test_the_sample_has_the_target_shares(spark):
    """Rare values too, whose documents are drawn several times."""
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), "de" if a < 0.04 else "en", "rare" if b < 0.02 else f"s{i % 3}", 1) for i, (n, a, b) in enumerate(zip(rng.integers(5, 30, 40_000), rng.random(40_000), rng.random(40_000)))]
    docs, topic = documents(spark, rows), F.lit("t")
    got, all_ = Counter(), Counter()
    for r in mixing.sampled_documents(docs, topic=topic).select("source", "lang", "text").collect():
        got["source", r.source] += len(r.text.split())
        got["lang", r.lang] += len(r.text.split())
    for r in rows:
        all_["source", r[3]] += len(r[1].split())
        all_["lang", r[2]] += len(r[1].split())
    for margin in ("source", "lang"):
        wish = {k: n ** mixing.TEMPER[margin] for k, n in all_.items() if k[0] == margin}
        tokens = sum(got[k] for k in wish)
        for k, n in wish.items():
            assert got[k] / tokens == pytest.approx(n / sum(wish.values()), rel=0.06), k


def test_targets_that_contradict_each_other(spark):
    rows = [(i, "w " * 5, "de" if i % 10 == 0 else "en", "a" if i % 10 == 0 else "b", 1) for i in range(200)]
    shares = {"source": {"a": 0.5, "b": 0.5}, "lang": {"de": 0.1, "en": 0.9}}
    with pytest.warns(UserWarning, match="contradict"):
        assert mixing.sampled_documents(documents(spark, rows), shares=shares, topic=F.lit("t")).count()


# Chat windows.


def brute_digest(turns) -> tuple:
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def turns_of(rows) -> dict:
    out = defaultdict(list)
    low = lambda x: (x is not None, x or 0)
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (low(r[1]), r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return out


NASTY = ["<|turn|>", "<\\|text|>", "\\", "<", "|>", "<|end|", "\\\\<|", "<|again|>user<|text|>x<|end|>", "\n", "<\\\\|", "Été \U0001f600", "$1 \\1", ""]


def conversation_rows():
    rows = [(1, i, "user" if i % 2 else "assistant", NASTY[i % len(NASTY)] * (1 + i % 3)) for i in range(60)]
    rows += [(2, 0, "system", "be brief <|")] + [(2, i, ("user", "assistant")[i % 2], f"word{i} " * 30 + NASTY[i % len(NASTY)]) for i in range(1, 400)]
    rows += [(3, 0, None, None), (3, 0, None, None), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, None, "user", "no turn")]
    rows += [(4, 0, "assistant", "long " * 50_000), (4, 1, "user", "x"), (None, 5, "assistant", "orphan"), (5, -3, "a<|text|>b", "role"), (6, 7, "system", "alone")]
    return [(*r, "x", 1, 2) for r in rows]


def test_windows_read_back(spark):
    rows = conversation_rows()
    windows = chat_windows.chat_windows(spark.createDataFrame(rows, CONVERSATIONS))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_windows.digests(windows).collect()}
    assert got == {c: brute_digest(t) for c, t in turns_of(rows).items()}


def test_windows_keep_their_budget(spark):
    rows = conversation_rows()
    windows = chat_windows.chat_windows(spark.createDataFrame(rows, CONVERSATIONS), budget=512, history=128).where("conv_id = 2").orderBy("window").collect()
    system = 3 + chat_windows.MARKS
    assert len(windows) > 10 and all(w.cost <= 512 + system for w in windows)
    assert all(w.formatted.startswith(("<|turn|>" if k == 0 else "<|again|>") + "system") for k, w in enumerate(windows))
    assert all(w.formatted.count("<|again|>") > 1 for w in windows[1:])  # history is repeated
    for w in windows:  # and never trained on
        masked = [w.formatted[x.start : x.start + x.length] for x in w.loss]
        assert len(masked) == w.formatted.count("<|turn|>assistant")
    assert chat_windows.digests(chat_windows.chat_windows(spark.createDataFrame([], CONVERSATIONS))).count() == 0


# Packing.


def check_pieces(rows, pieces) -> None:
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = Counter()
    ids = {}
    for i, text, *_ in rows:
        found = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(found))] += 1
        ids.setdefault((i, len(found)), []).append(found)
    held = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        held[(p.doc_id, p.doc_tokens)].append(p)
    assert held.keys() == want.keys()
    for k, n in want.items():
        assert sum(p.length for p in held[k]) == n * k[1]
        assert all(any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[k]) for p in held[k])
        cover = Counter(at for p in held[k] for at in range(p.start, p.start + p.length))
        assert set(cover.values()) == {n}
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
        padding += 0 if end & (end - 1) == 0 else packing.LENGTH - end
    assert padding == 0


def test_packing_of_odd_rows(spark):
    rows = [*ROWS, (50, "it's <|endoftext|> <|startoftext|> ... a--b!! 3.5% İstanbul ΑΣ é '", "en", "a", 1)]
    check_pieces(rows, packing.packed(documents(spark, rows), TOKENIZER).collect())
    assert packing.packed(empty(spark), TOKENIZER).count() == 0


def test_documents_and_sequences_read_back(spark, monkeypatch):
    """The ids themselves are there, of full pieces and of rests, whatever the groups."""
    monkeypatch.setattr(packing, "GROUP_BYTES", 50_000)
    rows = [(i, text, *_) for i, (_, text, *_) in enumerate(ROWS)]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    pieces = packing.packed(documents(spark, rows), TOKENIZER).collect()
    read, filled = defaultdict(list), defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        read[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert read == {i: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] for i, text, *_ in rows}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert len(filled[p.sequence_id]) == p.offset and len(p.ids) == 4 * p.length
        filled[p.sequence_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert max(map(len, filled.values())) == packing.LENGTH
    assert sum(map(len, filled.values())) == sum(map(len, read.values()))


def test_the_packed_corpus_keeps_its_ids(spark, sf_dir):
    done = corpus_pipeline.pack(spark, documents(spark), sf_dir)
    assert done.where("octet_length(ids) = 4 * length").count() == done.count() > 0
    assert "ids" not in QUERIES["op8_cost_packing"](spark, sf_dir).columns


def test_packing_in_many_groups(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(packing, "GROUP", 16)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_pieces([tuple(r) for r in docs.collect()], packing.packed(docs, TOKENIZER).collect())


def test_pieces_go_to_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 2048, 1000)
    limits = packing.capacities(int(sizes.sum()), 2048)
    room, cost, left = list(limits), [0.0] * len(limits), dict(enumerate(sizes.tolist()))
    order = []
    for item, start, size, at, offset in packing.assign(sizes, 2048):
        fits = [k for k, r in enumerate(room) if r >= left[item]]
        open_ = fits or [k for k, r in enumerate(room) if r]
        assert cost[at] == min(cost[k] for k in open_) and size == min(left[item], room[at])
        assert offset == limits[at] - room[at] and start == sizes[item] - left[item]
        cost[at] += packing.LINEAR * size + packing.QUADRATIC * size * size
        room[at] -= size
        left[item] -= size
        order.append(item)
    assert not any(room) and not any(left.values())
    firsts = [sizes[i] for i in dict.fromkeys(order)]
    assert firsts == sorted(firsts, reverse=True)


def test_a_known_word_table_that_overflows(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)
    with open(TOKENIZER, encoding="utf-8") as f:
        model = f.read()
    words = packing.WordIds(model, "<u4")
    tokenizer = Tokenizer.from_str(model)
    odd = "Ǆǅǆ ﬁre İI ıi ΑΣ ς Å Å K ſ ª ʰ 中文 हिन्दी é ́a x́y ßẞ ŉ ᾳ ᾼ Ⅷ ① a_b ’s 's it's IT'S don't x’s \x1c \x85 \xa0 a"
    texts = ["a b c d e f g.", "a b. c! D e, f g h i j k", "", "g. g! (x) y's a", " ", "  a\t\x0ba a\n", odd, ""]
    for _ in range(3):
        got = words(pa.array(texts, pa.large_string()))
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# The pipeline.


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram join", "mix sources", "pack"]


def test_every_stage_takes_odd_and_empty_tables(spark, sf_dir):
    for docs in (documents(spark), empty(spark)):
        for name, apply in corpus_pipeline.STAGES:
            got = apply(spark, docs, sf_dir)
            rows = got.collect()
            if name != "pack":
                assert got.columns == docs.columns, name
                left = Counter(tuple(r) for r in docs.collect())
                assert not Counter(tuple(r) for r in rows) - left, name
            assert docs.isEmpty() == (not rows), name


def test_the_pipeline_keeps_what_it_should(spark, sf_dir):
    """Every stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good, unlike, single, mixed, pack = (apply for _, apply in corpus_pipeline.STAGES)
    kept = {r.doc_id for r in good(spark, docs, sf_dir).collect()}
    assert all((i in kept) == bool(q) for i, q in labels.items())
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text.encode().lower()].append(r.doc_id)
    assert {r.doc_id for r in unlike(spark, docs, sf_dir).collect()} == {min(g) for g in groups.values()}
    pieces = pack(spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    done = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in done} <= kept and done
