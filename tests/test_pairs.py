"""Phrases of frequent words by an index of word pairs."""

import re
from random import Random

import pytest

from forumlake.operators.match import Clause, Query, analyse_query, cover
from forumlake.operators.postings import pair_postings
from forumlake.plans.index import add_generation, add_pairs, build_index, compact, open_index
from forumlake.plans.lake import Lake
from forumlake.plans.search import query_postings, text_matches
from forumlake.schema import ITEM_COLUMNS, ITEMS

COMMON = ["of", "the", "to"]
RARE = ["ship", "port", "sail", "wind"]


def items_of(spark, texts):
    base = {"deleted": False, "dead": False, "type": "comment", "kids": [], "parts": []}
    return spark.createDataFrame([tuple({**base, "id": i, "text": t}.get(c) for c in ITEM_COLUMNS) for i, t in texts.items()], ITEMS)


def drawn(n, seed, first=0):
    draw = Random(seed)
    words = [*COMMON * 4, *RARE]
    return {first + i: " ".join(draw.choice(words) for _ in range(draw.randrange(9))) if i % 17 else None for i in range(n)}


def lake_of(spark, items, index):
    def nothing():
        raise AssertionError("not needed")

    return Lake(items, lambda: index, nothing)


def holds(text, phrase):
    return re.search(rf"(^| ){phrase}( |$)", text or "") is not None


PHRASES = ["of the", "the the", "of the to the", "ship of", "of ship", "ship the port", "ship port", "ship port of", "to ship of the sail", "the wind wind the", "unknown the"]


def assert_phrases(spark, texts, index):
    lake = lake_of(spark, items_of(spark, texts), index)
    for phrase in PHRASES:
        for q, wanted in ((f'"{phrase}"', lambda t: holds(t, phrase)), (f'wind -"{phrase}"', lambda t: holds(t, "wind") and not holds(t, phrase))):
            found = {r["id"] for r in text_matches(lake, analyse_query(spark, q, "simple"), "all").collect()}
            assert found == {i for i, t in texts.items() if wanted(t)}, q


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    texts = drawn(400, 1)
    items = items_of(spark, texts)
    path = str(tmp_path_factory.mktemp("pairs") / "index")
    return texts, add_pairs(build_index(items, path, 0, "simple"), items, 0, 0.5)


def test_frequent_words_are_covered_by_pairs():
    frequent = frozenset(COMMON)
    phrases = {p: [t for _, t in cover(tuple(enumerate(p.split())), frequent)] for p in PHRASES}
    assert phrases["of the"] == ["of the"] and phrases["ship port"] == ["ship", "port"]
    assert phrases["ship the port"] == ["ship the", "port"] and phrases["of ship"] == ["of ship"]
    assert cover(((0, "the"), (2, "the")), frequent) == [(0, "the"), (2, "the")]
    for phrase, units in phrases.items():
        assert not frequent.intersection(units), phrase


def test_phrases_equal_brute_force(spark, made):
    texts, index = made
    assert index.frequent == frozenset(COMMON)
    assert_phrases(spark, texts, index)


def test_positions_of_frequent_words_are_not_read(spark, made):
    _, index = made
    query = Query(((Clause(False, tuple(enumerate(("ship", "of", "the", "port")))),),))
    plan = query_postings(index, query, index.counts(query.terms, "all"), "all")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "positions" in line.split("ReadSchema")[1]]
    terms = [re.search(r"In\(term, \[([^]]*)\]\)|EqualTo\(term,([^)]*)\)", line) for line in scans]
    read = {t for found in terms for t in (found.group(1) or found.group(2)).split(",")}
    assert read == {"ship of", "the port"}


def content(rows):
    return sorted((r["id"], r["term"], tuple(r["positions"])) for r in rows.collect())


def test_pairs_follow_later_generations(spark, made, tmp_path):
    texts, _ = made
    items = items_of(spark, texts)
    index = add_pairs(build_index(items, str(tmp_path / "index"), 0, "simple"), items, 0, 0.5)
    new = drawn(60, 2, first=380)
    index = add_generation(index, items_of(spark, {i: texts[i] for i in new if i in texts}), items_of(spark, new), "batch")
    after = {**texts, **new}
    wanted = content(pair_postings(items_of(spark, after), "simple", COMMON))
    assert content(index.postings(table="pairs")) == wanted
    whole = compact(index, str(tmp_path / "whole"))
    assert whole.frequent == frozenset(COMMON) and content(whole.postings(table="pairs")) == wanted
    assert_phrases(spark, after, open_index(spark, str(tmp_path / "whole")))
    with pytest.raises(ValueError):
        add_pairs(index, items, 0)
