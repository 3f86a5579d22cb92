"""Stems, query syntax, and English search against brute force."""

import math
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forumlake.functions.requests import SearchFilters
from forumlake.functions.stemming import STOP_WORDS, english_terms, stem
from forumlake.operators import joins
from forumlake.operators.match import analyse_query
from forumlake.plans import batch
from forumlake.plans.lake import lake_of, write_lake
from forumlake.plans.search import matches, query_postings, search, typeahead
from forumlake.session import fresh_path

AS_OF = datetime(2024, 1, 11)

STEMS = """
consign consign consigned consign consigning consign consignment consign consistency consist consistently consist
consolation consol consolatory consolatori consolidate consolid consolidating consolid consolingly consol
conspicuously conspicu conspiracy conspiraci conspirator conspir constables constabl constancy constanc
knackeries knackeri knaves knave knavish knavish kneaded knead knightly knight knitting knit knives knive
generously generous communication communic hopping hop hoping hope happy happi cry cri by by say say ties tie cries cri
gas gas this this gaps gap kiwis kiwi agreed agre relational relat conditional condit digitizer digit hopeful hope
goodness good electricity electr controllable control probate probat cease ceas roll roll falling fall fizzed fizz
filing file luxuriated luxuri yellow yellow enjoy enjoy skies sky dying die innings inning exceeded exceed
vietnamization vietnam feudalism feudal decisiveness decis hopefulness hope sensibiliti sensibl triplicate triplic
"""


def test_stems():
    words = STEMS.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2]))


def test_terms_keep_the_places_of_stop_words(spark):
    df = spark.createDataFrame([(["the", "running", "dogs", "of", "war"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(english_terms("w")).collect()] == [[None, "run", "dog", None, "war"], []]


def shape(spark, q, config="english", operators=True):
    query = analyse_query(spark, q, config, operators)
    return [[("-" if c.negated else "") + "_".join(f"{t}" if off == c.terms[0][0] else f"+{off - c.terms[0][0]}{t}" for off, t in c.terms) for c in g] for g in query.groups]


@pytest.mark.parametrize(
    ("q", "groups"),
    [
        ("running dogs", [["run", "dog"]]),
        ('"war of dogs"', [["war_+2dog"]]),
        ("cat -dogs", [["cat", "-dog"]]),
        ("cat OR dog -bird", [["cat"], ["dog", "-bird"]]),
        ('-"big cat" fish', [["-big_+1cat", "fish"]]),
        ("the and", []),
        ("the OR and", []),
        ("the -and", []),
        ('"of the"', []),
        ('-"of the"', []),
        ("or cat", [["cat"]]),
        ("cat or", [["cat"]]),
        ("cat or or dog", [["cat"], ["dog"]]),
        ("foo-bar", [["foo_+1bar"]]),
        ('"unclosed phrase', [["unclos_+1phrase"]]),
        ("", []),
        ("-cat", [["-cat"]]),
    ],
)
def test_query_syntax(spark, q, groups):
    assert shape(spark, q) == [[c.replace("phrase", stem("phrase")) for c in g] for g in groups]


def test_plain_syntax_ignores_operators(spark):
    assert shape(spark, 'cat -dog "big fish" or', operators=False) == [["cat", "dog", "big", "fish"]]


# Brute force in plain Python over the small fixture.


class Brute:
    def __init__(self, rows):
        self.docs = {}
        for r in rows:
            text = re.sub(r"<[^>]+>", " ", r["text"] or "")
            doc = " ".join(x for x in (r["title"], r["by"], text) if x is not None)
            words = re.findall(r"[^\W_]+", re.sub(r"&[#A-Za-z0-9]+;", " ", doc).lower())
            kept = [(i, stem(w)) for i, w in enumerate(words) if w not in STOP_WORDS]
            self.docs[r["id"]] = (r["type"], not r["deleted"] and not r["dead"], kept)

    def has(self, id_, *words):
        at = {}
        for i, t in self.docs[id_][2]:
            at.setdefault(t, set()).add(i)
        starts = None
        for off, w in words:
            found = {i - off for i in at.get(stem(w), ())}
            starts = found if starts is None else starts & found
        return bool(starts)

    def bm25(self, terms, type_):
        members = [k for k in self.docs.values() if type_ == "all" or (k[0] == type_ and k[1])]
        n, total = len(members), sum(len(k[2]) for k in members)
        df = Counter(t for k in members for t in {t for _, t in k[2]})
        scores = {}
        for id_, (kind, live, kept) in self.docs.items():
            tf = Counter(t for _, t in kept)
            score = 0.0
            for t in set(terms):
                if tf[t]:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    score += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(kept) / (total / n)))
            scores[id_] = score
        return scores


@pytest.fixture(scope="module")
def english(spark, sf_dir):
    lake = lake_of(spark, sf_dir, "english")
    return lake, Brute(lake.items.collect())


def test_english_phrase_and_exclusion(spark, english):
    lake, brute = english
    common = Counter(t for _, _, kept in brute.docs.values() for t in {t for _, t in kept}).most_common(40)
    a, b = common[10][0], common[20][0]
    pairs = Counter()
    for _, _, kept in brute.docs.values():
        pairs.update({(x[1], y[1]) for x, y in zip(kept, kept[1:]) if y[0] == x[0] + 1})
    (p, q), _ = pairs.most_common(1)[0]
    f = SearchFilters(q=f'"{p} {q}" -{a} or {b}', type="all")
    got = {r["id"]: r["bm25"] for r in matches(lake, f, AS_OF).collect()}
    expected = {
        i for i, (_, live, _) in brute.docs.items()
        if live and ((brute.has(i, (0, p), (1, q)) and not brute.has(i, (0, a))) or brute.has(i, (0, b)))
    }
    assert set(got) == expected and expected
    scores = brute.bm25([stem(p), stem(q), stem(b)], "all")
    assert all(math.isclose(got[i], scores[i], rel_tol=1e-9) for i in expected)


def test_rare_terms_anchor_the_search(spark, english):
    """A rare word next to a frequent one: the frequent postings are cut first."""
    lake, brute = english
    seen = Counter(t for _, live, kept in brute.docs.values() if live for t in {t for _, t in kept})
    frequent = seen.most_common(1)[0][0]
    both = Counter(t for _, live, kept in brute.docs.values() if live and frequent in {x for _, x in kept} for t in {x for _, x in kept})
    rare = min(t for t, k in both.items() if k == 2 and seen[t] <= 3 and stem(t) == t)
    f = SearchFilters(q=f"{frequent} {rare}", type="all")
    query = analyse_query(spark, f.q)
    counts = lake.index.counts(query.terms, "all")
    assert query.anchors(counts.df) == [rare]
    assert "LeftSemi" in query_postings(lake.index, query, counts, "all")._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["bm25"] for r in matches(lake, f, AS_OF).collect()}
    expected = {i for i, (_, live, _) in brute.docs.items() if live and brute.has(i, (0, frequent)) and brute.has(i, (0, rare))}
    scores = brute.bm25([frequent, rare], "all")
    assert set(got) == expected and len(expected) == 2
    assert all(math.isclose(got[i], scores[i], rel_tol=1e-9) for i in expected)


def test_english_batch_equals_single_searches(spark, english):
    lake, brute = english
    common = [t for t, _ in Counter(t for _, _, kept in brute.docs.values() for t in {t for _, t in kept}).most_common(60)]
    asked = [f"{common[5]} {common[9]}", f'"{common[3]} {common[4]}" or {common[30]}', f"{common[7]} -{common[8]}", f"-{common[0]}", "the of", "zzzz"]
    rows = [(i, q, t) for i, (q, t) in enumerate((q, t) for q in asked for t in ("comment", "all", "poll"))]
    queries = spark.createDataFrame(rows, "qid int, q string, type string")
    got = {(r["qid"], r["id"]): r["bm25"] for r in batch.batch_matches(lake, queries).collect()}
    for qid, q, type_ in rows:
        single = {(qid, r["id"]): r["bm25"] for r in matches(lake, SearchFilters(q=q, type=type_), AS_OF).collect()}
        mine = {k: v for k, v in got.items() if k[0] == qid}
        assert set(mine) == set(single), (q, type_)
        assert all(math.isclose(mine[k], single[k], rel_tol=1e-9, abs_tol=1e-12) for k in mine)


@pytest.mark.parametrize("width", [1024, 16])
def test_best_rows_of_exclusions_need_no_whole_corpus(spark, english, monkeypatch, width):
    """Alone, beside a group that requires words, and where the first blocks leave no row free."""
    monkeypatch.setattr(batch, "LEAST_WIDTH", width)
    lake, brute = english
    common = [t for t, _ in Counter(t for _, _, kept in brute.docs.values() for t in {t for _, t in kept}).most_common(20)]
    asked = [f"-{common[0]}", f"{common[3]} or -{common[1]}", f'-{common[0]} or -"{common[2]} {common[3]}"', "-zzzz", f"{common[4]} -{common[5]}"]
    queries = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate((q, t) for q in asked for t in ("comment", "all", "job"))], "qid int, q string, type string")
    best = {}
    everything = batch.batch_matches(lake, queries).collect()
    for r in sorted(everything, key=lambda r: (r["qid"], -round(r["bm25"], 9), r["id"])):
        best.setdefault(r["qid"], []).append(r["id"])
    got = {}
    for r in batch.batch_search(lake, queries, 7).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {qid: ids[:7] for qid, ids in best.items()}
    alone = queries.filter("q LIKE '-%'")
    free = {r["qid"]: (r["n"], r["first_id"], r["last_id"]) for r in batch.free_summary(lake, alone).collect()}
    assert free == {r["qid"]: (len(best[r["qid"]]), min(best[r["qid"]]), max(best[r["qid"]])) for r in alone.collect() if r["qid"] in best}


def test_salted_join_gives_the_same_batch(spark, english, monkeypatch):
    lake, brute = english
    common = [t for t, _ in Counter(t for _, _, kept in brute.docs.values() for t in {t for _, t in kept}).most_common(12)]
    queries = spark.createDataFrame([(1, f"{common[0]} {common[1]}", "all"), (2, f'"{common[2]} {common[3]}"', "comment")], "qid int, q string, type string")
    plain = sorted(map(tuple, batch.batch_matches(lake, queries).select("qid", "id").collect()))
    monkeypatch.setattr(batch, "join_small", lambda *a, rows=None, **k: joins.join_small(*a, max_rows=0, rows=1, **k))
    assert sorted(map(tuple, batch.batch_matches(lake, queries).select("qid", "id").collect())) == plain and plain


def test_pages_join_up(spark, english):
    lake, _ = english
    f = SearchFilters(q="-zzzz", type="comment")
    pages = [[r["id"] for r in search(lake, SearchFilters(q=f.q, type=f.type, page=p), AS_OF).collect()] for p in (1, 2)]
    everything = [r["id"] for r in matches(lake, f, AS_OF).orderBy(F.col("bm25").desc(), "id").limit(60).collect()]
    assert pages[0] + pages[1] == everything


def test_typeahead(spark, english):
    lake, _ = english
    assert typeahead(lake, "").count() == 0
    assert typeahead(lake, "u").count() == 8


def test_stored_lake_gives_the_same_pages(spark, english):
    lake, brute = english
    stored = write_lake(lake.items.withColumn("time", F.col("time").cast("timestamp")), fresh_path(spark, "lake"), 0)
    word = Counter(t for kind, live, kept in brute.docs.values() if live and kind == "comment" for t in {t for _, t in kept}).most_common(8)[7][0]
    for f in (SearchFilters(q=word, type="comment"), SearchFilters(q=word, type="all", sort="date"), SearchFilters(type="job")):
        ours, theirs = search(lake, f, AS_OF).collect(), search(stored, f, AS_OF).collect()
        assert [r["id"] for r in ours] == [r["id"] for r in theirs] and ours


def test_stems_in_sql(spark):
    """The SQL of the checks, written from the rules apart from ``stem``, over regular and made-up forms."""
    import random

    import duckdb

    from forumlake.checks.english import stems_sql

    rng = random.Random(5)
    bases = "run national hop agree sky die general commun arsenal happy gentle logic biolog ugli able formal sensat adjust adopt bowl control roll yyy ayy enjoy say".split()
    ends = "s es ied ies ed ing ingly eed eedly edly y ly ational tional izer ation ator alism iveness fulness ousness iviti biliti ogi lessli alize icate ical ful ness ative ement ion e ll".split()
    words = {b + e for b in bases for e in ends} | {"".join(rng.choice("aeiouybtlsnd") for _ in range(rng.randrange(1, 9))) + rng.choice(ends) for _ in range(3000)}
    con = duckdb.connect()
    con.execute("CREATE TABLE vocabulary AS SELECT unnest(?) AS word", [sorted(words | STOP_WORDS)])
    got = dict(con.execute(f"WITH {stems_sql('vocabulary')} SELECT word, stem FROM stems").fetchall())
    assert got == {w: None if w in STOP_WORDS else stem(w) for w in words | STOP_WORDS}


def test_single_clauses_need_no_group_step(spark, sf_dir, monkeypatch):
    lake = lake_of(spark, sf_dir, "simple")
    asked = [(1, "the or and or with", "all"), (2, '"of the" or la', "comment"), (3, "la or -the", "story"), (4, "-the or -and", "all"), (5, "nowhere or the", "job")]
    queries = spark.createDataFrame(asked, "qid int, q string, type string")

    def found():
        return {(r["qid"], r["id"]): round(r["bm25"], 6) for r in batch.batch_matches(lake, queries).collect()}

    ways = []
    judged_rows = batch.judged_rows
    monkeypatch.setattr(batch, "judged_rows", lambda hits, phrases, alone, uncut: ways.append(alone) or judged_rows(hits, phrases, alone, uncut))
    short = found()
    monkeypatch.setattr(batch, "judged_rows", lambda hits, phrases, alone, uncut: judged_rows(hits, phrases))
    assert ways == [True] and short == found() and len({qid for qid, _ in short}) == 5


def test_hits_of_many_queries_are_shuffled_once_a_posting(spark, sf_dir, monkeypatch):
    """Not once a query: rows are laid out by id before they meet the queries."""
    lake = lake_of(spark, sf_dir, "simple")
    asked = [(k, q, t) for k, (q, t) in enumerate([("the or and or la", "comment"), ("la or der", "all"), ("the or nowhere", "job")] * 3)]
    rows, _ = batch.judged(lake, spark.createDataFrame(asked, "qid int, q string, type string"))
    assert "hashpartitioning(qid" not in rows._jdf.queryExecution().executedPlan().toString()
    asked = [(1, '"of the" or la', "all"), (2, "the and", "comment"), (3, '"der und" der or "in the"', "all")]
    queries = spark.createDataFrame(asked, "qid int, q string, type string")

    def found():
        return {(r["qid"], r["id"]): round(r["bm25"], 6) for r in batch.batch_matches(lake, queries).collect()}

    cut_first = found()
    monkeypatch.setattr(batch, "fits_broadcast", lambda df: False)
    assert found() == cut_first and len({qid for qid, _ in cut_first}) == 3


def test_word_pairs_are_made_for_phrases_alone(spark, sf_dir, monkeypatch):
    from forumlake.plans import lake as lakes

    monkeypatch.setattr(lakes, "_built", {})
    made, add_pairs = [], lakes.add_pairs
    monkeypatch.setattr(lakes, "add_pairs", lambda index, *rest: made.append(index.path) or add_pairs(index, *rest))
    lake = lake_of(spark, sf_dir, "simple")
    assert matches(lake, SearchFilters(q="the and", type="comment"), AS_OF).count() and not made
    assert matches(lake, SearchFilters(q='"of the"', type="comment"), AS_OF).count() and made == [lake.index.path]
    assert lake.phrase_index.frequent and not lake.index.frequent


def test_runs_of_terms(monkeypatch):
    """Documents without terms, terms that are not indexed, and documents longer than what is cut at once."""
    import pyarrow as pa

    from forumlake.functions import runs

    texts = [None, [], ["b", None, "a", "b"], [None], ["é", "a"], ["a"] * 7, ["b", "a"]]
    kinds = ["x", "x", "y", "x", "x", "y", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(kinds), pa.array(texts, pa.list_(pa.string()))], names=["id", "type", "terms"])
    for words in (1, 5, 1000):
        monkeypatch.setattr(runs, "WORDS", words)
        got = [r for b in runs.cut_runs(("id", "type"))([batch, batch.slice(4)]) for r in b.to_pylist()]
        want = []
        for i in [*range(7), 4, 5, 6]:
            held = [(t, k) for k, t in enumerate(texts[i] or []) if t is not None]
            for t in sorted({t for t, _ in held}):
                at = [k for x, k in held if x == t]
                want.append((i, kinds[i], t, len(at), len(held), at))
        assert sorted(tuple(r.values()) for r in got) == sorted(want)
        if words == 1000:  # in the order of the stored table, one type after the other
            assert [(r["type"], r["term"], r["id"]) for r in got[:7]] == sorted((r["type"], r["term"], r["id"]) for r in got[:7])
    pairs = [r for b in runs.cut_runs(("id", "type"), frozenset("a"))([batch]) for r in b.to_pylist()]
    assert {(r["id"], r["term"]): (r["tf"], r["dl"], r["positions"]) for r in pairs} == {(2, "a b"): (1, 1, [2]), (4, "é a"): (1, 1, [0]), (5, "a a"): (6, 6, list(range(6))), (6, "b a"): (1, 1, [0])}


def test_documents_are_stemmed_where_they_are_cut(spark, english):
    """No list of words crosses to Python twice; the terms are those of query words, whatever was met before."""
    from forumlake.functions import stemming
    from forumlake.operators.postings import postings

    posts = postings(english[0].items, "english")
    text = posts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "ArrowEvalPython" not in text
    words = ["the", "running", "runs", "kayak", "sky", "runs", "naïve", "été", "eed", "y", "9s"]
    terms_of = stemming.remembered_terms()
    for _ in range(2):
        assert terms_of(words) == [None if w in STOP_WORDS else stem(w) for w in words]
    some = spark.createDataFrame([(w,) for w in words], "w string").select(english_terms(F.array("w"))[0].alias("t"))
    assert [r["t"] for r in some.collect()] == terms_of(words)


def test_hits_laid_out_by_id_are_summed_where_they_are(spark, sf_dir, monkeypatch):
    """Groups of several clauses need no shuffle of hits by query and row, and rows are looked for in opened blocks alone."""
    lake = lake_of(spark, sf_dir, "simple")
    asked = [(1, "-the -and -la", "comment"), (2, "-der -the", "all"), (3, "-nowhere -with", "job"), (4, "la the or -der -of", "all")]
    queries = spark.createDataFrame(asked, "qid int, q string, type string")
    laid, repartition = [], type(queries).repartition
    monkeypatch.setattr(type(queries), "repartition", lambda df, *keys: laid.append(keys) or repartition(df, *keys))
    shut, semi = [], batch.shut_in
    monkeypatch.setattr(batch, "shut_in", lambda barred, wanted, n: shut.append((barred.count(), semi(barred, wanted, n).count())) or semi(barred, wanted, n))
    rows = batch.batch_search(lake, queries, 2).collect()
    assert laid and ("qid", "id") not in laid
    assert len(shut) == 1 and shut[0][1] <= shut[0][0]
    whole = {(r["qid"], r["id"]): round(r["bm25"], 6) for r in batch.batch_matches(lake, queries).collect()}
    best = {q: sorted((-b, i) for (of, i), b in whole.items() if of == q)[:2] for q in (1, 2, 3, 4)}
    assert {q: [(-round(r["bm25"], 6), r["id"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == q] for q in best} == best


def test_postings_are_shuffled_packed(spark, monkeypatch):
    """Packed rows hold what single rows hold: documents without terms, NULL keys, long documents, cut at any place."""
    from forumlake.functions import runs
    from forumlake.operators import postings as post
    from forumlake.schema import ITEM_COLUMNS, ITEMS

    texts = [None, "", "b a b the", "é a", "a " * 9, "b A running", "x " + "y " * 33000 + "x", "the the of a"]
    base = {"deleted": False, "dead": False, "type": "comment", "kids": [], "parts": []}
    rows = [{**base, "id": k, "text": t, "type": ["comment", "job", "poll"][k % 3], "dead": k == 3, "score": k if k % 2 else None, "time": datetime(2024, 1, k + 1) if k % 4 else None} for k, t in enumerate(texts)]
    items = spark.createDataFrame([tuple(r.get(c) for c in ITEM_COLUMNS) for r in rows], ITEMS).coalesce(2)

    def content(df):
        return sorted(map(repr, df.select(*post.ROW, "term", "tf", "dl", "positions").collect()))

    for words, documents in ((1, 2**15), (6, 2**15), (1_000_000, 2), (1_000_000, 2**15)):
        monkeypatch.setattr(runs, "WORDS", words)
        monkeypatch.setattr(runs, "DOCUMENTS", documents)
        for config, buckets, frequent in (("simple", 8, None), ("english", 1, None), ("simple", 3, ["a", "the"])):
            packs = post.packed(items, config, buckets, frequent)
            single = post.postings(items, config) if frequent is None else post.pair_postings(items, config, frequent)
            got = post.unpacked(packs)
            assert content(got) == content(single) and got.filter(F.col("bucket") != post.bucket_of(F.col("term"), buckets)).isEmpty()
    assert packs.count() < single.count()
    none = post.packed(items.limit(0), "simple", 8)
    assert none.isEmpty() and post.unpacked(none).isEmpty()
