"""Analysis, match, ranking, counts, tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.checks.base import (
    AS_OF, AS_OF_SQL, HIGHEST_SQL, HIT_SQL, NEWEST_SQL, NO_SNIPPET_SQL, SNIPPET_SQL, WORDS, as_hits, check, has, has_phrase, scores,
)
from forumlake.corpus import items_view, table
from forumlake.functions.requests import SearchFilters
from forumlake.functions.text import words
from forumlake.operators import counts, postings as post
from forumlake.plans import batch, counting
from forumlake.plans.lake import lake_of
from forumlake.plans.search import matches, search, typeahead
from forumlake.plans.sketches import build_sketches, estimate_counts
from forumlake.session import fresh_path

WITH = f"WITH {WORDS}"


def _lake(spark: SparkSession, sf_dir: str, config: str = "simple"):
    return lake_of(spark, sf_dir, config)


@check("terms", f"{WITH} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM posts GROUP BY term")
def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lake(spark, sf_dir).index.postings()
    return rows.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@check(
    "document_vectors",
    f"""{WITH} SELECT id, count(DISTINCT term) AS terms, count(*) AS dl, CAST(sum(pos * len(term)) AS BIGINT) AS placed,
  md5(string_agg(term, ' ' ORDER BY pos)) AS words FROM word_rows GROUP BY id""",
)
def _document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.postings(items_view(spark, sf_dir), "simple")
    placed = F.aggregate("positions", F.lit(0).cast("bigint"), lambda acc, p: acc + p * F.length("term"))
    words = F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term")))
    vectors = rows.groupBy("id").agg(
        F.count("*").alias("terms"), F.max("dl").cast("bigint").alias("dl"), F.sum(placed).alias("placed"), F.flatten(F.collect_list(words)).alias("w")
    )
    text = F.array_join(F.transform(F.sort_array("w"), lambda x: x["term"]), " ")
    return vectors.select("id", "terms", "dl", "placed", F.md5(text).alias("words"))


@check("term_stats", f"{WITH} SELECT scope, term, df FROM dfs")
def _term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lake(spark, sf_dir).index.term_stats().select("scope", "term", "df")


@check("corpus_stats", f"{WITH} SELECT scope, n, CAST(total_dl AS BIGINT) AS total_dl, round(total_dl / n, 4) AS avgdl FROM corpus")
def _corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _lake(spark, sf_dir).index.corpus_stats()
    return stats.withColumn("avgdl", F.round(F.col("total_dl") / F.col("n"), 4))


def _match(name: str, q: str, where: str, type_: str = "comment", more: str = "", **filters) -> None:
    typed = "" if type_ == "all" else f"type = '{type_}' AND"

    @check(name, f"{WITH} SELECT id FROM live WHERE {typed} ({where}) {more}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matches(_lake(spark, sf_dir), SearchFilters(q=q, type=type_, **filters), AS_OF).select("id")


_match("match_and", "the and", f"{has('the')} AND {has('and')}")
_match("match_or", "der OR the", f"{has('der')} OR {has('the')}", type_="all")
_match("match_not", "the -with", f"{has('the')} AND NOT {has('with')}")
_match("match_phrase", '"of the"', has_phrase("of", "the"))
_match("match_not_phrase", 'of the -"of the"', f"{has('of')} AND {has('the')} AND NOT {has_phrase('of', 'the')}", type_="all")
_match("match_exclusions", '-the -"de la"', f"NOT {has('the')} AND NOT {has_phrase('de', 'la')}")
_match(
    "match_mixed",
    '"in the" with or la -de or "der und"',
    f"({has_phrase('in', 'the')} AND {has('with')}) OR ({has('la')} AND NOT {has('de')}) OR {has_phrase('der', 'und')}",
    type_="all",
)
_match("match_since_author", "the", has("the"), more=f"AND \"by\" = 'src6' AND time >= {AS_OF_SQL} - INTERVAL 365 DAY", by="src6", since="year")


def _page(source: str, order: str, snippet: bool, page: int = 1, size: int = 30, bm25: bool = True) -> str:
    offset = (page - 1) * 30
    extra = "round(bm25, 4) AS bm25," if bm25 else ""
    snip = SNIPPET_SQL if snippet else NO_SNIPPET_SQL
    return f"""
SELECT {HIT_SQL}, {snip}, {extra} {offset} + row_number() OVER (ORDER BY {order}) AS rank
FROM (SELECT live.*, bm25 FROM live JOIN ({source}) USING (id) ORDER BY {order} LIMIT {size} OFFSET {offset}) ORDER BY rank"""


BEST = "round(bm25, 9) DESC, id"


def _ranked(name: str, q: str, type_: str, terms: list[str], where: str, snippet: bool, page: int = 1, more: str = "true", **filters) -> None:
    source = f"SELECT id, bm25 FROM scores JOIN live USING (id) WHERE ({where}) AND {more}"

    @check(name, f"{WITH}{scores(terms, type_)} {_page(source, BEST, snippet, page)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = search(_lake(spark, sf_dir), SearchFilters(q=q, type=type_, page=page, **filters), AS_OF)
        return as_hits(rows.withColumn("bm25", F.round("bm25", 4)))


_ranked("bm25_top", "the and", "comment", ["the", "and"], f"{has('the')} AND {has('and')}", True)
_ranked("bm25_third_page", "the and", "comment", ["the", "and"], f"{has('the')} AND {has('and')}", True, page=3)
_ranked("bm25_all_scope", "la OR der", "all", ["la", "der"], "true", True)
_ranked("bm25_stories", "the u3", "story", ["the", "u3"], f"{has('the')} AND {has('u3')}", False)
_ranked("bm25_polls", "the with", "poll", ["the", "with"], f"{has('the')} AND {has('with')}", False)
_ranked("bm25_phrase", '"of the" and', "comment", ["of", "the", "and"], f"{has_phrase('of', 'the')} AND {has('and')}", True)
_ranked(
    "bm25_author_since",
    "the with",
    "comment",
    ["the", "with"],
    f"{has('the')} AND {has('with')}",
    True,
    more=f"\"by\" = 'src6' AND time >= {AS_OF_SQL} - INTERVAL 30 DAY",
    by="src6",
    since="month",
)


def _resorted(name: str, sort: str, order: str) -> None:
    source = f"SELECT id, bm25 FROM scores WHERE {has('the')} AND {has('and')}"

    @check(name, f"{WITH}{scores(['the', 'and'], 'comment')} {_page(source, order, True, bm25=False)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_hits(search(_lake(spark, sf_dir), SearchFilters(q="the and", type="comment", sort=sort), AS_OF))


_resorted("text_by_date", "date", NEWEST_SQL)
_resorted("text_by_score", "score", HIGHEST_SQL)

_BOTH = f"{has('the')} AND {has('of')}"


@check(
    "typeahead_text",
    f"{WITH}{scores(['the', 'of'], 'story')} {_page(f'SELECT id, bm25 FROM scores WHERE {_BOTH}', BEST, False, size=8)}",
)
def _typeahead_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hits(typeahead(_lake(spark, sf_dir), "of -The").withColumn("bm25", F.round("bm25", 4)))


# Tables of queries, taken from the benchmark texts.

_ALL_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))"


def _queries(spark: SparkSession, sf_dir: str, type_: str, before: str, between: str, after: str) -> DataFrame:
    """A query of all distinct words of every benchmark text."""
    word = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    q = F.concat(F.lit(before), F.array_join(word, between), F.lit(after))
    return table(spark, sf_dir, "benchmark").filter(F.size(word) > 0).select(F.col("item_id").alias("qid"), q.alias("q"), F.lit(type_).alias("type"))


def _all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir, "comment", "", " ", "")


def _any_of(spark: SparkSession, sf_dir: str, type_: str = "comment") -> DataFrame:
    """Every word quoted, so that none is taken for an operator."""
    return _queries(spark, sf_dir, type_, '"', '" or "', '"')


_BATCH = f"""{WITH},
asked_terms AS (SELECT item_id AS qid, unnest({_ALL_WORDS}) AS term FROM benchmark),
needed AS (SELECT qid, count(*) AS k FROM asked_terms GROUP BY qid),
found AS (
  SELECT a.qid, p.id, count(*) AS k,
         sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / (c.total_dl / c.n)))) AS bm25
  FROM asked_terms a JOIN posts p USING (term) JOIN lengths l USING (id) JOIN corpus c ON c.scope = 'comment'
  JOIN dfs f ON f.scope = 'comment' AND f.term = a.term WHERE p.live AND p.type = 'comment' GROUP BY a.qid, p.id)
"""
_BEST_TEN = "numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS rank FROM hits) SELECT qid, rank, id, round(bm25, 4) AS bm25 FROM numbered WHERE rank <= 10"


@check("batch_match", f"{_BATCH} SELECT qid, id FROM found JOIN needed USING (qid, k)")
def _batch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold every word of a benchmark text."""
    return batch.batch_matches(_lake(spark, sf_dir), _all_of(spark, sf_dir), operators=False).select("qid", "id")


@check("batch_search", f"{_BATCH}, hits AS (SELECT qid, id, bm25 FROM found), {_BEST_TEN}")
def _batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows that hold any word of a benchmark text."""
    rows = batch.batch_search(_lake(spark, sf_dir), _any_of(spark, sf_dir), 10)
    return rows.select("qid", "rank", "id", F.round("bm25", 4).alias("bm25"))


@check(
    "batch_web_search",
    f"""{WITH},
texts AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
phrase AS (SELECT qid, len(w) AS k, unnest(generate_series(0, len(w) - 1)) AS off, unnest(w) AS term FROM texts WHERE len(w) > 1),
sides AS (SELECT qid, w[1] AS a, w[len(w)] AS b FROM texts WHERE len(w) > 1),
phrased AS (SELECT p.qid, x.id FROM phrase p JOIN word_rows x USING (term) GROUP BY p.qid, p.k, x.id, x.pos - p.off HAVING count(*) = p.k),
wanted AS (
  SELECT DISTINCT qid, id FROM (
    SELECT qid, id FROM phrased UNION ALL
    SELECT s.qid, p.id FROM sides s JOIN posts p ON p.term = s.b LEFT JOIN posts n ON n.id = p.id AND n.term = s.a WHERE n.id IS NULL)),
ranking AS (SELECT DISTINCT qid, term FROM phrase),
hits AS (
  SELECT r.qid, p.id, sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / (c.total_dl / c.n)))) AS bm25
  FROM ranking r JOIN posts p USING (term) JOIN wanted w ON w.qid = r.qid AND w.id = p.id JOIN lengths l ON l.id = p.id
  JOIN corpus c ON c.scope = 'all' JOIN dfs f ON f.scope = 'all' AND f.term = r.term WHERE p.live GROUP BY r.qid, p.id),
{_BEST_TEN}""",
)
def _batch_web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``"whole text" or last -first``: the text as a phrase, or its last word without its first."""
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    q = F.concat(F.lit('"'), F.array_join(word, " "), F.lit('" or "'), F.element_at(word, -1), F.lit('" -"'), F.element_at(word, 1), F.lit('"'))
    asked = table(spark, sf_dir, "benchmark").filter(F.size(word) > 1).select(F.col("item_id").alias("qid"), q.alias("q"), F.lit("all").alias("type"))
    rows = batch.batch_search(_lake(spark, sf_dir), asked, 10)
    return rows.select("qid", "rank", "id", F.round("bm25", 4).alias("bm25"))


@check(
    "batch_exclusions",
    f"""{_BATCH}, asked AS (SELECT item_id AS qid FROM benchmark),
barred AS (SELECT DISTINCT a.qid, p.id FROM asked_terms a JOIN posts p USING (term)),
hits AS (SELECT s.qid, l.id FROM asked s JOIN live l ON l.type = 'job' WHERE NOT EXISTS (SELECT 1 FROM barred b WHERE b.qid = s.qid AND b.id = l.id))
SELECT qid, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM hits GROUP BY qid""",
)
def _batch_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without any word of a benchmark text."""
    return batch.free_summary(_lake(spark, sf_dir), _queries(spark, sf_dir, "job", '-"', '" -"', '"'))


@check(
    "batch_first_free",
    f"""{_BATCH}, asked AS (SELECT item_id AS qid FROM benchmark),
barred AS (SELECT DISTINCT a.qid, p.id FROM asked_terms a JOIN posts p USING (term)),
hits AS (SELECT s.qid, l.id FROM asked s JOIN live l ON l.type = 'comment' WHERE NOT EXISTS (SELECT 1 FROM barred b WHERE b.qid = s.qid AND b.id = l.id))
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank, CAST(0 AS DOUBLE) AS bm25 FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY id) <= 10""",
)
def _batch_first_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows without any word of a benchmark text."""
    rows = batch.batch_search(_lake(spark, sf_dir), _queries(spark, sf_dir, "comment", '-"', '" -"', '"'), 10)
    return rows.select("qid", "id", "rank", "bm25")


# Counts.


@check("count_matches", f"{WITH} SELECT count(*) AS n FROM live WHERE type = 'comment' AND {has('the')}")
def _count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.full_count(matches(_lake(spark, sf_dir), SearchFilters(q="the", type="comment"), AS_OF))


_ESTIMATE = f"""{WITH},
share AS (
  SELECT max(df / n) FILTER (WHERE term = 'the') AS a, max(df / n) FILTER (WHERE term = 'with') AS b, max(df / n) FILTER (WHERE term = 'la') AS c
  FROM dfs JOIN corpus USING (scope) WHERE scope = 'comment'),
estimated AS (SELECT CAST(floor((SELECT count(*) FROM live WHERE type = 'comment') * (1 - (1 - a * (1 - b)) * (1 - c)) + 0.5) AS BIGINT) AS estimate FROM share),
exact AS (SELECT count(*) AS n FROM live WHERE type = 'comment' AND (({has("the")} AND NOT {has("with")}) OR {has("la")}))
"""
_COUNTED = SearchFilters(q="the -with or la", type="comment")


@check("count_estimate", f"{_ESTIMATE} SELECT estimate FROM estimated")
def _count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.estimate(_lake(spark, sf_dir), _COUNTED, AS_OF)


@check("match_count_exact", f"{_ESTIMATE} SELECT n AS count, estimate FROM exact, estimated")
def _match_count_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.match_count(_lake(spark, sf_dir), _COUNTED, AS_OF)


@check("match_count_word", f"{WITH} SELECT count(*) AS count, count(*) AS estimate FROM live WHERE type = 'comment' AND {has('the')}")
def _match_count_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.match_count(_lake(spark, sf_dir), SearchFilters(q="the", type="comment"), AS_OF)


_TWO_WORDS = f"""{WITH},
spelt AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM benchmark),
placed AS (SELECT words, unnest(generate_series(1, len(words) - 1)) AS place FROM spelt WHERE len(words) > 1),
asked AS (SELECT DISTINCT words[place] AS a, words[place + 1] AS b FROM placed),
held AS (SELECT id, term FROM posts WHERE live AND type = 'comment')
SELECT a || ' ' || b AS qid, count(y.id) AS estimate, count(y.id) AS low, count(y.id) AS high
FROM asked LEFT JOIN held x ON x.term = a LEFT JOIN held y ON y.term = b AND y.id = x.id GROUP BY a, b"""


def two_word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two neighbouring words of the benchmark texts."""
    spelt = table(spark, sf_dir, "benchmark").select(words(F.col("text")).alias("w"))
    beside = F.transform("w", lambda word, at: F.concat(word, F.lit(" "), F.get("w", at + 1)))
    pairs = spelt.select(F.explode(beside).alias("q")).filter("q IS NOT NULL").distinct()
    return pairs.select(F.col("q").alias("qid"), "q", F.lit("comment").alias("type"))


@check("sketch_counts", _TWO_WORDS)
def _sketch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two words from sketches, which are exact up to some thousand rows a word."""
    lake = _lake(spark, sf_dir)
    sketches = build_sketches(lake.index, lake.items, fresh_path(spark, "sketches"))
    return estimate_counts(sketches, two_word_queries(spark, sf_dir), operators=False)
