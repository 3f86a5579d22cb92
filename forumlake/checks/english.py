"""The English analyzer in SQL: Porter2 over the distinct words, one step a table.

Written from the published rules; suffixes are tried from the longest to the shortest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.checks.base import AS_OF, HIT_SQL, SNIPPET_SQL, WORDS, as_hits, check, has, has_phrase, scores
from forumlake.checks.text import _any_of, _lake
from forumlake.functions.requests import SearchFilters
from forumlake.plans import batch
from forumlake.plans.search import search

# The stop list, the exceptional forms, and the suffixes of steps 2 to 4 by falling length.
_STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
did doing a an the and but if or because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now""".split()
_FORMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_STILL = "inning outing canning herring earring proceed exceed succeed".split()
_SECOND = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
    ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"),
    ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_FOURTH = "ement able ance ence ible ment ant ate ent ion ism iti ive ize ous al er ic".split()


def _ending(col: str, suffixes) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({col}, '{s}') THEN '{s}'" for s in suffixes) + " ELSE '' END"


def _instead(col: str, pairs) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"


_SHORT = "regexp_matches({0}, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$')"
_LISTED = "({})".format(", ".join(f"'{w}'" for w in _STOP))


def stems_sql(vocabulary: str) -> str:
    """CTE ``stems`` (word, stem) of the words of ``vocabulary``; stop words have none."""
    return f"""
marked AS (
  SELECT word, array_to_string(list_transform(generate_series(1, length(word)), lambda i: CASE WHEN word[i] = 'y' AND (i = 1 OR regexp_matches(word[i - 1], '[aeiouy]'))
    THEN 'Y' ELSE word[i] END), '') AS w FROM {vocabulary} WHERE length(word) > 2),
first_region AS (
  SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN regexp_matches(w, '^commun') THEN 6
    WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r1 FROM marked),
regions AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]'))
    ELSE length(w) END AS r2 FROM first_region),
step1a AS (
  SELECT word, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, -2) WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN left(w, -2) ELSE left(w, -1) END
    WHEN ends_with(w, 's') AND NOT ends_with(w, 'us') AND NOT ends_with(w, 'ss') AND regexp_matches(left(w, -2), '[aeiouy]') THEN left(w, -1) ELSE w END AS w FROM regions),
ends1b AS (SELECT *, {_ending("w", ("eedly", "ingly", "edly", "eed", "ing", "ed"))} AS e FROM step1a),
cut1b AS (
  SELECT *, left(w, length(w) - length(e)) AS base, e IN ('eed', 'eedly') AS long,
    e <> '' AND e NOT IN ('eed', 'eedly') AND regexp_matches(left(w, length(w) - length(e)), '[aeiouy]') AS cut FROM ends1b),
step1b AS (
  SELECT word, r1, r2, w AS plural, CASE WHEN long AND length(base) >= r1 THEN base || 'ee' WHEN NOT cut THEN w
    WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e' WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, -1)
    WHEN r1 >= length(base) AND {_SHORT.format("base")} THEN base || 'e' ELSE base END AS w FROM cut1b),
step1c AS (SELECT word, r1, r2, plural, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, -1) || 'i' ELSE w END AS w FROM step1b),
ends2 AS (SELECT *, {_ending("w", [a for a, _ in _SECOND])} AS e FROM step1c),
step2 AS (
  SELECT word, r1, r2, plural, CASE WHEN e <> '' AND length(w) - length(e) >= r1 AND NOT (e = 'ogi' AND NOT ends_with(w, 'logi'))
    AND NOT (e = 'li' AND NOT regexp_matches(w, '[cdeghkmnrt]li$')) THEN left(w, length(w) - length(e)) || {_instead("e", _SECOND)} ELSE w END AS w FROM ends2),
ends3 AS (SELECT *, {_ending("w", [a for a, _ in _THIRD])} AS e FROM step2),
step3 AS (
  SELECT word, r1, r2, plural, CASE WHEN e <> '' AND length(w) - length(e) >= r1 AND (e <> 'ative' OR length(w) - length(e) >= r2)
    THEN left(w, length(w) - length(e)) || {_instead("e", _THIRD)} ELSE w END AS w FROM ends3),
ends4 AS (SELECT *, {_ending("w", _FOURTH)} AS e FROM step3),
step4 AS (
  SELECT word, r1, r2, plural, CASE WHEN e <> '' AND length(w) - length(e) >= r2 AND (e <> 'ion' OR regexp_matches(w, '[st]ion$'))
    THEN left(w, length(w) - length(e)) ELSE w END AS w FROM ends4),
step5 AS (
  SELECT word, plural, CASE WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_SHORT.format("left(w, -1)")})) THEN left(w, -1)
    WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w FROM step4),
forms AS (SELECT unnest({list(_FORMS)}) AS word, unnest({list(_FORMS.values())}) AS form),
stems AS (
  SELECT v.word, CASE WHEN v.word IN {_LISTED} THEN NULL WHEN f.form IS NOT NULL THEN f.form WHEN s.word IS NULL THEN v.word
    WHEN s.plural IN ({", ".join(f"'{w}'" for w in _STILL)}) THEN replace(s.plural, 'Y', 'y') ELSE replace(s.w, 'Y', 'y') END AS stem
  FROM {vocabulary} v LEFT JOIN step5 s USING (word) LEFT JOIN forms f USING (word))"""


def _english_words() -> str:
    """The CTEs of ``WORDS`` with English terms in place of plain words."""
    head, rest = WORDS.split("lengths AS (", 1)
    tail = rest[rest.index("posts AS (") :]
    return f"""{head}raw_rows AS (
  SELECT id, type, live, unnest(generate_series(0, len(words) - 1)) AS pos, unnest(words) AS word FROM docs WHERE len(words) > 0),
asked_words AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark),
vocabulary AS MATERIALIZED (SELECT word FROM raw_rows UNION SELECT word FROM asked_words),{stems_sql("vocabulary")},
word_rows AS (SELECT id, type, live, pos, stem AS term FROM raw_rows JOIN stems USING (word) WHERE stem IS NOT NULL),
lengths AS (SELECT d.id, d.type, d.live, count(w.term) AS dl FROM docs d LEFT JOIN word_rows w USING (id) GROUP BY d.id, d.type, d.live),
{tail}"""


WITH = f"WITH {_english_words()}"


@check("english_stems", f"{WITH} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM posts GROUP BY term")
def _english_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lake(spark, sf_dir, "english").index.postings()
    return rows.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@check("english_term_stats", f"{WITH} SELECT scope, term, df FROM dfs")
def _english_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lake(spark, sf_dir, "english").index.term_stats().select("scope", "term", "df")


@check(
    "english_search",
    f"""{WITH}{scores(["read", "stone", "hand", "thing"], "all")}
SELECT {HIT_SQL}, {SNIPPET_SQL}, round(bm25, 4) AS bm25, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS rank
FROM live JOIN scores USING (id) WHERE ({has("read")} AND {has_phrase("stone", "hand")}) OR {has("thing")} ORDER BY rank LIMIT 30""",
)
def _english_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop word excludes nothing."""
    f = SearchFilters(q='reading "stone hand" or things -other', type="all")
    return as_hits(search(_lake(spark, sf_dir, "english"), f, AS_OF).withColumn("bm25", F.round("bm25", 4)))


@check(
    "english_batch_search",
    f"""{WITH},
asked_terms AS (SELECT DISTINCT qid, stem AS term FROM asked_words JOIN stems USING (word) WHERE stem IS NOT NULL),
hits AS (
  SELECT a.qid, p.id, sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / (c.total_dl / c.n)))) AS bm25
  FROM asked_terms a JOIN posts p USING (term) JOIN lengths l USING (id) JOIN corpus c ON c.scope = 'comment'
  JOIN dfs f ON f.scope = 'comment' AND f.term = a.term WHERE p.live AND p.type = 'comment' GROUP BY a.qid, p.id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS rank FROM hits)
SELECT qid, rank, id, round(bm25, 4) AS bm25 FROM numbered WHERE rank <= 10""",
)
def _english_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.batch_search(_lake(spark, sf_dir, "english"), _any_of(spark, sf_dir), 10)
    return rows.select("qid", "rank", "id", F.round("bm25", 4).alias("bm25"))
