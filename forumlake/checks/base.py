"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

AS_OF = datetime(2024, 1, 9)
AS_OF_SQL = "TIMESTAMP '2024-01-09 00:00:00'"

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    run: Run
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = Check(run, sql)
        return run

    return register


# The items view of forumlake.corpus in SQL.
ITEMS = """
pages_items AS (
  SELECT page_id * 10 + 1 AS id, false AS deleted, 'story' AS type, 'u' || (page_id % 15) AS "by",
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id * 60) AS time, html AS text, false AS dead,
         CAST(NULL AS BIGINT) AS parent, CAST(NULL AS BIGINT) AS poll, CASE WHEN page_id % 4 = 0 THEN [page_id * 10 + 2, page_id * 10 + 12] ELSE CAST([] AS BIGINT[]) END AS kids, url,
         CASE WHEN page_id % 11 <> 0 THEN CAST(page_id * 37 % 500 AS INTEGER) END AS score,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST([] AS BIGINT[]) AS parts,
         CASE WHEN page_id % 7 <> 0 THEN CAST(page_id * 13 % 40 AS INTEGER) END AS descendants
  FROM pages),
documents_items AS (
  SELECT d.doc_id * 10 + 2 AS id, d.doc_id % 53 = 0 AS deleted,
         CASE d.doc_id % 20 WHEN 0 THEN 'job' WHEN 1 THEN 'story' WHEN 2 THEN 'poll' WHEN 3 THEN 'pollopt' ELSE 'comment' END AS type,
         d.source AS "by",
         CASE WHEN d.doc_id % 97 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) END AS time,
         d.text, coalesce(l.toxic, 0) = 1 AS dead,
         CASE WHEN d.doc_id % 20 > 3 THEN d.doc_id % 50 * 10 + 1 END AS parent,
         CASE WHEN d.doc_id % 20 = 3 THEN (d.doc_id - 1) * 10 + 2 END AS poll, CAST([] AS BIGINT[]) AS kids, CAST(NULL AS VARCHAR) AS url,
         CASE WHEN d.doc_id % 20 < 3 THEN CAST(d.doc_id % 300 AS INTEGER) END AS score,
         CASE WHEN d.doc_id % 20 < 3 THEN substring(d.text, 1, 60) END AS title,
         CASE WHEN d.doc_id % 20 = 2 THEN [(d.doc_id + 1) * 10 + 2] ELSE CAST([] AS BIGINT[]) END AS parts,
         CAST(NULL AS INTEGER) AS descendants
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
conversations_items AS (
  SELECT (conv_id * 100 + turn) * 10 + 3 AS id, false AS deleted, 'comment' AS type, role AS "by",
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 10 + turn) AS time, text, false AS dead,
         CASE WHEN turn = 0 THEN conv_id % 200 * 10 + 2 ELSE (conv_id * 100 + turn - 1) * 10 + 3 END AS parent,
         CAST(NULL AS BIGINT) AS poll, CAST([] AS BIGINT[]) AS kids, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS INTEGER) AS score,
         CAST(NULL AS VARCHAR) AS title, CAST([] AS BIGINT[]) AS parts, CAST(NULL AS INTEGER) AS descendants
  FROM conversations),
items AS (
  SELECT * FROM pages_items UNION ALL SELECT * FROM documents_items UNION ALL SELECT * FROM conversations_items),
live AS (SELECT * FROM items WHERE NOT deleted AND NOT dead)
"""

# Words of every item in order, plain analyzer: (id, type, live, pos, term).
WORDS = (
    ITEMS
    + """,
docs AS (
  SELECT id, type, NOT deleted AND NOT dead AS live,
         regexp_extract_all(lower(regexp_replace(concat_ws(' ', title, "by", regexp_replace(text, '<[^>]+>', ' ', 'g')),
                                                 '&[#A-Za-z0-9]+;', ' ', 'g')), '[\\p{L}\\p{N}]+') AS words
  FROM items),
lengths AS (SELECT id, type, live, len(words) AS dl FROM docs),
word_rows AS (
  SELECT id, type, live, unnest(generate_series(0, len(words) - 1)) AS pos, unnest(words) AS term FROM docs WHERE len(words) > 0),
posts AS (SELECT id, type, live, term, count(*) AS tf FROM word_rows GROUP BY ALL),
scoped AS (
  SELECT 'all' AS scope, id, type, live FROM docs
  UNION ALL SELECT type, id, type, live FROM docs WHERE live AND type IN ('story', 'comment', 'job')),
corpus AS (SELECT scope, count(*) AS n, sum(dl) AS total_dl FROM scoped JOIN lengths USING (id) GROUP BY scope),
dfs AS (SELECT scope, term, count(*) AS df FROM scoped JOIN posts USING (id) GROUP BY scope, term)
"""
)


def scores(terms: list[str], type_: str) -> str:
    """CTE ``scores`` (id, bm25): live rows of a type holding any of the terms."""
    scope = type_ if type_ in ("story", "comment", "job") else "all"
    listed = ", ".join(f"'{t}'" for t in terms)
    typed = "" if type_ == "all" else f"AND p.type = '{type_}'"
    return f""",
scores AS (
  SELECT p.id, sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
                   / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / (c.total_dl / c.n)))) AS bm25
  FROM posts p JOIN lengths l USING (id) JOIN corpus c ON c.scope = '{scope}' JOIN dfs f ON f.scope = c.scope AND f.term = p.term
  WHERE p.live {typed} AND p.term IN ({listed}) GROUP BY p.id)"""


def has(term: str) -> str:
    return f"id IN (SELECT id FROM posts WHERE term = '{term}')"


def has_phrase(*terms: str) -> str:
    joins = " ".join(f"JOIN word_rows w{i} ON w{i}.id = w0.id AND w{i}.pos = w0.pos + {i} AND w{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"id IN (SELECT w0.id FROM word_rows w0 {joins} WHERE w0.term = '{terms[0]}')"


HIT_SQL = 'id, type, "by" AS author, time, url, score, title, descendants, parent'
SNIPPET_SQL = "left(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), 240) AS snippet"
NO_SNIPPET_SQL = "CAST(NULL AS VARCHAR) AS snippet"

NEWEST_SQL = "time DESC NULLS FIRST, id"
HIGHEST_SQL = "score DESC NULLS LAST, time DESC NULLS FIRST, id"


def page_sql(source: str, order: str, snippet: bool, page: int = 1, size: int = 30, extra: str = "") -> str:
    offset = (page - 1) * 30
    return f"""
SELECT {HIT_SQL}, {SNIPPET_SQL if snippet else NO_SNIPPET_SQL}, {extra}
       {offset} + row_number() OVER (ORDER BY {order}) AS rank
FROM (SELECT * FROM {source} ORDER BY {order} LIMIT {size} OFFSET {offset}) ORDER BY rank"""


def in_places(df: DataFrame, name: str = "place") -> DataFrame:
    """Numbers the rows of a sorted table as they come, so that its order is compared too."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("bigint"))


def as_hits(df: DataFrame) -> DataFrame:
    """Result columns under the names the SQL uses."""
    return df.withColumnRenamed("by", "author")
