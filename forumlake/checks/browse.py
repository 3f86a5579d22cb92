"""Browsing, prefixes, authors, result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.checks.base import AS_OF, AS_OF_SQL, HIGHEST_SQL, ITEMS, NEWEST_SQL, SNIPPET_SQL, as_hits, check, page_sql
from forumlake.corpus import items_view, table
from forumlake.functions import display
from forumlake.functions.requests import SAVED_SEARCHES, SearchFilters, normalise_requests
from forumlake.functions.text import search_document
from forumlake.operators import counts
from forumlake.operators.filters import live
from forumlake.operators.projections import coerce_results, hit_columns, thread_columns
from forumlake.plans.lake import lake_of
from forumlake.plans.search import search, search_flags, typeahead, user_items
from forumlake.sources.items import profile

WITH = f"WITH {ITEMS}"
TITLED = "title IS NOT NULL AND title <> ''"


def _search(f: SearchFilters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_hits(search(lake_of(spark, sf_dir, "simple"), f, AS_OF))

    return run


def _live(where: str) -> str:
    return f"(SELECT * FROM live WHERE {where})"


check("browse_new", WITH + page_sql(_live(f"type = 'story' AND {TITLED}"), NEWEST_SQL, False))(_search(SAVED_SEARCHES["new"]))
check("browse_top", WITH + page_sql(_live(f"type = 'story' AND {TITLED}"), HIGHEST_SQL, False))(_search(SAVED_SEARCHES["top"]))
check("browse_jobs", WITH + page_sql(_live(f"type = 'job' AND {TITLED}"), NEWEST_SQL, False))(_search(SAVED_SEARCHES["jobs"]))
check("browse_comments", WITH + page_sql(_live("type = 'comment'"), NEWEST_SQL, True))(_search(SAVED_SEARCHES["comments"]))
check("browse_all", WITH + page_sql(_live(TITLED), NEWEST_SQL, False))(_search(SearchFilters(type="all")))
check("browse_second_page", WITH + page_sql(_live("type = 'comment'"), NEWEST_SQL, True, page=2))(_search(SearchFilters(type="comment", page=2)))
check("browse_polls_by_score", WITH + page_sql(_live(f"type = 'poll' AND {TITLED}"), HIGHEST_SQL, False))(
    _search(SearchFilters(type="poll", sort="score"))
)
check(
    "by_author_since",
    WITH + page_sql(_live(f"type = 'story' AND {TITLED} AND \"by\" = 'u3' AND time >= {AS_OF_SQL} - INTERVAL 7 DAY"), NEWEST_SQL, False),
)(_search(SearchFilters(by="u3", since="week")))
check(
    "prefix_search",
    WITH + page_sql(_live("starts_with(lower(title), 'la') OR starts_with(lower(\"by\"), 'la')"), NEWEST_SQL, True),
)(_search(SearchFilters(q="La", type="all")))
check(
    "prefix_by_score",
    WITH + page_sql(_live("type = 'story' AND (starts_with(lower(title), 'u1') OR starts_with(lower(\"by\"), 'u1'))"), HIGHEST_SQL, False),
)(_search(SearchFilters(q="u1", sort="score")))


@check("user_items", WITH + page_sql(_live("\"by\" = 'src3'"), NEWEST_SQL, True))
def _user_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = lake_of(spark, sf_dir, "simple")
    return as_hits(user_items(lake.items, "src3", access=lake.access))


@check("user_items_second_page", WITH + page_sql(_live("\"by\" = 'assistant'"), NEWEST_SQL, True, page=2))
def _user_items_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = lake_of(spark, sf_dir, "simple")
    return as_hits(user_items(lake.items, "assistant", 2, lake.access))


@check(
    "typeahead_prefix",
    WITH + page_sql(_live("starts_with(lower(title), 'th') OR starts_with(lower(\"by\"), 'th')"), NEWEST_SQL, False, size=8),
)
def _typeahead_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hits(typeahead(lake_of(spark, sf_dir, "simple"), "th"))


@check(
    "page_flags",
    f"""{WITH}, seen AS (SELECT count(*) AS k FROM (SELECT id FROM live WHERE type = 'job' AND {TITLED} LIMIT 31 OFFSET 30))
SELECT CAST(2 AS BIGINT) AS page, least(k, 30) AS rows, true AS has_previous, k > 30 AS has_next FROM seen""",
)
def _page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_flags(lake_of(spark, sf_dir, "simple"), SearchFilters(type="job", page=2), AS_OF)


@check("hit_snippets", f'{WITH} SELECT id, type, "by" AS author, score, title, {SNIPPET_SQL} FROM live')
def _hit_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hits(hit_columns(live(items_view(spark, sf_dir)), True).select("id", "type", "by", "score", "title", "snippet"))


@check("thread_columns", f'{WITH} SELECT id, type, "by" AS author, time, url, score, title, text, descendants, parent, deleted, dead FROM items')
def _thread_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hits(thread_columns(items_view(spark, sf_dir)))


@check(
    "search_documents",
    f"""{WITH} SELECT id, md5(concat_ws(' ', title, "by", regexp_replace(text, '<[^>]+>', ' ', 'g'))) AS document FROM items""",
)
def _search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_view(spark, sf_dir).select("id", F.md5(search_document()).alias("document"))


@check("live_by_type", f"{WITH} SELECT type, count(*) AS n, count(score) AS scored, count(time) AS dated FROM live GROUP BY type")
def _live_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.count("*").alias("n"), F.count("score").alias("scored"), F.count("time").alias("dated")]
    return live(items_view(spark, sf_dir)).groupBy("type").agg(*aggs)


@check(
    "coerced_results",
    """SELECT event_id AS id, event_type AS type, CASE WHEN event_id % 3 = 0 THEN CAST(trunc(value) AS INTEGER) END AS score,
  CAST(user_id AS INTEGER) AS descendants, CASE WHEN user_id % 2 = 0 THEN user_id END AS parent FROM events""",
)
def _coerced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    events = table(spark, sf_dir, "events")
    raw = events.select(
        c("event_id").cast("string").alias("id"),
        c("event_type").alias("type"),
        F.when(c("event_id") % 3 == 0, c("value").cast("string")).otherwise("n/a").alias("score"),
        c("user_id").cast("string").alias("descendants"),
        F.when(c("user_id") % 2 == 0, c("user_id").cast("string")).otherwise("").alias("parent"),
    )
    return coerce_results(raw)


@check("corpus_size", f"{WITH} SELECT nullif(count(*), 0) AS n FROM items")
def _corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.corpus_size(items_view(spark, sf_dir))


@check("max_id", f"{WITH} SELECT coalesce(max(id), 0) AS max_id FROM items")
def _max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.max_id(items_view(spark, sf_dir))


_PROFILE = [
    ("id", "bigint"), ("deleted", "boolean"), ("type", "string"), ("by", "string"), ("time", "timestamp_ntz"), ("text", "string"),
    ("dead", "boolean"), ("parent", "bigint"), ("poll", "bigint"), ("kids", "array<bigint>"), ("url", "string"),
    ("score", "int"), ("title", "string"), ("parts", "array<bigint>"), ("descendants", "int"),
]


@check(
    "profile",
    WITH
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column, '{kind}' AS type, count(*) AS rows, count(*) - count(\"{name}\") AS nulls FROM items"
        for i, (name, kind) in enumerate(_PROFILE)
    ),
)
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(items_view(spark, sf_dir))


REQUESTS_SQL = """
raw AS (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '   ' ELSE '  ' || event_type || E' q\\t' END AS q,
         CASE event_id % 7 WHEN 0 THEN 'story' WHEN 1 THEN 'comment' WHEN 2 THEN 'job' WHEN 3 THEN 'all' WHEN 4 THEN 'STORY' WHEN 5 THEN '' ELSE event_type END AS type,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE ' u' || user_id || ' ' END AS "by",
         CASE event_id % 6 WHEN 0 THEN '24h' WHEN 1 THEN 'week' WHEN 2 THEN 'month' WHEN 3 THEN 'year' WHEN 4 THEN 'all' ELSE 'decade' END AS since,
         CASE event_id % 5 WHEN 0 THEN 'relevance' WHEN 1 THEN 'date' WHEN 2 THEN 'score' WHEN 3 THEN 'by' END AS sort,
         CASE event_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '-1' WHEN 2 THEN 'x' WHEN 3 THEN '1.5' WHEN 4 THEN CAST(user_id AS VARCHAR) END AS page
  FROM events)
"""


@check(
    "request_rows",
    f"""WITH {REQUESTS_SQL}
SELECT event_id, nullif(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), '') AS q,
       CASE WHEN type IN ('story', 'comment', 'poll', 'pollopt', 'job', 'all') THEN type ELSE 'story' END AS type,
       nullif(trim("by"), '') AS author, CASE WHEN since IN ('24h', 'week', 'month', 'year', 'all') THEN since ELSE 'all' END AS since,
       CASE WHEN sort IN ('relevance', 'date', 'score') THEN sort END AS sort,
       greatest(1, coalesce(CAST(trunc(TRY_CAST(page AS DOUBLE)) AS BIGINT), 1)) AS page
FROM raw""",
)
def _request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind, window, order, page = c("event_id") % 7, c("event_id") % 6, c("event_id") % 5, c("event_id") % 6
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(c("event_id") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), "event_type", F.lit(" q\t"))).alias("q"),
        F.when(kind == 0, "story").when(kind == 1, "comment").when(kind == 2, "job").when(kind == 3, "all").when(kind == 4, "STORY")
        .when(kind == 5, "").otherwise(c("event_type")).alias("type"),
        F.when(c("event_id") % 3 != 0, F.concat(F.lit(" u"), c("user_id").cast("string"), F.lit(" "))).alias("by"),
        F.when(window == 0, "24h").when(window == 1, "week").when(window == 2, "month").when(window == 3, "year").when(window == 4, "all")
        .otherwise("decade").alias("since"),
        F.when(order == 0, "relevance").when(order == 1, "date").when(order == 2, "score").when(order == 3, "by").alias("sort"),
        F.when(page == 0, "0").when(page == 1, "-1").when(page == 2, "x").when(page == 3, "1.5").when(page == 4, c("user_id").cast("string")).alias("page"),
    )
    return as_hits(normalise_requests(raw))


def _strip_sql(col: str) -> str:
    out = f"coalesce({col}, '')"
    rules = [("<p>", "E'\\n\\n'"), ("<i>", "''"), ("</i>", "''"), ("<pre><code>", "E'\\n'"), ("</code></pre>", "E'\\n'")]
    for pattern, replacement in rules:
        out = f"regexp_replace({out}, '{pattern}', {replacement}, 'gi')"
    out = f"""regexp_replace({out}, '<a [^>]*href="([^"]+)"[^>]*>', '\\1 ', 'gi')"""
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#x2F;", "/")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


_BLANK = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _stripped(source: str, col: str) -> str:
    return f"""
tagless AS (SELECT *, {_strip_sql(col)} AS t FROM {source}),
decoded AS (
  SELECT *, CASE WHEN contains(t, '&#') THEN array_to_string(list_transform(
      list_zip(string_split_regex(t, '&#[0-9]+;'), regexp_extract_all(t, '&#([0-9]+);', 1)),
      lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN TRY_CAST(x[2] AS BIGINT) BETWEEN 0 AND 55295 OR TRY_CAST(x[2] AS BIGINT) BETWEEN 57344 AND 1114111
        THEN chr(CAST(x[2] AS INTEGER)) ELSE chr(65533) END), '') ELSE t END AS u FROM tagless),
stripped AS (
  SELECT *, regexp_replace(regexp_replace(u, '\\n{{3,}}', E'\\n\\n', 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS body FROM decoded)
"""


@check("strip_html_pages", f"WITH {_stripped('pages', 'html')} SELECT page_id, body FROM stripped")
def _strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", display.strip_html(F.col("html")).alias("body"))


@check("strip_html_items", f"{WITH}, {_stripped('items', 'text')} SELECT id, body FROM stripped")
def _strip_html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_view(spark, sf_dir).select("id", display.strip_html(F.col("text")).alias("body"))


@check(
    "heading",
    f"""{WITH}, {_stripped("items", "text")}
SELECT id, coalesce(nullif(title, ''), nullif(left(body, 160), ''), '(' || type || ')') AS heading FROM stripped""",
)
def _heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_view(spark, sf_dir).select("id", display.heading(F.col("type"), F.col("title"), F.col("text")).alias("heading"))


HOST_SQL = "regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), ''), '^www\\.', '')"


@check("url_host", f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def _url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", display.host(F.col("url")).alias("host"))


@check("pages_per_host", f"SELECT {HOST_SQL} AS host, count(*) AS pages FROM pages GROUP BY 1")
def _pages_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(display.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def _ago_sql(source: str) -> str:
    return f"""
s1 AS (SELECT *, greatest(0, CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(time)) / 1e6 + 0.5) AS BIGINT)) AS s FROM {source}),
s2 AS (SELECT *, CAST(floor(s / 60 + 0.5) AS BIGINT) AS m FROM s1),
s3 AS (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM s2),
s4 AS (SELECT *, CAST(floor(h / 24 + 0.5) AS BIGINT) AS d FROM s3),
s5 AS (SELECT *, CAST(floor(d / 30 + 0.5) AS BIGINT) AS mo FROM s4),
aged AS (SELECT *, CASE WHEN time IS NULL THEN '' WHEN s < 60 THEN s || 's ago' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago'
     WHEN d < 30 THEN d || 'd ago' WHEN mo < 12 THEN mo || 'mo ago' ELSE CAST(floor(d / 365 + 0.5) AS BIGINT) || 'y ago' END AS ago FROM s5)
"""


@check("time_ago", f"{WITH}, {_ago_sql('items')} SELECT id, ago FROM aged")
def _time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_view(spark, sf_dir).select("id", display.time_ago(F.col("time"), F.lit(AS_OF)).alias("ago"))


@check("event_ages", f"WITH ev AS (SELECT *, ts AS time FROM events), {_ago_sql('ev')} SELECT ago, count(*) AS n FROM aged GROUP BY ago")
def _event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(display.time_ago(F.col("ts"), F.lit(AS_OF)).alias("ago")).agg(F.count("*").alias("n"))


@check(
    "byline",
    f"""{WITH}, {_ago_sql("items")}
SELECT id, concat_ws(' ', CASE WHEN type IN ('story', 'job', 'poll') AND score IS NOT NULL THEN score || ' points' END,
       CASE WHEN "by" <> '' THEN 'by ' || "by" END, nullif(ago, ''),
       CASE WHEN type IN ('story', 'poll') THEN '| ' || coalesce(descendants, 0) || ' comments' END) AS byline FROM aged""",
)
def _byline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    line = display.byline(c("type"), c("by"), c("time"), c("score"), c("descendants"), F.lit(AS_OF), c("type").isin("story", "poll"))
    return items_view(spark, sf_dir).select("id", line.alias("byline"))


@check(
    "row_kind",
    f"""{WITH} SELECT id, coalesce(title, '') = '' AND type IN ('comment', 'pollopt') AS is_comment,
  coalesce(nullif(url, ''), '/item/' || id) AS link FROM items""",
)
def _row_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = display.is_comment_row(c("type"), c("title")).alias("is_comment")
    return items_view(spark, sf_dir).select("id", kind, display.item_link(c("id"), c("url")).alias("link"))


COMPACT_SQL = """CASE WHEN n >= 1000000 THEN '~' || CAST(floor(n / 1000000 + 0.5) AS BIGINT) || 'M'
  WHEN n >= 1000 THEN '~' || CAST(floor(n / 1000 + 0.5) AS BIGINT) || 'K' ELSE '~' || n END"""
ROUNDED_SQL = "CASE WHEN n <= 0 THEN 0.0 ELSE floor(n / pow(10.0, len(CAST(n AS VARCHAR)) - 2) + 0.5) * pow(10.0, len(CAST(n AS VARCHAR)) - 2) END"
NUMBERS_SQL = "numbers AS (SELECT l_orderkey AS k, l_linenumber AS l, CAST(l_orderkey * l_orderkey % 30000001 AS BIGINT) AS n FROM lineitem)"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(key.alias("k"), F.col("l_linenumber").alias("l"), (key * key % 30000001).alias("n"))


@check("format_compact", f"WITH {NUMBERS_SQL} SELECT k, l, n, {COMPACT_SQL} AS label FROM numbers")
def _format_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).withColumn("label", display.format_compact(F.col("n")))


@check("round_significant", f"WITH {NUMBERS_SQL} SELECT k, l, n, CAST({ROUNDED_SQL} AS BIGINT) AS rounded FROM numbers")
def _round_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).withColumn("rounded", display.round_significant(F.col("n")).cast("bigint"))


@check(
    "format_matches",
    f"""WITH {NUMBERS_SQL} SELECT k, l, n, CASE WHEN n < 1000 THEN format('{{:,}}', n) || CASE WHEN n = 1 THEN ' result' ELSE ' results' END
  WHEN n % 5 = 0 THEN 'many results' ELSE '~' || format('{{:,}}', CAST({ROUNDED_SQL} AS BIGINT)) || ' results' END AS label FROM numbers""",
)
def _format_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    label = display.format_matches(F.when(n < 1000, n), n >= 1000, F.when(n % 5 != 0, n))
    return _numbers(spark, sf_dir).withColumn("label", label)
