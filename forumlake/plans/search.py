"""Search pages: browse, prefix, full text; typeahead; pages of one author."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.functions.requests import SearchFilters, scope_of
from forumlake.operators import ordering
from forumlake.operators.filters import build_filter, by_author, has_prefix, is_live, live, of_type, since
from forumlake.operators.joins import BROADCAST_ROWS, rows_of
from forumlake.operators.match import Query, analyse_query, match
from forumlake.operators.projections import HIT, hit_columns
from forumlake.operators.rank import TermCounts
from forumlake.plans.access import Access
from forumlake.plans.index import SearchIndex
from forumlake.plans.lake import Lake
from forumlake.schema import PAGE_SIZE, TYPEAHEAD_SIZE
from forumlake.session import stage


def query_postings(index: SearchIndex, query: Query, counts: TermCounts, type_: str) -> DataFrame:
    """Live postings of the query's terms, as few as the statistics allow.

    Every match holds the rarest required term of one of the groups. Where these
    are rare enough for a broadcast, the postings of the frequent terms are cut
    to the rows holding them before anything is shuffled. Positions are read for
    the words and pairs that place a phrase and for nothing else.
    """
    placed = set(query.placed_terms(index.frequent))
    pairs, words = sorted(t for t in placed if " " in t), sorted(placed.intersection(query.terms))
    bare = [t for t in query.terms if t not in placed]
    parts = [index.postings(bare, type_).withColumn("positions", F.lit(None).cast("array<int>"))] if bare or not placed else []
    parts += [index.postings(words, type_)] if words else []
    parts += [index.postings(pairs, type_, "pairs")] if pairs else []
    posts = reduce(DataFrame.unionByName, parts).filter("live")
    anchors = query.anchors(counts.df)
    if anchors is None:
        return posts
    bound = sum(counts.df.get(t, 0) for t in anchors)
    if bound > BROADCAST_ROWS or bound * 4 > sum(counts.df.values()):
        return posts
    holding = index.postings(anchors, type_).filter("live").select("id")
    return posts.join(F.broadcast(holding), "id", "left_semi")


def text_matches(lake: Lake, query: Query, type_: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(id, bm25) of the live rows of a type that match an analysed query, with
    the sort keys asked for."""
    items = lake.items.withColumn("time", F.col("time").cast("timestamp"))
    if not query.groups:
        return items.select("id", F.lit(0.0).alias("bm25"), *keys).limit(0)
    all_rows = None
    if query.needs_all_rows:
        all_rows = items.filter(is_live() & of_type(type_)).select("id", *keys)
    index = lake.phrase_index if query.has_phrases else lake.index
    counts = index.counts(query.terms, scope_of(type_))
    posts = query_postings(index, query, counts, type_)
    return match(posts, query, counts.score(query.ranking_terms), all_rows, keys, index.frequent)


def matches(lake: Lake, f: SearchFilters, as_of: datetime, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every match of a search: (id, bm25) for full text, id alone otherwise,
    and the sort keys asked for. Only an author is looked up in the items."""
    if not f.is_full_text:
        return lake.items.filter(build_filter(f, as_of)).select("id", *keys)
    aged = f.since != "all"
    held = tuple(dict.fromkeys((*keys, "time"))) if aged else keys
    found = text_matches(lake, analyse_query(lake.spark, f.text, lake.index.config), f.type, held)
    if aged:
        found = found.filter(since(f.since, as_of))
    if f.by:
        kept = lake.items.filter(build_filter(f, as_of)).select("id")
        found = found.join(kept, "id", "left_semi")
    return found.select("id", "bm25", *keys)


def fetch(items: DataFrame, page_rows: DataFrame, with_snippet: bool, order: list[Column], page: int, *extra: str) -> DataFrame:
    """The wide columns of the rows of one page. Only ids and sort keys travel
    through ranking; the page, of a fixed size, is then broadcast to the items."""
    found = page_rows.select("id", *extra)
    wide = rows_of(items, stage(found, "page") if "id_bucket" in items.columns else found)
    return hit_columns(ordering.ranked(wide, order, page), with_snippet, *extra, "rank").orderBy("rank")


def order_keys(f: SearchFilters) -> tuple[str, ...]:
    return {"date": ("time",), "score": ("score", "time")}[f.order]


def page_ids(lake: Lake, f: SearchFilters, as_of: datetime) -> DataFrame:
    """All matches with their sort keys, not yet ordered."""
    if f.is_full_text:
        return matches(lake, f, as_of, () if f.order == "relevance" else order_keys(f))
    return lake.items.filter(build_filter(f, as_of)).select("id", *order_keys(f))


def browsed(lake: Lake, f: SearchFilters, as_of: datetime, ahead: int = 0) -> DataFrame | None:
    """Narrow rows of a search without full text up to the end of its page and
    ``ahead`` rows on, from the ordered access paths; None where those cannot serve."""
    if f.is_full_text or lake.access is None or not lake.access.serves(f):
        return None
    return lake.access.rows(f, as_of, ordering.offset_of(f.page) + PAGE_SIZE + ahead)


def search(lake: Lake, f: SearchFilters, as_of: datetime) -> DataFrame:
    """One page of results, numbered in ``rank``; relevance pages carry ``bm25``."""
    order = ordering.ORDERS[f.order]()
    narrow = browsed(lake, f, as_of)
    if narrow is not None:
        rows = ordering.page_of(narrow, order, f.page)
        if f.with_snippet:
            return fetch(lake.items, rows, True, order, f.page)
        bare = rows.select("*", F.lit(None).cast("string").alias("snippet"))
        return ordering.ranked(bare, order, f.page).select(*HIT, "snippet", "rank").orderBy("rank")
    if not f.is_full_text and not f.with_snippet:
        # No text to fetch late: the page comes out of one narrow pass.
        rows = ordering.page_of(hit_columns(lake.items.filter(build_filter(f, as_of)), False), order, f.page)
        return ordering.ranked(rows, order, f.page).orderBy("rank")
    rows = ordering.page_of(page_ids(lake, f, as_of), order, f.page)
    extra = ("bm25",) if f.order == "relevance" else ()
    return fetch(lake.items, rows, f.with_snippet, order, f.page, *extra)


def search_flags(lake: Lake, f: SearchFilters, as_of: datetime) -> DataFrame:
    found = browsed(lake, f, as_of, ahead=1)
    return ordering.page_flags(matches(lake, f, as_of) if found is None else found, f.page)


def typeahead(lake: Lake, term: str) -> DataFrame:
    """Up to eight suggestions while typing: newest rows with the prefix, or the
    best live stories holding every word."""
    if not term:
        return hit_columns(lake.items.limit(0), False)
    if len(term) <= 2:
        order = ordering.newest()
        if lake.access is not None and len(term.lower()) <= 2:
            rows = lake.access.rows_with_prefix(term, TYPEAHEAD_SIZE)
            first = rows.select("*", F.lit(None).cast("string").alias("snippet")).orderBy(*order).limit(TYPEAHEAD_SIZE)
            return ordering.ranked(first, order, 1).select(*HIT, "snippet", "rank").orderBy("rank")
        rows = live(lake.items).filter(has_prefix(term))
        return hit_columns(ordering.ranked(rows.orderBy(*order).limit(TYPEAHEAD_SIZE), order, 1), False, "rank").orderBy("rank")
    order = ordering.most_relevant()
    query = analyse_query(lake.spark, term, lake.index.config, operators=False)
    rows = text_matches(lake, query, "story").orderBy(*order).limit(TYPEAHEAD_SIZE)
    return fetch(lake.items, rows, False, order, 1, "bm25")


def user_items(items: DataFrame, author: str, page: int = 1, access: Access | None = None) -> DataFrame:
    """One page of an author's rows, from the ordered access paths where there are some."""
    order = ordering.newest()
    if access is None:
        ids = live(items).filter(by_author(author)).select("id", "time")
    else:
        ids = access.rows_of_author(author, ordering.offset_of(page) + PAGE_SIZE).select("id", "time")
    return fetch(items, ordering.page_of(ids, order, page), True, order, page)
