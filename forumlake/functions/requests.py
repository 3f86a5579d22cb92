"""Search requests: one as a dataclass, a table of them as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from forumlake.functions.cleaning import NUMBER, to_number, trim_blanks
from forumlake.schema import ITEM_TYPES, RANKED_TYPES, SINCE, SORTS

# Days in each age window.
SINCE_DAYS = {"24h": 1, "week": 7, "month": 30, "year": 365}


@dataclass(frozen=True)
class SearchFilters:
    """One search. Unknown types, ages and sorts fall back to the defaults."""

    q: str | None = None
    type: str = "story"
    by: str | None = None
    since: str = "all"
    sort: str | None = None
    page: int = 1

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> SearchFilters:
        def text(key: str) -> str | None:
            value = params.get(key)
            return (value.strip() or None) if isinstance(value, str) else None

        def one_of(key: str, allowed: tuple[str, ...], default: str | None) -> str | None:
            value = params.get(key)
            return value if value in allowed else default

        page = page_of_text(params.get("page"))
        return cls(
            q=text("q"),
            type=one_of("type", (*ITEM_TYPES, "all"), "story"),
            by=text("by"),
            since=one_of("since", SINCE, "all"),
            sort=one_of("sort", SORTS, None),
            page=page,
        )

    @property
    def text(self) -> str:
        return self.q or ""

    @property
    def is_full_text(self) -> bool:
        return len(self.text) > 2

    @property
    def scope(self) -> str:
        return scope_of(self.type)

    @property
    def with_snippet(self) -> bool:
        return self.type in ("comment", "pollopt") or (self.type == "all" and bool(self.q))

    @property
    def order(self) -> str:
        """The sort in force: relevance needs a full-text query to rank by."""
        wanted = self.sort or ("relevance" if self.q else "date")
        return "date" if wanted == "relevance" and not self.is_full_text else wanted

    def cutoff(self, as_of: datetime) -> datetime | None:
        return as_of - timedelta(days=SINCE_DAYS[self.since]) if self.since in SINCE_DAYS else None


def page_of_text(text: str | None) -> int:
    """A page number by the rule of ``normalise_requests``: numbers as ``to_number`` knows them, cut to whole, from 1."""
    if not isinstance(text, str) or not re.match(NUMBER, text):
        return 1
    number = float(text)
    return max(1, int(number)) if abs(number) < 2**63 else 1


def scope_of(type_: str) -> str:
    """The corpus a type is ranked in: its own, or the one of every row."""
    return type_ if type_ in RANKED_TYPES else "all"


# The saved searches of the masthead.
SAVED_SEARCHES = {
    "new": SearchFilters(sort="date"),
    "comments": SearchFilters(type="comment"),
    "top": SearchFilters(type="story", sort="score"),
    "jobs": SearchFilters(type="job"),
}


def normalise_requests(requests: DataFrame) -> DataFrame:
    """The rules of ``SearchFilters.from_params`` over a table of raw requests
    with string columns q, type, by, since, sort and page."""

    def text(name: str) -> Column:
        return F.nullif(trim_blanks(F.col(name)), F.lit(""))

    def one_of(name: str, allowed: tuple[str, ...], default: str | None) -> Column:
        return F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(F.lit(default).cast("string"))

    page = to_number(F.col("page")).try_cast("bigint")
    return requests.withColumns(
        {
            "q": text("q"),
            "type": one_of("type", (*ITEM_TYPES, "all"), "story"),
            "by": text("by"),
            "since": one_of("since", SINCE, "all"),
            "sort": one_of("sort", SORTS, None),
            "page": F.greatest(F.lit(1), F.coalesce(page, F.lit(1))),
        }
    )
