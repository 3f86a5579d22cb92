from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forumlake.functions import cleaning
from forumlake.operators.clean import check_items, clean_feed, split_dump
from forumlake.schema import FEED, ITEM_COLUMNS


def values(spark, texts, rule):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, c string").select("i", rule(F.col("c")).alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_strip_nul(spark):
    assert values(spark, ["a\0b", "", None, "\0"], cleaning.strip_nul) == ["ab", "", None, ""]


def test_blank_to_null(spark):
    assert values(spark, ["a", "", None, "\0", " "], cleaning.blank_to_null) == ["a", None, None, None, " "]


def test_to_bool(spark):
    assert values(spark, ["1", "TRUE", "t", "T", "0", "yes", "", None], cleaning.to_bool) == [True] * 4 + [False] * 4


def test_to_long_array(spark):
    texts = ["[1,2]", "{1, 2}", "[]", "{}", "null", "\\N", "", None, "[1,x,3]", " [7] ", "5", "[1.5,2]", "[-4]", "[99999999999999999999]"]
    assert values(spark, texts, cleaning.to_long_array) == [[1, 2], [1, 2], [], [], [], [], [], [], [1, 3], [7], [5], [2], [-4], []]


def test_to_long_and_zero(spark):
    texts = ["12", "1.7", "-1.7", "0", "", "null", "\\N", "x", None, "1e3", "Infinity", "1d", " 8 "]
    assert values(spark, texts, cleaning.to_long) == [12, 1, -1, 0, None, None, None, None, None, 1000, None, None, 8]
    assert values(spark, texts, lambda c: cleaning.to_long(c, zero_as_null=True))[3] is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_to_ts_is_utc_in_any_session_zone(spark, zone):
    texts = [
        "1171909200", "1171909200000", "900000000", "2007-02-19 18:20:00", "2007-02-19T18:20:00Z", "2007-02-19T19:20:00+01:00",
        "2007-02-19", "x", "", "\\N", None, "0", "-5", "2007-13-45 00:00:00",
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = values(spark, texts, lambda c: F.unix_seconds(cleaning.to_ts(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    seen = 1171909200
    assert got == [seen, seen, 900000000, seen, seen, seen, 1171843200] + [None] * 7


def raw(**given):
    base = dict.fromkeys(ITEM_COLUMNS)
    return tuple({**base, "type": "story", **given}[c] for c in ITEM_COLUMNS)


def test_split_dump_keeps_every_row_somewhere(spark):
    rows = [
        raw(id="1", type="Story", by="", score="1.7", parent="0", text="a\0b", dead="t"),
        raw(id="x"),
        raw(id=None),
        raw(id="2", type="thing"),
        raw(id="3", type=None),
        raw(id="4", score="99999999999"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ITEM_COLUMNS))
    good, rejected = split_dump(df)
    kept = good.collect()
    assert [(r["id"], r["type"], r["by"], r["score"], r["parent"], r["text"], r["dead"], r["kids"]) for r in kept] == [
        (1, "story", None, 1, None, "ab", True, [])
    ]
    reasons = sorted((r["reject_reason"], r["id"]) for r in rejected.select("reject_reason", F.coalesce("id", F.lit("-")).alias("id")).collect())
    assert reasons == [("no numeric id", "-"), ("no numeric id", "x"), ("score out of range", "4"), ("unknown type", "2"), ("unknown type", "3")]


def test_clean_feed_defaults(spark):
    row = dict.fromkeys(FEED.names)
    row.update(id=5, type="comment", time=1171909200.0, kids=[1, None, 2])
    other = {**row, "id": 6, "type": "Comment"}
    df = spark.createDataFrame([tuple(r[n] for n in FEED.names) for r in (row, other)], FEED)
    got = clean_feed(df).collect()
    assert len(got) == 1  # the type must be spelled exactly
    assert (got[0]["deleted"], got[0]["dead"], got[0]["kids"], got[0]["parts"]) == (False, False, [1, 2], [])
    assert got[0]["time"] == datetime(2007, 2, 19, 18, 20)


def test_check_items(spark):
    schema = "id bigint, type string, deleted boolean"
    dirty = spark.createDataFrame([(1, "story", False), (1, "story", False), (2, "x", None)], schema)
    found = sorted((r["rule"], r["id"], r["n"]) for r in check_items(dirty).collect())
    assert found == [("deleted is null", 2, 1), ("repeated id", 1, 2), ("unknown type", 2, 1)]
    assert [r["rule"] for r in check_items(dirty.limit(0)).collect()] == ["empty table"]
