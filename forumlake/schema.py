"""Table shapes and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Item types, ranked scopes, page and cap sizes.
ITEM_TYPES = ("story", "comment", "poll", "pollopt", "job")
RANKED_TYPES = ("story", "comment", "job")
SCORED_TYPES = ("story", "job", "poll")
SINCE = ("24h", "week", "month", "year", "all")
SORTS = ("relevance", "date", "score")
PAGE_SIZE = 30
TYPEAHEAD_SIZE = 8
REFRESH_WINDOW = 2_000
SYNC_BATCH = 10_000
SYNC_GROUP = SYNC_BATCH

ID_BUCKET_WIDTH = 1_000_000

_LONGS = T.ArrayType(T.LongType())

ITEMS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("by", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("dead", T.BooleanType(), False),
        T.StructField("parent", T.LongType()),
        T.StructField("poll", T.LongType()),
        T.StructField("kids", _LONGS, False),
        T.StructField("url", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("parts", _LONGS, False),
        T.StructField("descendants", T.IntegerType()),
    ]
)

ITEM_COLUMNS = ITEMS.fieldNames()

# Items as the API hands them over: everything but the id may be absent.
FEED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("type", T.StringType()),
        T.StructField("by", T.StringType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("dead", T.BooleanType()),
        T.StructField("parent", T.LongType()),
        T.StructField("poll", T.LongType()),
        T.StructField("kids", _LONGS),
        T.StructField("url", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("parts", _LONGS),
        T.StructField("descendants", T.LongType()),
    ]
)

CURSORS = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("last_id", T.LongType(), False),
        T.StructField("synced", T.LongType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("fetched", T.BooleanType(), False),
        T.StructField("loaded", T.BooleanType(), False),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("arrived", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("least", T.LongType()),
        T.StructField("greatest", T.LongType()),
    ]
)
