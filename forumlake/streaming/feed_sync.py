"""The feed as a stream: every new file updates items and the search index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from forumlake.operators.clean import split_feed
from forumlake.operators.merge import add_bucket, merge_into, touched_buckets
from forumlake.plans.access import open_access
from forumlake.plans.index import add_generation, open_index
from forumlake.plans.sync import latest_versions
from forumlake.schema import ITEM_COLUMNS
from forumlake.session import stage
from forumlake.sources.feed import read_feed
from forumlake.sources.items import read_items


def apply_batch(items_path: str, index_path: str | None = None, rejected_path: str | None = None, stream: str = "feed", access_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch.

    The index generation is derived from the rows before the change, so it is
    committed first, under the stream's name and the batch's number; then the
    items are merged, which may be repeated freely. A batch replayed after a crash finds its generation
    committed and only repeats the merge.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, rejected = split_feed(latest_versions(batch))
        changes = stage(good, "changes")
        if rejected_path is not None:
            rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        if changes.isEmpty():
            return
        if index_path is not None:
            add_generation(open_index(spark, index_path), rows_before(spark, items_path, changes), changes, f"{stream}#{batch_id}")
        if access_path is not None:
            open_access(spark, access_path).record(changes, batch_id)
        merge_into(items_path, changes)

    return apply


def rows_before(spark: SparkSession, items_path: str, changes: DataFrame) -> DataFrame:
    """The stored rows that ``changes`` will replace, from the touched buckets."""
    stored = touched_buckets(read_items(spark, items_path, with_bucket=True), add_bucket(changes))
    return stage(stored.join(changes.select("id"), "id", "left_semi").drop("id_bucket"), "before")


def sync_stream(
    spark: SparkSession,
    feed_path: str,
    items_path: str,
    checkpoint: str,
    index_path: str | None = None,
    rejected_path: str | None = None,
    files_per_trigger: int | None = None,
    access_path: str | None = None,
    horizon: str | None = None,
) -> StreamingQuery:
    """Works off all files present, in batches of ``files_per_trigger``, and
    stops. Started again it goes on with the files that are new since. A stream
    is known to the index by its checkpoint. One stream may record its batches in
    the access paths, as these go by the batch's number.

    With a ``horizon`` (a time span, as "7 days") files may arrive in any order
    within it: see :func:`winning_versions`. Without one the file worked off last wins."""
    feed = read_feed(spark, feed_path, streaming=True, files_per_trigger=files_per_trigger)
    work = apply_batch(items_path, index_path, rejected_path, checkpoint, access_path)
    if horizon is not None:
        feed, work = winning_versions(feed, horizon), fetch_winners(work)
    return feed.writeStream.foreachBatch(work).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


WINNERS = "path string, content bigint"
SEEN = "at bigint, file string, content bigint"


def content() -> Column:
    return F.xxhash64(*ITEM_COLUMNS)


def winning_versions(feed: DataFrame, horizon: str) -> DataFrame:
    """(path, content) of the rows that are newer than every version of their
    id so far, wherever in the stream those came.

    The state holds the newest version's time, file and content hash of each id,
    no texts, and forgets an id that had none for the length of the ``horizon``.
    Files older than that, against the newest file seen, are left out whole: an
    old version could no longer be told from a new one.
    """
    rows = feed.select("id", "arrived", F.unix_micros("arrived").alias("at"), "file", "path", content().alias("content"))
    kept = rows.sparkSession.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {horizon}")) / 1000).cast("bigint")).first()[0]

    def newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get if state.exists else None
        best, where = seen, None
        for frame in frames:
            for at, file, path, found in frame[["at", "file", "path", "content"]].itertuples(index=False):
                version = (int(at), file, int(found))
                if best is None or version > best:
                    best, where = version, path
        if where is not None:
            state.update(best)
            yield pd.DataFrame({"path": [where], "content": [best[2]]})
        state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + kept)

    watched = rows.withWatermark("arrived", horizon).groupBy("id")
    return watched.applyInPandasWithState(newer, WINNERS, SEEN, "update", GroupStateTimeout.EventTimeTimeout)


def fetch_winners(work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Reads the rows that :func:`winning_versions` names, out of the files of the
    micro-batch, for the ``work`` on them."""

    def apply(winners: DataFrame, batch_id: int) -> None:
        spark = winners.sparkSession
        won = stage(winners.distinct(), "winners")
        files = [unquote(row["path"]) for row in won.select("path").distinct().collect()]  # files of one batch
        if files:
            rows = read_feed(spark, files).withColumn("content", content())
            work(rows.join(won.select("path", "content"), ["path", "content"], "left_semi"), batch_id)

    return apply
