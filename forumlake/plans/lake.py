"""The items table together with its search index and its parent-to-child edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.corpus import SOURCES, items_view
from forumlake.operators.threads import edges_of
from forumlake.operators.tour import ThreadOrder, build_order, open_order
from forumlake.plans.access import Access, build_access, open_access
from forumlake.plans.index import SearchIndex, add_pairs, build_index, open_index
from forumlake.schema import ID_BUCKET_WIDTH
from forumlake.session import fingerprint, fresh_path, input_bytes
from forumlake.sources.items import read_items, write_items

EDGES = "parent bigint, id bigint, bucket bigint"

SAMPLE_RANGE_ROWS = 2_000  # the driver's tables are small; their layouts still have several ranges

_built: dict[tuple, object] = {}


class Lake:
    """``index``, ``edges``, ``order`` and ``access`` are made when they are first
    asked for, and so is ``phrase_index``, the index with its word pairs, where they are not
    written with it. Without ``access`` browsing scans the items."""

    def __init__(
        self,
        items: DataFrame,
        index: Callable[[], SearchIndex],
        edges: Callable[[], DataFrame],
        order: Callable[[], ThreadOrder] | None = None,
        access: Callable[[], Access] | None = None,
        phrase_index: Callable[[], SearchIndex] | None = None,
    ) -> None:
        self.items = items
        self._index = index
        self._edges = edges
        self._order = order
        self._access = access
        self._phrase_index = phrase_index

    @cached_property
    def index(self) -> SearchIndex:
        return self._index()

    @cached_property
    def phrase_index(self) -> SearchIndex:
        return self.index if self._phrase_index is None else self._phrase_index()

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges()

    @cached_property
    def order(self) -> ThreadOrder:
        if self._order is None:
            raise ValueError("this lake keeps no thread order")
        return self._order()

    @cached_property
    def access(self) -> Access | None:
        return self._access() if self._access is not None else None

    @property
    def spark(self) -> SparkSession:
        return self.items.sparkSession


def build_edges(items: DataFrame, path: str) -> DataFrame:
    """Writes the edges by bucket of the parent, sorted by parent. A parent with
    very many children is cut into several files by the rebalance."""
    edges = edges_of(items).withColumn("bucket", F.floor(F.col("parent") / ID_BUCKET_WIDTH).cast("bigint"))
    edges.hint("rebalance", "bucket").sortWithinPartitions("bucket", "parent", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return read_edges(items.sparkSession, path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(path)


def write_lake(items: DataFrame, path: str, size: int, config: str = "english") -> Lake:
    """Stores items, index, edges, thread order and ordered access paths under one folder. ``size`` is the items'
    size in bytes."""
    spark = items.sparkSession
    write_items(items, f"{path}/items")
    stored = read_items(spark, f"{path}/items")
    add_pairs(build_index(stored, f"{path}/index", size, config), stored, size)
    build_edges(stored, f"{path}/edges")
    build_order(stored, f"{path}/order")
    build_access(stored, f"{path}/access")
    return open_lake(spark, path, ordered=True)


def open_lake(spark: SparkSession, path: str, ordered: bool = False) -> Lake:
    """A stored lake as it is now. ``ordered`` browses by the access paths, which
    show what was recorded in them: say so where every update is."""
    items = read_items(spark, f"{path}/items", with_bucket=True)
    return Lake(
        items,
        lambda: open_index(spark, f"{path}/index"),
        lambda: read_edges(spark, f"{path}/edges"),
        lambda: open_order(spark, f"{path}/order"),
        (lambda: open_access(spark, f"{path}/access")) if ordered else None,
    )


def source_paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in SOURCES]


def lake_of(spark: SparkSession, sf_dir: str, config: str = "english") -> Lake:
    """The lake over the driver's tables. Index, word pairs, edges and order are built once per
    session, when a query first asks for them, and again whenever one of the source files has changed."""
    items = items_view(spark, sf_dir)
    paths = source_paths(sf_dir)

    def indexed() -> SearchIndex:
        return build_index(items, fresh_path(spark, f"index-{config}"), input_bytes(spark, *paths), config)

    def once(kind: str, build: Callable[[], object]):
        def made():
            key = (spark.sparkContext.applicationId, kind, sf_dir, fingerprint(spark, *paths))
            if key not in _built:
                _built[key] = build()
            return _built[key]

        return made

    index = once(f"index {config}", indexed)
    return Lake(
        items,
        index,
        once("edges", lambda: build_edges(items, fresh_path(spark, "edges"))),
        once("order", lambda: build_order(items, fresh_path(spark, "order"))),
        once("access", lambda: build_access(items, fresh_path(spark, "access"), SAMPLE_RANGE_ROWS)),
        once(f"pairs {config}", lambda: add_pairs(index(), items, input_bytes(spark, *paths))),
    )
