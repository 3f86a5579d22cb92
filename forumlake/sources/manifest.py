"""A table of the feed's files and the ids they hold, so that a run opens only the files it needs."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlake.operators.joins import fits_broadcast
from forumlake.operators.merge import newest
from forumlake.schema import MANIFEST
from forumlake.sources.feed import read_feed

NAMED_FILES = 10_000  # as many files are named in a read; beyond, the whole folder is read
LEVELS = 63


@dataclass(frozen=True)
class FeedFiles:
    """The feed in ``folder`` (JSON files) with its manifest, a table that only grows."""

    spark: SparkSession
    folder: str
    manifest: str

    def lying(self) -> DataFrame:
        """(path, arrived, length) of the files in the folder; their content is not read."""
        files = self.spark.read.format("binaryFile").load(self.folder)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("arrived"), "length")

    def known(self) -> DataFrame:
        """(path, arrived, length, least, greatest): the last state recorded of every file. A file without ids has no least one."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(self.manifest)
        except AnalysisException:  # nothing recorded yet
            return self.spark.createDataFrame([], MANIFEST)
        return newest(rows.withColumnRenamed("path", "id"), F.struct("arrived", "length")).withColumnRenamed("id", "path")

    def refresh(self) -> None:
        """Records the files that are new or rewritten since the last time. Only those
        are read; a run that dies before its rows are written is repeated by the next."""
        lying = self.lying()
        fresh = lying.join(self.known().select("path", "arrived", "length"), ["path", "arrived", "length"], "left_anti")
        paths = _names(fresh)
        if not paths:
            return
        rows = self._read(paths).select("path", "id")
        if paths is BEYOND:
            rows = rows.join(fresh.select("path"), "path", "left_semi")
        ends = rows.groupBy("path").agg(F.min("id").alias("least"), F.max("id").alias("greatest"))
        fresh.join(ends, "path", "left").select(*MANIFEST.fieldNames()).write.mode("append").parquet(self.manifest)

    def needed(self, start: int, end: int, ids: DataFrame | None = None) -> DataFrame:
        """(path) of the files whose ids reach into ``start`` to ``end`` or around one of the distinct ``ids``.

        A file's span lies in at most two cells of the smallest power of two that
        is as long, and an id in one cell of every length, so single ids find
        their files by an equi-join, without an ids x files comparison.
        """
        spans = self.known().join(self.lying().select("path", "arrived", "length"), ["path", "arrived", "length"], "left_semi").filter("least IS NOT NULL")
        inside = spans.filter((F.col("least") <= end) & (F.col("greatest") >= start)).select("path")
        if ids is None:
            return inside
        level = F.when(F.col("greatest") > F.col("least"), F.length(F.bin(F.col("greatest") - F.col("least")))).otherwise(0)
        cut = spans.withColumn("level", level)
        cut = cut.withColumn("cell", F.explode(F.array_distinct(F.array(_cell("least"), _cell("greatest")))))
        cells = ids.select(F.col("id").alias("listed"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
        cells = cells.withColumn("cell", _cell("listed"))
        cells = cells.join(F.broadcast(cut.select("level").distinct()), "level", "left_semi")  # 64 levels at most
        cells = F.broadcast(cells) if fits_broadcast(cells) else cells
        around = cut.join(cells, (cut["level"] == cells["level"]) & (cut["cell"] == cells["cell"]) & cells["listed"].between(cut["least"], cut["greatest"]), "left_semi")
        return inside.union(around.select("path")).distinct()

    def rows(self, start: int, end: int, ids: DataFrame | None = None) -> DataFrame:
        """The rows of the files needed, as :func:`read_feed` gives them; other ids of these files come along."""
        paths = _names(self.needed(start, end, ids))
        return self._read(paths) if paths else read_feed(self.spark, self.folder).limit(0)

    def _read(self, paths: list[str]) -> DataFrame:
        return read_feed(self.spark, self.folder if paths is BEYOND else paths)


BEYOND = ["more files than are named"]


def _names(files: DataFrame) -> list[str]:
    """The paths as they are read, or ``BEYOND`` if they are too many to be named."""
    found = [unquote(row["path"]) for row in files.select("path").limit(NAMED_FILES + 1).collect()]
    return BEYOND if len(found) > NAMED_FILES else found


def _cell(id_: str) -> Column:
    return F.expr(f"shiftright({id_}, level)")
