"""API items and ranked id lists, as files of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.schema import FEED


def read_feed(spark: SparkSession, path: str | list[str], streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """One item per line; a line of ``null`` (a missing item) yields no row.

    ``arrived`` and ``file`` order the versions of an item: feed rows carry no
    version of their own, so the file written last wins. ``path`` finds the file again.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.schema(FEED).option("mode", "PERMISSIVE").json(path)
    about = {"arrived": "file_modification_time", "file": "file_name", "path": "file_path"}
    rows = rows.select("*", *[F.col(f"_metadata.{field}").alias(name) for name, field in about.items()])
    return rows.filter(F.col("id").isNotNull() | F.col("type").isNotNull())


def read_story_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(list, id): each file is one JSON array of ids; other entries are dropped."""
    files = spark.read.option("wholetext", "true").text(paths)
    entries = F.from_json("value", "array<string>")
    rows = files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("list"), F.explode(entries).alias("entry"))
    return rows.select("list", F.col("entry").try_cast("bigint").alias("id")).filter("id IS NOT NULL")
