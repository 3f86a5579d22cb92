"""Session set-up, the shared work folder, and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_dirs: dict[str, str] = {}


def local_session(name: str = "forumlake", cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, whose
    executors share the driver's disk, may fall back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="forumlake-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/forumlake/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Total size of the files under ``paths``, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes whenever a file under ``paths`` is added, removed or rewritten."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    row = files.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h"),
    ).first()
    return f"{row['n']}-{row['h']}"


def spread(df: DataFrame, size: int) -> DataFrame:
    """Give every core a share when the input is too small to be split by the scan.

    Inputs of at least one scan split or one file per core are left as they are, so nothing
    large is ever shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores * 4) if size < cores * split and len(df.inputFiles()) < cores else df


def _bytes(text: str) -> int:
    text = text.lower().strip().removesuffix("b")
    for unit, factor in (("k", 2**10), ("m", 2**20), ("g", 2**30)):
        if text.endswith(unit):
            return int(text[:-1]) * factor
    return int(text)
