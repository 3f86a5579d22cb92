"""Raw dumps as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlake.schema import ITEM_COLUMNS

# Quotes are doubled inside quotes. A bare empty field is NULL and a quoted one
# '', which the reader tells apart only if the marker of NULL is not empty.
CSV_OPTIONS = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\\N", "mode": "PERMISSIVE"}
WRITE_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
BOM = "\ufeff"


def read_dump(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """The 15 item columns of dump files with a header line, all as text.

    Short rows end in NULLs, surplus fields are dropped, blank lines skipped,
    columns missing from the header are NULL. Fields may hold line breaks, and
    bare fields may hold quotes; so a file is read by one task, whatever its
    size, and a large dump should come as many files.
    """
    raw = spark.read.options(**CSV_OPTIONS).option("header", "true").option("multiLine", "true").csv(path)
    rows = _item_columns(raw, dict(zip(_names(raw.columns), raw.columns)))
    return rows if limit is None else rows.limit(limit)


def _names(header: list[str]) -> list[str]:
    names = [name.lstrip(BOM).strip().strip('"').lower() for name in header]
    missing = {"id", "type"} - set(names)
    if missing:
        raise ValueError(f"the dump header lacks {sorted(missing)}")
    return names


def _item_columns(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    def column(name: str) -> Column:
        return F.col(f"`{names[name]}`") if name in names else F.lit(None).cast("string")

    return raw.select([column(name).alias(name) for name in ITEM_COLUMNS])
