"""Column rules of ingest: raw text to typed values, bad values to NULL.

Every rule is total: it never raises, whatever the text (ANSI mode is on).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Spellings of true, of an absent value, and of a number.
TRUE_WORDS = ("1", "true", "t")
ABSENT_WORDS = ("", "null", "\\N")
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
WHOLE = r"^[+-]?[0-9]{1,19}$"
MAX_EPOCH_MILLIS = 8.64e15
BLANKS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip_nul(col: Column) -> Column:
    return F.translate(col, "\0", "")


def trim_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def blank_to_null(col: Column) -> Column:
    """Loaders disagree on '' and NULL for absent text; one table needs one of them."""
    return F.nullif(strip_nul(col), F.lit(""))


def to_bool(col: Column) -> Column:
    return F.coalesce(F.lower(col).isin(*TRUE_WORDS), F.lit(False))


def to_number(col: Column) -> Column:
    """Only text that looks like a number is cast: a failing cast is slow."""
    number = let(strip_nul(col), lambda text: F.when(text.rlike(NUMBER), text.try_cast("double")))
    return let(number, lambda n: F.when(F.abs(n) < F.lit(float("inf")), n))


def to_long(col: Column, zero_as_null: bool = False) -> Column:
    """A number cut towards zero; zero may stand for absent."""
    value = to_number(col).try_cast("bigint")
    return F.nullif(value, F.lit(0)) if zero_as_null else value


def to_int(col: Column, zero_as_null: bool = False) -> Column:
    return to_long(col, zero_as_null).try_cast("int")


def to_long_array(col: Column) -> Column:
    """``[1,2]`` or ``{1,2}`` as an array; what is no whole number is left out."""
    inner = F.regexp_replace(trim_blanks(strip_nul(col)), r"^\[?\{?|\}?\]?$", "")
    parts = F.filter(F.transform(F.split(inner, ","), trim_blanks), lambda part: part.rlike(WHOLE))
    longs = F.filter(F.transform(parts, lambda part: part.try_cast("bigint")), lambda n: n.isNotNull())
    return F.coalesce(longs, F.array().cast("array<bigint>"))


def to_ts(col: Column) -> Column:
    """Epoch milliseconds (above 1e12), epoch seconds, or ISO text; text without
    a zone is UTC whatever the session's zone."""
    return let(trim_blanks(strip_nul(col)), lambda text: let(to_number(text), lambda number: _instant(text, number)))


def _instant(text: Column, number: Column) -> Column:
    millis = F.when(number > 1e12, number).otherwise(number * 1000)
    epoch = F.when((millis > 0) & (millis <= MAX_EPOCH_MILLIS), F.timestamp_millis(millis.try_cast("bigint")))
    dated = F.when(F.length(text) <= 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    zoned = F.when(dated.rlike(r"\d:\d\d.*([zZ]|[+-]\d\d(:?\d\d)?)$"), dated).otherwise(F.concat(dated, F.lit("Z")))
    # Only text that starts like a date reaches the parser.
    iso = F.when(text.rlike(r"^\d{4}-\d"), zoned.try_cast("timestamp"))
    return F.when(number.isNotNull(), epoch).otherwise(iso)
