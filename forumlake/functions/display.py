"""Display columns: stripped text, hosts, ages, headings and count labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from forumlake.functions.cleaning import let, trim_blanks
from forumlake.functions.text import TAG
from forumlake.schema import SCORED_TYPES

# What each tag turns into, in this order, then named entities.
TAG_RULES = (
    (r"(?i)<p>", "\n\n"),
    (r"(?i)<i>", ""),
    (r"(?i)</i>", ""),
    (r"(?i)<pre><code>", "\n"),
    (r"(?i)</code></pre>", "\n"),
    (r'(?i)<a [^>]*href="([^"]+)"[^>]*>', "$1 "),
    (r"<[^>]+>", ""),
)
ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#x27;", "'"),
    ("&#x2F;", "/"),
)
NUMERIC_ENTITY = r"&#([0-9]+);"
SNIPPET_CHARS = 240
HEADING_CHARS = 160


def _half_up(col: Column) -> Column:
    return F.floor(col + 0.5)


def _character(digits: Column) -> Column:
    """The character of a code point; half pairs and numbers beyond the last have none."""
    number = digits.try_cast("bigint")
    code = F.when(number.between(0, 0xD7FF) | number.between(0xE000, 0x10FFFF), number).otherwise(F.lit(0xFFFD))
    # On its own, this one would be taken for a byte order mark.
    return F.when(code == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_numeric_entities(col: Column) -> Column:
    """``&#8364;`` becomes its character: the pieces between the entities are
    zipped with the decoded characters, all in one row."""
    pieces = F.split(col, NUMERIC_ENTITY, -1)
    units = F.regexp_extract_all(col, F.lit(NUMERIC_ENTITY), F.lit(1))
    joined = F.array_join(
        F.zip_with(pieces, units, lambda piece, unit: F.concat(piece, F.when(unit.isNull(), "").otherwise(_character(unit)))),
        "",
    )
    return F.when(col.contains("&#"), joined).otherwise(col)


def strip_html(col: Column) -> Column:
    """Each step looks only at texts that can need it: a plain search for one
    character is far cheaper than the patterns it guards."""
    text = F.coalesce(col, F.lit(""))
    out = text
    for pattern, replacement in TAG_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    text = F.when(text.contains("<"), out).otherwise(text)
    return let(text, _decode_and_trim)


def _decode_and_trim(text: Column) -> Column:
    out = text
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    decoded = F.when(text.contains("&"), let(out, decode_numeric_entities)).otherwise(text)
    return let(decoded, _squeeze)


def _squeeze(text: Column) -> Column:
    squeezed = F.when(text.contains("\n\n\n"), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)
    return trim_blanks(squeezed)


def snippet(text: Column) -> Column:
    tagless = F.when(text.contains("<"), F.regexp_replace(text, TAG, " ")).otherwise(F.coalesce(text, F.lit("")))
    return F.left(tagless, F.lit(SNIPPET_CHARS))


def host(url: Column) -> Column:
    return F.regexp_replace(F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), r"^www\.", "")


def time_ago(ts: Column, as_of: Column) -> Column:
    """Age by successive rounding: each unit is rounded from the one before."""
    micros = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1e6)
    s = F.greatest(F.lit(0), _half_up(micros))
    m = _half_up(s / 60)
    h = _half_up(m / 60)
    d = _half_up(h / 24)
    mo = _half_up(d / 30)
    return (
        F.when(ts.isNull(), "")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(h < 24, F.concat(h.cast("string"), F.lit("h ago")))
        .when(d < 30, F.concat(d.cast("string"), F.lit("d ago")))
        .when(mo < 12, F.concat(mo.cast("string"), F.lit("mo ago")))
        .otherwise(F.concat(_half_up(d / 365).cast("string"), F.lit("y ago")))
    )


def heading(type_: Column, title: Column, text: Column) -> Column:
    """Title, else the start of the stripped text, else the type in brackets."""
    body = F.nullif(F.left(strip_html(text), F.lit(HEADING_CHARS)), F.lit(""))
    return F.coalesce(F.nullif(title, F.lit("")), body, F.concat(F.lit("("), type_, F.lit(")")))


def format_compact(n: Column) -> Column:
    whole = lambda x: _half_up(x).cast("string")
    return (
        F.when(n >= 1_000_000, F.concat(F.lit("~"), whole(n / 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(F.lit("~"), whole(n / 1_000), F.lit("K")))
        .when(n.isNotNull(), F.concat(F.lit("~"), whole(n / 1)))
    )


def round_significant(n: Column, digits: int = 2) -> Column:
    """To ``digits`` significant figures. The power of ten is built from the
    decimal digits, so exact powers never fall on the wrong side of a logarithm."""
    whole_digits = F.length(F.floor(n).cast("decimal(20,0)").cast("string"))
    scale = F.pow(F.lit(10.0), (whole_digits - digits).cast("double"))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.floor(n / scale + 0.5) * scale)


def format_matches(count: Column, capped: Column, estimate: Column) -> Column:
    exact = F.concat(F.format_number(count, 0), F.when(count == 1, " result").otherwise(" results"))
    about = F.concat(F.lit("~"), F.format_number(round_significant(estimate), 0), F.lit(" results"))
    return F.when(~capped & count.isNotNull(), exact).when(estimate.isNotNull(), about).otherwise("many results")


def byline(type_: Column, by: Column, ts: Column, score: Column, descendants: Column, as_of: Column, comments: Column) -> Column:
    """``12 points by ann 3h ago | 4 comments``; parts that do not apply are left out."""
    points = F.when(type_.isin(*SCORED_TYPES) & score.isNotNull(), F.concat(score.cast("string"), F.lit(" points")))
    author = F.when(by != "", F.concat(F.lit("by "), by))
    replies = F.when(comments, F.concat(F.lit("| "), F.coalesce(descendants, F.lit(0)).cast("string"), F.lit(" comments")))
    return F.concat_ws(" ", points, author, F.nullif(time_ago(ts, as_of), F.lit("")), replies)


def is_comment_row(type_: Column, title: Column) -> Column:
    return (F.coalesce(title, F.lit("")) == "") & type_.isin("comment", "pollopt")


def item_link(id_: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("/item/"), id_.cast("string")))


def thread_text(deleted: Column, text: Column) -> Column:
    return F.when(deleted, "[deleted]").otherwise(strip_html(text))


def thread_author(by: Column) -> Column:
    return F.coalesce(F.nullif(by, F.lit("")), F.lit("deleted"))

