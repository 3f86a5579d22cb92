from datetime import datetime, timedelta

from pyspark.sql import functions as F

from forumlake.functions import display

AS_OF = datetime(2024, 1, 11)


def one_by_one(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_strip_html(spark):
    cases = {
        "a<p>b": "a\n\nb",
        "<P>x</p><I>y</I>": "xy".replace("x", "x"),
        "<pre><code>c\n</code></pre>z": "c\n\nz",
        '<a href="http:&#x2F;&#x2F;x.y" rel="nofollow">t</a>': "http://x.y t",
        "1 < 2": "1 < 2",
        "&amp;lt;": "<",
        "it&#x27;s &quot;q&quot; &gt; &#8364;&#33;": "it's \"q\" > €!",
        "a\n\n\n\nb": "a\n\nb",
        "  pad ": "pad",
        "": "",
        "&#55296;": "�",
        "&#65601;": chr(65601),
        "&#128512;&#65279;x": "\U0001f600\ufeffx",
        "&#99999999999999999999999;": "\ufffd",
    }
    rows = [(k,) for k in cases] + [(None,)]
    assert one_by_one(spark, "c string", rows, display.strip_html(F.col("c"))) == [*cases.values(), ""]


def test_host(spark):
    cases = {
        "https://www.x.org/a": "x.org",
        "HTTP://WWW.Example.COM:8080/": "example.com",
        "https://news.x.org?q=1": "news.x.org",
        "no scheme": None,
        "": None,
        "https://wwwx.org": "wwwx.org",
    }
    assert one_by_one(spark, "c string", [(k,) for k in cases] + [(None,)], display.host(F.col("c"))) == [*cases.values(), None]


def test_time_ago_rounds_step_by_step(spark):
    cases = [
        (timedelta(0), "0s ago"),
        (timedelta(seconds=59), "59s ago"),
        (timedelta(seconds=60), "1m ago"),
        (timedelta(seconds=89), "1m ago"),
        (timedelta(seconds=90), "2m ago"),
        (timedelta(minutes=59.5), "1h ago"),
        (timedelta(hours=23.5), "1d ago"),
        (timedelta(days=29.5), "1mo ago"),
        (timedelta(days=359), "1y ago"),
        (timedelta(days=400), "1y ago"),
        (timedelta(days=-3), "0s ago"),
    ]
    rows = [(AS_OF - age,) for age, _ in cases] + [(None,)]
    got = one_by_one(spark, "c timestamp_ntz", rows, display.time_ago(F.col("c"), F.lit(AS_OF)))
    assert got == [label for _, label in cases] + [""]


def test_heading(spark):
    rows = [("story", "T", "x"), ("story", "", "<p>body"), ("comment", None, "b" * 200), ("job", None, ""), ("poll", None, None)]
    got = one_by_one(spark, "t string, h string, x string", rows, display.heading(F.col("t"), F.col("h"), F.col("x")))
    assert got == ["T", "body", "b" * 160, "(job)", "(poll)"]


def test_number_labels(spark):
    numbers = [(0,), (7,), (999,), (1000,), (28700,), (48750000,), (1500000,)]
    assert one_by_one(spark, "n bigint", numbers, display.format_compact(F.col("n"))) == ["~0", "~7", "~999", "~1K", "~29K", "~49M", "~2M"]
    rounded = [(33718,), (2888602,), (0,), (-5,), (7,), (10,), (1000,), (995,)]
    got = one_by_one(spark, "n bigint", rounded, display.round_significant(F.col("n")).cast("bigint"))
    assert got == [34000, 2900000, 0, 0, 7, 10, 1000, 1000]


def test_format_matches(spark):
    rows = [(1, False, None), (515, False, None), (1234567, False, None), (None, True, 33718), (None, True, None), (0, False, None)]
    got = one_by_one(spark, "c bigint, k boolean, e bigint", rows, display.format_matches(F.col("c"), F.col("k"), F.col("e")))
    assert got == ["1 result", "515 results", "1,234,567 results", "~34,000 results", "many results", "0 results"]


def test_byline_and_masks(spark):
    ts = AS_OF - timedelta(hours=3)
    rows = [("story", "ann", ts, 12, 4, True), ("comment", "bob", ts, 5, None, False), ("poll", None, None, None, None, True)]
    c = F.col
    line = display.byline(c("t"), c("b"), c("s"), c("p"), c("d"), F.lit(AS_OF), c("k"))
    got = one_by_one(spark, "t string, b string, s timestamp_ntz, p int, d int, k boolean", rows, line)
    assert got == ["12 points by ann 3h ago | 4 comments", "by bob 3h ago", "| 0 comments"]
    masked = one_by_one(spark, "d boolean, x string", [(True, "x"), (False, "<p>y")], display.thread_text(c("d"), c("x")))
    assert masked == ["[deleted]", "y"]
    assert one_by_one(spark, "b string", [("",), (None,), ("z",)], display.thread_author(c("b"))) == ["deleted", "deleted", "z"]


def test_row_kind_and_link(spark):
    c = F.col
    rows = [("comment", None), ("comment", "t"), ("pollopt", ""), ("story", None)]
    assert one_by_one(spark, "t string, h string", rows, display.is_comment_row(c("t"), c("h"))) == [True, False, True, False]
    assert one_by_one(spark, "n bigint, u string", [(3, None), (4, ""), (5, "http://x")], display.item_link(c("n"), c("u"))) == [
        "/item/3", "/item/4", "http://x",
    ]
