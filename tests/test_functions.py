"""Column functions against literal values."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions import tracks, urls


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_display_width(spark):
    assert values(spark, X.display_width, ["abc", "안녕", "日本a", "😀", "𠀀", "ｱ", "", None]) == [3, 4, 5, 2, 2, 1, 0, 0]


def test_percent_encoded_length(spark):
    assert values(spark, X.percent_encoded_length, ["a b", "é", "안", "!~*'()", "\r"]) == [5, 6, 9, 6, 3]


def test_utf16_length(spark):
    assert values(spark, X.utf16_length, ["ab", "😀", ""]) == [2, 2, 0]


def test_escape(spark):
    assert values(spark, X.escape_xml, ['A & <b> "c"', "&amp;", None]) == ['A &amp; &lt;b&gt; "c"', "&amp;amp;", ""]


def test_trim_knows_all_white_space_but_zero_width(spark):
    assert values(spark, X.trimmed, ["　a﻿", "  x\t", "​", "  "]) == ["a", "x", "​", ""]


def test_leading_integer(spark):
    assert values(spark, lambda x: X.leading_integer(x, True), ["12abc", " 7", "1.5", "", "-3", "0", None, "99999999999999999999"]) == [12, 7, 1, None, None, 0, None, None]
    assert values(spark, X.leading_integer, ["0", "5"]) == [None, 5]


def test_breaks(spark):
    assert values(spark, X.is_natural_break, [",", "。", "—", "a", " ", "」"]) == [True, True, True, False, True, True]


@pytest.mark.parametrize(("name", "hit"), [("CC1", True), ("CC4", True), ("DTVCC63", True), ("Service 63", True), ("CEA-608", True), ("EIA 708", True), ("Embedded 608/708", True), ("Line 21", True), ("ＣＣ１", True), ("CC5", False), ("DTVCC64", False), ("SERVICE0", False), ("XCC1", False), ("", False)])
def test_broadcast_names(spark, name, hit):
    assert values(spark, tracks.is_broadcast_name, [name]) == [hit]


def test_request_marker(spark):
    base = "https://www.youtube.com/api/timedtext?lang=ko&kind=asr"
    assert values(spark, urls.marked, [base, base + "&subtype=Official", "https://example.com/api/timedtext?a=1", None]) == [base + "&subtype=Translate", base + "&subtype=Official", "https://example.com/api/timedtext?a=1", None]


def test_query_values(spark):
    url = "https://m.youtube.com/api/timedtext?name=Service%2063&kind=asr&tlang=de#f"
    assert values(spark, lambda u: urls.query_value(u, "name"), [url]) == ["Service 63"]
    assert values(spark, urls.is_automatic, [url, "https://m.youtube.com/"]) == [True, False]
    assert values(spark, lambda u: urls.delete_query(u, "tlang"), [url]) == ["https://m.youtube.com/api/timedtext?name=Service%2063&kind=asr#f"]
    assert values(spark, lambda u: urls.set_query(u, "kind", "x"), [url]) == ["https://m.youtube.com/api/timedtext?name=Service%2063&kind=x&tlang=de#f"]


def test_subtype(spark):
    url = "https://m.youtube.com/api/timedtext?lang=en&tlang=de"
    ask = lambda kind, cached=None: values(spark, lambda u: urls.caption_subtype(u, F.lit(kind).cast("string"), F.lit(cached).cast("string")), [url])[0]
    assert ask(None) == url
    assert ask("External") == "https://m.youtube.com/api/timedtext?lang=en&subtype=External"
    assert ask("AutoCC", "fr") == "https://m.youtube.com/api/timedtext?lang=en&tlang=fr"
    assert ask("AutoCC", "en-US") == url


def test_body_kinds(spark):
    assert values(spark, urls.body_kind, ["application/json; charset=UTF-8", "application/x-protobuf", "text/html", None]) == ["json", "protobuf", None, None]
