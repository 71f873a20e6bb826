"""Timed-text XML ("srv3") as columns and back.

A document isn't taken apart further than it must be: its cues become an array, and the text between cues stays as it is, so
that head, windows, pens, comments and unknown elements come out as they went in. A cue keeps all its attributes in their
order, and what it holds besides text and segments. Everything here is built-in expressions; texts keep their entities until
they go to Python. Each expression over cues passes an array once, so none is computed twice.

Matching is tolerant: attributes may have either quotes or none, closing tags any case, and a document may be cut off; an
element that doesn't close is left alone. CDATA and comments aren't text. As players expect, indentation, tabs and line ends
are dropped, and line breaks inside a cue are written as entities. ``xml_tree`` reads XML of any form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INSIDE = r"""((?:[^<>"']|"[^"]*"|'[^']*')*+)"""
_ASIDE = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>"


def _element(name: str) -> str:
    """Pattern of an element with groups for its attributes and its content."""
    return rf"<{name}(?=[\s/>]){_INSIDE}(?:(?<=/)>|(?<!/)>(.*?)</(?i:{name})\s*>)"


TIMED_TEXT = r"(?s)^\s*(?:(?:<\?.*?\?>|<!--.*?-->|<![^>]*>)\s*)*<timedtext[\s/>]"
CUE, WINDOW, SEGMENT = _element("p"), _element("w"), _element("s")
POSITION = rf"(?s)<wp(?=[\s/>]){_INSIDE}>"
#: Whatever stands in a cue besides text: elements with their content, and tags without a partner.
CHILD = rf"(?s){_ASIDE}|<([A-Za-z_][^\s/<>]*){_INSIDE}(?:(?<=/)>|(?<!/)>.*?</\1\s*>)|<[^<>]*>"
ATTRIBUTE = r"""([^\s='"/<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]*)))?"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of whole files in a folder."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))


def cleaned(body: Column) -> Column:
    """Without indentation; null if it isn't timed text."""
    return F.when(body.rlike(TIMED_TEXT), F.regexp_replace(body, r"(?m)^[ \t]+", ""))


def _joined(content: Column) -> Column:
    """The character data of an element outside its children."""
    return F.array_join(F.transform(F.split(content, CHILD, -1), lambda x: F.regexp_replace(x, r"^[\r\n\t]+|[\r\n\t]+$", "")), "")


def attributes(inside: Column) -> tuple[Column, Column]:
    """Names and raw values of attributes, in order; a bare one has an empty value."""
    inside = F.regexp_replace(inside, "/$", "")
    one, two, bare = (F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(k)) for k in (2, 3, 4))
    both = lambda a, b: F.concat(a, b)
    return F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(1)), F.zip_with(F.zip_with(one, two, both), bare, both)


def attribute(cue: Column, name: str) -> Column:
    """Raw value of an attribute, null if it is absent."""
    return F.get(cue["values"], (F.array_position(cue["names"], F.lit(name)) - 1).cast("int"))


def has_attribute(cue: Column, name: str) -> Column:
    return F.array_contains(cue["names"], F.lit(name))


def gaps(clean: Column) -> Column:
    """The text before, between and after cues, comments and CDATA sections."""
    return F.split(clean, f"(?s){_ASIDE}|{CUE}", -1)


def cues(clean: Column) -> Column:
    """An array of what stands between the gaps: names, raw values, raw content, text with its entities, whether it has
    segments, and children that aren't text. A comment has null ``text``, a cue without text an empty one."""
    found = F.regexp_extract_all(clean, F.lit(f"(?s){_ASIDE}|{CUE}"), F.lit(0))

    def opened(x: Column) -> Column:
        inside, content = (F.regexp_extract(x, f"(?s)^{CUE}$", k) for k in (1, 2))
        names, values = attributes(inside)
        return F.struct(x.startswith("<p").alias("cue"), names.alias("names"), values.alias("values"), F.when(x.startswith("<p"), content).otherwise(x).alias("raw"))

    def divided(x: Column) -> Column:
        children = F.regexp_extract_all(x["raw"], F.lit(CHILD), F.lit(0))
        return F.struct(x["cue"].alias("cue"), x["names"].alias("names"), x["values"].alias("values"), x["raw"].alias("raw"), F.filter(children, lambda c: c.rlike(r"^<s[\s/>]")).alias("segments"), F.filter(children, lambda c: ~c.rlike(r"^<s[\s/>]")).alias("others"))

    def read(x: Column) -> Column:
        segmented = F.size(x["segments"]) > 0
        parts = F.transform(x["segments"], lambda s: _joined(F.regexp_extract(s, f"(?s)^{SEGMENT}$", 2)))
        text = F.when(segmented, F.array_join(parts, "")).otherwise(_joined(x["raw"]))
        return F.struct(x["names"].alias("names"), x["values"].alias("values"), x["raw"].alias("raw"), F.when(x["cue"], text).alias("text"), segmented.alias("segmented"), F.array_join(x["others"], "").alias("others"))

    return F.transform(F.transform(F.transform(found, opened), divided), read)


def with_positions(clean: Column, least: int) -> Column:
    """The document with the window position that has id 1, else the second one, showing at least so many rows."""
    tags = F.regexp_extract_all(clean, F.lit(POSITION), F.lit(0))
    ids = F.transform(tags, lambda x: F.regexp_extract(x, r"""\sid\s*=\s*["']?([^\s"'/>]*)""", 1))
    named = F.array_position(ids, F.lit("1"))
    index = F.when(named > 0, named - 1).otherwise(1)
    given = r"""(\src\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s"'<>/]*))"""

    def floored(x: Column) -> Column:
        rows = F.regexp_extract(x, r"""\src\s*=\s*["']?\s*(\+?[0-9]+)""", 1).try_cast("bigint")
        n = F.greatest(F.coalesce(rows, F.lit(0)), F.lit(least)).cast("string")
        return F.when(x.rlike(given), F.regexp_replace(x, given, F.concat(F.lit('$1"'), n, F.lit('"')))).otherwise(F.regexp_replace(x, r"\s*(/?)>$", F.concat(F.lit(' rc="'), n, F.lit('"$1>'))))

    kept = F.transform(tags, lambda x, i: F.when(i == index, floored(x)).otherwise(x))
    joined = F.zip_with(F.split(clean, POSITION, -1), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(clean.rlike(POSITION), F.array_join(joined, "")).otherwise(clean)


def has_window(clean: Column) -> Column:
    return clean.rlike(r"<w(?=[\s/>])")


def without_windows(clean: Column) -> Column:
    return F.regexp_replace(clean, f"(?s){WINDOW}", "")


def escaped_attribute(value: Column) -> Column:
    x = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(x, F.lit('"'), F.lit("&quot;"))


def cue_element(cue: Column, changed: dict[str, Column], dropped: Column, content: Column) -> Column:
    """A cue as an element: its attributes, of which some have a new value (null: the old one) and some, in the array
    ``dropped``, go; those that it doesn't have yet come last."""
    pairs = F.filter(F.arrays_zip(cue["names"].alias("n"), cue["values"].alias("v")), lambda a: ~F.array_contains(dropped, a["n"]))

    def written(a: Column) -> Column:
        value = F.replace(a["v"], F.lit('"'), F.lit("&quot;"))
        for name, new in changed.items():
            value = F.when(a["n"] == name, F.coalesce(escaped_attribute(new), value)).otherwise(value)
        return F.concat(F.lit(" "), a["n"], F.lit('="'), value, F.lit('"'))

    more = [F.coalesce(F.when(~has_attribute(cue, name), F.concat(F.lit(f' {name}="'), escaped_attribute(new), F.lit('"'))), F.lit("")) for name, new in changed.items()]
    return F.concat(F.lit("<p"), F.array_join(F.transform(pairs, written), ""), *more, F.lit(">"), content, F.lit("</p>"))


def written(text: Column) -> Column:
    """The document as players expect it."""
    return F.translate(text, "\t\n", "")


