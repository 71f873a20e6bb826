"""Column functions on caption text. All are built-in expressions and need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cue without text holds this one character (zero width space). It isn't white space.
BLANK = "\u200b"

#: White space as ECMAScript's \s and trim() have it, inside a character class.
SPACE = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Characters after which a line may be broken, besides white space, inside a character class.
BREAK_MARKS = r",.!?;:\x{FF0C}\x{3002}\x{FF01}\x{FF1F}\x{FF1B}\x{FF1A}\x{3001}\x{2026}\-\x{2014})\]\x{3011}\x{300D}\x{300F}"
#: Characters that take two display cells, inside a character class.
WIDE = r"\x{1100}-\x{115F}\x{2329}\x{232A}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE10}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}\x{20000}-\x{3FFFD}"
#: Characters that percent-encoding leaves as they are, inside a character class.
UNRESERVED = r"A-Za-z0-9\-_.!~*'()"


def normalized(x: Column) -> Column:
    """Null is an empty text."""
    return F.coalesce(x.cast("string"), F.lit(""))


def flattened(parts: Column) -> Column:
    """Texts of an array end to end, null ones as empty."""
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast("array<string>")), normalized), "")


def display_width(x: Column) -> Column:
    """Cells that a text takes: two for a wide character, one for any other."""
    x = normalized(x)
    return (F.length(x) + F.length(F.regexp_replace(x, f"[^{WIDE}]", ""))).cast("long")


def is_wide(ch: Column) -> Column:
    return ch.rlike(f"^[{WIDE}]")


def is_natural_break(ch: Column) -> Column:
    return ch.rlike(f"^[{SPACE}{BREAK_MARKS}]")


def percent_encoded_length(x: Column) -> Column:
    """Length of a text after percent-encoding as a URI component."""
    x = normalized(x)
    return (3 * F.octet_length(x) - 2 * F.length(F.regexp_replace(x, f"[^{UNRESERVED}]", ""))).cast("long")


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(normalized(x), "UTF-16BE")) / 2).cast("long")


def escape_xml(x: Column) -> Column:
    """Escapes ampersands and angle brackets; quotes stay."""
    x = F.replace(normalized(x), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def trimmed(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(normalized(x), f"^[{SPACE}]+|[{SPACE}]+$", "")


def leading_integer(x: Column, allow_zero: bool = False) -> Column:
    """The integer that a string begins with, null if there is none or it isn't positive (or zero, if allowed)."""
    n = F.regexp_extract(x.cast("string"), f"^[{SPACE}]*([+-]?[0-9]+)", 1).try_cast("bigint")
    return F.when(n >= 0 if allow_zero else n > 0, n)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def is_blank(x: Column) -> Column:
    return normalized(x).isin("", BLANK)
