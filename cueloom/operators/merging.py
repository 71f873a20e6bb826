"""Reading and writing the text of cues, and classic per-cue rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

LINE_BREAK = "&#x000A;"


def as_array(x: Column, element: str) -> Column:
    """A repeated field as an array, none as an empty one."""
    return F.coalesce(x, F.array().cast(f"array<{element}>"))


def cue_text(direct: Column, segments: Column) -> Column:
    """A cue's text: its segments end to end if it has them, else its own; a missing text is the blank sign."""
    joined = F.array_join(F.transform(segments, X.normalized), "")
    return F.when(segments.isNotNull(), F.when(joined == "", X.BLANK).otherwise(joined)).otherwise(F.coalesce(direct, F.lit(X.BLANK)))


def bilingual(origin: Column, translation: Column, position: str = "Forward", translation_only: bool = False, line_break: str = LINE_BREAK) -> Column:
    """Escaped text of both languages, null where the cue isn't to be written."""
    a, b = X.escape_xml(origin), X.escape_xml(translation)
    both = b if translation_only else F.concat(b, F.lit(line_break), a) if position == "Reverse" else F.concat(a, F.lit(line_break), b)
    return F.when(~X.is_blank(origin), F.when(X.trimmed(b) == "", a).otherwise(both))


def floor_rows(positions: Column, least: int = 2) -> Column:
    """Window positions of which that with id 1, else the second, shows at least so many rows."""
    ids = F.transform(positions, lambda p: F.coalesce(p["_id"], F.lit("")))
    named = F.array_position(ids, "1")
    index = F.when(named > 0, named - 1).otherwise(1)
    rows = lambda p: F.greatest(F.coalesce(X.leading_integer(p["_rc"], allow_zero=True), F.lit(0)), F.lit(least)).cast("string")
    return F.transform(positions, lambda p, i: F.when(i == index, p.withField("_rc", rows(p))).otherwise(p))


def without_roll_up(cues: Column) -> Column:
    """Cues that no longer refer to a scrolling window."""
    return F.transform(cues, lambda p: p.withField("_w", F.lit(None).cast("string")).withField("_a", F.lit(None).cast("string")))
