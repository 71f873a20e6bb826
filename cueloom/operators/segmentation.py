"""Cutting long captions at reading boundaries, and sharing their time out."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import filled_duration, next_start

MAX_WIDTH = 40
#: A cut at a reading boundary needs a piece of at least this share of the greatest width.
LEAST_SHARE = 0.55


def _pattern(chars: str) -> re.Pattern:
    return re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), chars) + "]")


_SPACE, _BREAK, _WIDE = _pattern(X.SPACE), _pattern(X.SPACE + X.BREAK_MARKS), _pattern(X.WIDE)
_SPACES = "".join(chr(c) for c in range(0x10000) if _SPACE.match(chr(c)))


Piece = tuple[str, int, int, int]  # its text, the width before it, the width up to its end, the width of all


def weighed_pieces(text: str | None, width: int = MAX_WIDTH) -> list[Piece]:
    """Pieces of at most ``width`` cells. A piece ends after the last natural break in reach if it is then wide enough, else
    where the width runs out; a character wider than ``width`` is a piece of its own. Widths are those of the pieces."""
    text = (text or "").strip(_SPACES)
    if not text:
        return []
    upto = list(accumulate((2 if _WIDE.match(c) else 1 for c in text), initial=0))
    if text == X.BLANK or upto[-1] <= width:
        return [(text, 0, upto[-1], upto[-1])]
    breaks = [m.end() for m in _BREAK.finditer(text)]
    out, at, n = [], 0, len(text)
    while at < n:
        reach = max(at + 1, bisect_right(upto, upto[at] + width) - 1)
        end = reach
        if reach < n:
            k = bisect_right(breaks, reach) - 1
            if k >= 0 and breaks[k] > at and upto[breaks[k]] - upto[at] >= width * LEAST_SHARE:
                end = breaks[k]
        if piece := text[at:end].strip(_SPACES):
            lead = end - at - len(text[at:end].lstrip(_SPACES))
            out.append((piece, upto[at + lead + len(piece)] - upto[at + lead]))
        while end < n and text[end] in _SPACES:
            end += 1
        at = end
    edges = list(accumulate((w for _, w in out), initial=0))
    return [(piece, edges[i], edges[i + 1], edges[-1]) for i, (piece, _) in enumerate(out)]


def split_text(text: str | None, width: int = MAX_WIDTH) -> list[str]:
    return [p[0] for p in weighed_pieces(text, width)]


_PIECES = "array<struct<text:string,before:bigint,upto:bigint,total:bigint>>"
_ARROW_PIECES = pa.list_(pa.struct([("text", pa.string()), ("before", pa.int64()), ("upto", pa.int64()), ("total", pa.int64())]))


def pieces(text: Column, width: int = MAX_WIDTH) -> Column:
    """Array of a text's pieces with their widths. Only texts wider than ``width`` go to Python."""

    def cut(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else weighed_pieces(s, width) for s in x.to_pylist()], _ARROW_PIECES)

    short = X.trimmed(text)
    cells = X.display_width(short)
    wide = F.when(cells > width, short)
    whole = F.array(F.struct(short.alias("text"), F.lit(0).cast("bigint").alias("before"), cells.alias("upto"), cells.alias("total")))
    return F.when(short == "", F.array().cast(_PIECES)).when(cells > width, F.arrow_udf(cut, _PIECES)(wide)).otherwise(whole)


def slice_edge(duration: Column, width: Column, total: Column) -> Column:
    """Where in a cue's duration a piece begins or ends that has so much width before it or up to its end."""
    return X.half_up(duration * width / total)


def split_cues(cues: DataFrame, width: int = MAX_WIDTH) -> DataFrame:
    """Automatic cues, each cut into timed parts. Needs track_id, pos, start_ms, dur_ms and text; gives part_no, was_split and
    shortened besides. A cue of one part, or without a valid time, stays whole. The duration is shared out by display width,
    without gaps, the last part ending with the cue and none shorter than a millisecond."""
    df = next_start(cues)
    df = df.withColumn("_d", filled_duration(F.col("start_ms"), F.col("dur_ms"), F.col("next_ms")))
    # a generator's output is computed once, however often it is used after
    df = df.select("*", F.posexplode_outer(pieces(F.col("text"), width)).alias("_n", "_p"))
    split = (F.col("_p.upto") - F.col("_p.before") < F.col("_p.total")) & F.col("start_ms").isNotNull() & (F.col("_d") > 0)
    df = df.withColumn("was_split", F.coalesce(split, F.lit(False))).where(F.col("was_split") | (F.coalesce("_n", F.lit(0)) == 0))
    before, upto = (slice_edge(F.col("_d"), F.col(f"_p.{x}"), F.col("_p.total")) for x in ("before", "upto"))
    after = F.when(F.col("_p.upto") == F.col("_p.total"), F.col("_d")).otherwise(upto)
    kept = F.when((F.col("_d") > 0) & (F.col("text") != X.BLANK), F.col("_d")).otherwise(F.col("dur_ms"))
    either = lambda a, b: F.when(F.col("was_split"), a).otherwise(b)
    rest = [c for c in cues.columns if c not in ("text", "start_ms", "dur_ms")]
    shortened = F.coalesce(F.col("dur_ms") > F.col("_d"), F.lit(False))
    return df.select(*rest, "was_split", shortened.alias("shortened"), either(F.col("_n"), F.lit(0)).alias("part_no"), either(F.col("_p.text"), F.col("text")).alias("text"), either(F.col("start_ms") + before, F.col("start_ms")).alias("start_ms"), either(F.greatest(F.lit(1), after - before), kept).cast("long").alias("dur_ms"))


def split_counters(parts: DataFrame, track: str = "track_id") -> DataFrame:
    """Cues in and out, split and shortened, of each track after ``split_cues``."""
    first = F.col("part_no") == 0
    return parts.groupBy(track).agg(F.count_if(first).alias("cues_in"), F.count("*").alias("cues_out"), F.count_if(first & F.col("was_split")).alias("split"), F.count_if(first & F.col("shortened")).alias("shortened"))
