"""The timing and cutting of all cues of a track at once, for tracks that are one row. The rules are those of ``ordered`` and
``segmentation``, which work on cues as rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import BLANK
from ..sources.entities import decoded
from .ordered import next_starts
from .segmentation import MAX_WIDTH, weighed_pieces

PARTS = "array<struct<pos:int,part_no:int,start_ms:bigint,dur_ms:bigint,text:string>>"
_ARROW_PARTS = pa.list_(pa.struct([("pos", pa.int32()), ("part_no", pa.int32()), ("start_ms", pa.int64()), ("dur_ms", pa.int64()), ("text", pa.string())]))

Part = tuple[int, int, int | None, int | None, str | None]


def half_up(a: int, b: int) -> int:
    """a / b rounded to the nearest integer, halves up."""
    return (2 * a + b) // (2 * b)


def paced(mode: str, starts: list, durations: list, texts: list, width: int = MAX_WIDTH) -> list[Part]:
    """Parts of a track's cues in order. A null text is no cue; it passes through and has no time. Texts have their entities
    decoded, and an empty one becomes the blank sign."""
    texts = [t if t is None else decoded(t) or BLANK for t in texts]
    following: list[int | None] = [None] * len(texts)
    if mode != "official":
        step = next_starts()
        for i in range(len(texts) - 1, -1, -1):
            if texts[i] is not None:
                following[i] = step(starts[i])
    out: list[Part] = []
    for i, (start, given, text) in enumerate(zip(starts, durations, texts, strict=True)):
        room = following[i] - start if following[i] is not None and start is not None else 0
        lasting = given
        if mode == "automatic" and room > 0 and (given is None or given > room):
            lasting = room
        elif mode == "broadcast" and text not in (None, BLANK) and given is not None and given > room > 0:
            lasting = room
        pieces = weighed_pieces(text, width) if mode == "automatic" and text is not None and start is not None and lasting is not None else []
        if len(pieces) > 1:
            for k, (piece, before, upto, total) in enumerate(pieces):
                a = half_up(lasting * before, total)
                b = lasting if upto == total else half_up(lasting * upto, total)
                out.append((i, k, start + a, max(1, b - a), piece))
        else:
            out.append((i, 0, start, given if text == BLANK else lasting, text))
    return out


def paced_cues(mode: Column, starts: Column, durations: Column, texts: Column, width: int = MAX_WIDTH) -> Column:
    """Array of a track's parts."""

    def run(modes: pa.Array, s: pa.Array, d: pa.Array, t: pa.Array) -> pa.Array:
        rows = zip(modes.to_pylist(), s.to_pylist(), d.to_pylist(), t.to_pylist(), strict=True)
        return pa.array([None if x[3] is None else paced(*x, width) for x in rows], _ARROW_PARTS)

    return F.arrow_udf(run, PARTS)(mode, starts, durations, texts)
