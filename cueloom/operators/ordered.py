"""Operators over a track's cues in document order.

A track's rows meet in one partition, sorted; each operator reads them as a stream. The next-start search holds a stack of
increasing starts, at most a track's; the batches hold a running length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream_by_track(df: DataFrame, track: str, order: list[Column], needs: list[str], output: str, make: Callable[[], Callable[..., int | None]]) -> DataFrame:
    """Appends a long column computed row by row in the given order; ``make()`` starts a track. Only the track and the
    columns needed travel to Python. The function counts as nondeterministic, so that the sort below it stays."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        current, step = object(), None
        for tracks, *columns in batches:
            out = []
            for t, *values in zip(tracks.to_pylist(), *(c.to_pylist() for c in columns), strict=True):
                if step is None or t != current:
                    current, step = t, make()
                out.append(step(*values))
            yield pa.array(out, pa.int64())

    function = F.arrow_udf(run, "bigint").asNondeterministic()
    return df.repartition(F.col(track)).sortWithinPartitions(F.col(track), *order).withColumn(output, function(track, *needs))


def next_starts() -> Callable[[int | None], int | None]:
    """For a track's starts read backwards: the start of the first later cue that starts after each, any valid start for a
    cue that has none. A stack of increasing starts has it on top."""
    stack: list[int] = []
    latest: list[int | None] = [None]

    def step(now: int | None) -> int | None:
        if now is None:
            return latest[0]
        while stack and stack[-1] <= now:
            stack.pop()
        found = stack[-1] if stack else None
        stack.append(now)
        latest[0] = now
        return found

    return step


def next_start(df: DataFrame, track: str = "track_id", pos: str = "pos", start: str = "start_ms", output: str = "next_ms") -> DataFrame:
    """The start of the first later cue in document order that starts after this one; any valid start if this cue has none."""
    return stream_by_track(df, track, [F.col(pos).desc()], [start], output, next_starts)


def next_starts_by_position() -> Callable[[int | None, int | None], int | None]:
    """For a track's positions read backwards, each with its earliest and its latest start: the latest start of the first later
    position that has one after the earliest here. A stack of increasing latest starts has it on top."""
    stack: list[int] = []

    def step(earliest: int | None, latest: int | None) -> int | None:
        if earliest is None:
            return None
        while stack and stack[-1] <= earliest:
            stack.pop()
        found = stack[-1] if stack else None
        while stack and stack[-1] <= latest:
            stack.pop()
        stack.append(latest)
        return found

    return step


def next_start_by_position(df: DataFrame, track: str = "track_id", pos: str = "pos", start: str = "start_ms", output: str = "next_ms") -> DataFrame:
    """(track, pos, next start), one row for a track's position, however many cues share it: from the first later position
    with a cue that starts after the earliest here, the latest start. Without a track, position or start there is none."""
    positions = df.groupBy(track, pos).agg(F.min(start).alias("_earliest"), F.max(start).alias("_latest"))
    found = stream_by_track(positions, track, [F.col(pos).desc()], ["_earliest", "_latest"], output, next_starts_by_position)
    return found.select(track, pos, F.when(F.col(track).isNotNull() & F.col(pos).isNotNull(), F.col(output)).alias(output))


def next_start_sorted(track: str = "track_id", start: str = "start_ms") -> Column:
    """The same for tracks whose starts never go back, as a window expression. Read from the last start, the frame only
    grows, so each row is added once."""
    return F.min(start).over(W.partitionBy(track).orderBy(F.desc(start)).rangeBetween(W.unboundedPreceding, -1))


def trimmed_duration(start: Column, duration: Column, next_ms: Column, has_text: Column) -> Column:
    """A broadcast cue ends where the next begins; nothing is made longer."""
    room = next_ms - start
    return F.when(has_text & (room > 0) & (duration > room), room).otherwise(duration)


def filled_duration(start: Column, duration: Column, next_ms: Column) -> Column:
    """An automatic cue ends where the next begins, and lasts until then if it has no duration."""
    room = next_ms - start
    return F.when((room > 0) & (duration.isNull() | (duration > room)), room).otherwise(duration)


def fixed_batches(df: DataFrame, size: int = 120, track: str = "track_id", pos: str = "pos", output: str = "batch_no") -> DataFrame:
    """Numbers batches of ``size`` consecutive rows of a track."""
    return df.withColumn(output, F.floor((F.row_number().over(W.partitionBy(track).orderBy(pos)) - 1) / size).cast("long"))


def size_batches(limit: int, separator: int) -> Callable[[int], int]:
    """The batch of each row from the rows' lengths in order."""
    state = [0, 0, 0]  # batch, rows in it, its length

    def step(n: int) -> int:
        grown = state[2] + separator + n
        if state[1] and grown > limit:
            state[:] = [state[0] + 1, 1, n]
        else:
            state[1], state[2] = state[1] + 1, grown if state[1] else n
        return state[0]

    return step


def size_bounded_batches(df: DataFrame, length: Column, limit: int = 2400, separator: int = 3, track: str = "track_id", pos: str = "pos", output: str = "batch_no") -> DataFrame:
    """Numbers batches of consecutive rows whose encoded lengths, with a separator between rows, stay within ``limit``; a
    longer row is a batch of its own."""

    make = partial(size_batches, limit, separator)
    return stream_by_track(df.withColumn("_length", length), track, [F.col(pos)], ["_length"], output, make).drop("_length")


def renumbered(df: DataFrame, track: str = "track_id", order: tuple[str, ...] = ("pos", "part_no"), output: str = "out_pos") -> DataFrame:
    return df.withColumn(output, F.row_number().over(W.partitionBy(track).orderBy(*order)) - 1)


def concatenated(text: str, pos: str, separator: str = "") -> Column:
    """Aggregate: texts of a group in order of ``pos``, end to end."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), separator)
