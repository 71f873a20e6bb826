"""Document fingerprints by order MinHash (operator 3).

A text's k-mers are numbered by occurrence, so that repeated ones count. For each of ``SKETCHES`` hash functions the
``LENGTH`` = 2 numbered k-mers of least hash are selected, put back into text order, and the tuple of k-mers is hashed to
16 bits. Likeness is the share of equal positions of two fingerprints; unlike plain MinHash it falls when parts are moved,
and bounds the edit distance.

A text shorter than K is one k-mer, an empty or null one has a fixed fingerprint of its own. Equal texts have equal
fingerprints. A chance collision of two k-mers' 64-bit hashes can change an occurrence number, with odds of about
n_chars**2 / 2**65.

``fingerprints`` needs no shuffle. ``with_next`` pairs each row with the next one by (id, text hash), the last with the
first: rows are dealt to ranges of ids once, each range also gets the first row of the next, and a sorted stream is read
once, so a task holds two texts. Null ids come first. An id of very many rows is dealt to several ranges by its texts; only
equal rows stay together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, documents, frugal, per_text
from .shingles import _mix

K, SKETCHES = 8, 48
#: Hashes computed at once.
_CHUNK = 1 << 17
_MAX = np.uint32((1 << 32) - 1)
_WIDE = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SEEDS, _FACTORS = (_WIDE >> np.uint64(32)).astype(np.uint32), _WIDE.astype(np.uint32) | np.uint32(1)

Best = tuple[np.ndarray, np.ndarray]  # least hashes and their k-mers' positions, two for each function


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kmers(c: np.ndarray) -> np.ndarray:
    """Hash of the K code points from each position on; of all of them if there are fewer."""
    h = c.astype(np.uint64) + np.uint64(1)
    if len(c) < K:
        whole = np.uint64(len(c))
        for x in h.tolist():
            whole = _mix(np.array([whole], np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(x))[0]
        return np.array([whole], np.uint64) if len(c) else np.empty(0, np.uint64)
    for width in (1, 2, 4):
        h = h[:-width] * np.uint64(0xE7037ED1A0B428DB) + h[width:]
        h ^= h >> np.uint64(29)
    return _mix(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with its occurrence number."""
    n = len(h)
    if not n:
        return h
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    s = np.sort(h & ~low | np.arange(n, dtype=np.uint64))
    at = (s & low).astype(np.int64)
    run = np.flatnonzero(np.concatenate([[True], s[1:] >> bits != s[:-1] >> bits]))
    number = np.empty(n, dtype=np.uint64)
    number[at] = (np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))).astype(np.uint64)
    return _mix(h + number * np.uint64(0xC2B2AE3D27D4EB4F)) if number.any() else _mix(h)


_BUFFER = np.empty(_CHUNK, dtype=np.uint32)
_ROWS = np.arange(SKETCHES)
_NONE: Best = (np.full((2, SKETCHES), _MAX), np.full((2, SKETCHES), -1, dtype=np.int64))


def least(base: np.ndarray, start: int = 0) -> Best:
    """For each function the two least hashes of a stretch of numbered k-mers."""
    best = _NONE
    step = _CHUNK // SKETCHES
    base = (base >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(base), step):
        part = base[a : a + step]
        v = _BUFFER[: SKETCHES * len(part)].reshape(SKETCHES, len(part))
        np.bitwise_xor(part, _SEEDS[:, None], out=v)
        np.multiply(v, _FACTORS[:, None], out=v)
        i = v.argmin(axis=1)
        first = v[_ROWS, i]
        if len(part) == 1:
            found = np.stack([first, _NONE[0][0]]), np.stack([i + (start + a), _NONE[1][0]])
        else:
            v[_ROWS, i] = _MAX
            j = v.argmin(axis=1)
            found = np.stack([first, v[_ROWS, j]]), np.stack([i, j]) + (start + a)
        best = found if best is _NONE else merged(best, found)
    return best


def merged(a: Best, b: Best) -> Best:
    """The two least of four, those of the earlier stretch ``a`` first among equals."""
    (a0, a1), (p0, p1) = a
    (b0, b1), (q0, q1) = b
    swap = b0 < a0
    lost, lost_at = np.where(swap, a0, b0), np.where(swap, p0, q0)
    after, after_at = np.where(swap, b1, a1), np.where(swap, q1, p1)
    second = after < lost
    return np.stack([np.where(swap, b0, a0), np.where(second, after, lost)]), np.stack([np.where(swap, q0, p0), np.where(second, after_at, lost_at)])


def sketch(best: Best, h: np.ndarray) -> np.ndarray:
    """16 bits for each function, of its k-mers in text order."""
    if not len(h):
        return np.zeros(SKETCHES, dtype=np.uint16)
    at = np.sort(best[1], axis=0)
    first = np.where(at[0] >= 0, h[at[0]], np.uint64(0))
    return (_mix(first * np.uint64(0xE7037ED1A0B428DB) + h[at[1]]) >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray:
    h = kmers(code_points(text))
    return sketch(least(numbered(h)), h)


def both_fingerprints(c: np.ndarray, edited: np.ndarray, same: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts that begin with the same ``same`` code points; what they share is computed once."""
    h, e = kmers(c), kmers(edited)
    shared = max(0, min(same - K + 1, len(h), len(e)))
    bh, be = numbered(h), numbered(e)
    if not np.array_equal(bh[:shared], be[:shared]):  # only where hashes collide
        shared = 0
    head = least(bh[:shared])
    return sketch(merged(head, least(bh[shared:], shared)), h), sketch(merged(head, least(be[shared:], shared)), e)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Appends ``fingerprint``."""
    return per_text(df, lambda: lambda texts: {"fingerprint": [as_hex(fingerprint(t or "")) for t in texts]}, "fingerprint string", text, raw=False)


#: The place of null ids, before all others.
LEAST = -(1 << 63)


def _bounds(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Bounds of about ``ranges`` even ranges of (k, tie), by quantiles of k, and inside a k that has more rows than two
    ranges should, by even steps of its ties. The driver gets two lines a range at most."""
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()
    if not n:
        return []
    hot = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > max(1, 2 * n // ranges)).collect()
    inside = {(k, LEAST + i * (1 << 64) // parts) for k, m in hot for parts in [-(-m * ranges // n)] for i in range(parts)}
    return sorted({(c, LEAST) for c in cuts} | inside | {(k + 1, LEAST) for k, _ in hot if k < -(LEAST + 1)})


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are at most (k, tie), found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    here = F.struct("k", "tie")
    table = F.array(*(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(tie).alias("tie")) for k, tie in bounds[i : i + step])) for i in range(0, len(bounds), step)))
    group = F.size(F.filter(table, lambda g: F.get(g, 0) <= here))
    return F.when(group == 0, 0).otherwise((group - 1) * step + F.size(F.filter(F.get(table, group - 1), lambda b: b <= here)))


def with_next(df: DataFrame, function, schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``function`` turns an iterator of (id, text, next row's text) into an iterator of result tuples for ``schema``."""
    spark = df.sparkSession
    arrow_session(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("k"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    own = _range_of(_bounds(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a line for each range: its first row goes to the range before, that of the first range to the last
    first = sorted(tuple(r) for r in rows.groupBy(own.alias("range")).agg(F.min(F.struct("k", "tie")).alias("m")).select("range", "m.k", "m.tie").collect())
    places = [F.struct(F.lit(k).alias("k"), F.lit(tie).alias("tie"), F.lit(first[i - 1][0]).alias("to")) for i, (_, k, tie) in enumerate(first)]
    head = F.element_at(F.create_map(*(x for (r, _, _), place in zip(first, places, strict=True) for x in (F.lit(r), place))), own) if first else F.lit(None).cast("struct<k:bigint,tie:bigint,to:int>")
    heads = F.when((head["k"] == F.col("k")) & (head["tie"] == F.col("tie")), F.array(F.struct(head["to"].alias("range"), F.lit(1).alias("ahead")))).otherwise(F.array().cast("array<struct<range:int,ahead:int>>"))
    dealt = rows.select("doc_id", "text", "k", "tie", F.explode(F.concat(F.array(F.struct(own.alias("range"), F.lit(0).alias("ahead"))), heads)).alias("to"))
    dealt = dealt.select("to.range", "to.ahead", "k", "tie", "doc_id", "text").repartition("range").sortWithinPartitions("range", "ahead", "k", "tie")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("range", "ahead", "doc_id", "text")), strict=True):
                if held is not None and held[0] == row[0] and not held[1]:
                    yield held[2], held[3], row[3]
                held = row

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for made in function(pairs(batches)):
            out.append(made)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pydict({n: [m[i] for m in out] for i, n in enumerate(names)})
                out = []
        if out:
            yield pa.RecordBatch.from_pydict({n: [m[i] for m in out] for i, n in enumerate(names)})

    return dealt.mapInArrow(frugal(run), schema)


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Results of a row wait for the next row's, whose fingerprint they need."""
    held: tuple | None = None
    for doc_id, text, after in rows:
        n = len(text)
        cut = n // 4
        edited = text[: n - cut] + after[:cut]
        own, other = both_fingerprints(code_points(text), code_points(edited), n - cut)
        if held is not None:
            made, mine, wanted = held
            yield *made, likeness(mine, own if wanted == text else fingerprint(wanted))
        held = (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), as_hex(own), as_hex(other), likeness(own, other)), own, after
    if held is not None:
        made, mine, wanted = held
        yield *made, likeness(mine, fingerprint(wanted))


def op3_order_minhash(spark, sf_dir):
    return with_next(documents(spark, sf_dir, "doc_id", "text"), _edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
