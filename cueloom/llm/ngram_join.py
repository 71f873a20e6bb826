"""N-gram Jaccard join with T-occurrence search (operator 5).

Two texts link when their sets of distinct 5-word shingles A, B have 100 * |A & B| >= 80 * |A | B|. Every link between
different sets is found; equal sets are one node from the start. The steps:

1. *Sets.* One pass gives each row its set's size, a 64-bit name of the set, and a parity bitmap of about two bits a
   shingle; and a fixed-size count sketch of shingles over all rows, which only orders shingles and never decides.
2. *Short lists.* Linked sets share a shingle among their ``n - ceil(0.8 n) + 1`` rarest ones, whatever the order, as
   long as all use the same. These go to lists by shingle; a list with one set is no more needed. A list is read as a
   sorted stream, never held.
3. *Groups.* Members of a list are compared with its first set by bitmaps: the Hamming distance of two parity bitmaps is
   at most the size of the sets' symmetric difference, which linked sets bound by a ninth of their sizes' sum. Who passes
   joins the first set's group, so that many near copies are one group and their lists hold one entry.
4. *Bundles.* Two groups in a list are kept apart only if their bitmaps, less both radii, prove that no member of one
   links to a member of the other. For that they are folded to the length of either group's smallest set, at which both
   radii hold. Components of the rest are bundles: all links lie inside them.
5. *Search.* Only bundles' shingle sets are shipped, in blocks of about ``BLOCK`` sets, and with each block of a larger
   bundle a few sets of the whole bundle (pivots), so that its near copies become one class through these. Then all sets of
   such a bundle but those of its largest class are queried, in chunks, against all of its blocks: a link between two sets that were
   not queried lies inside that class, so none is lost that matters. What is shipped again grows with the sets outside,
   not with the square of the bundle. DivideSkip: the query's longest inverted lists are set aside, the short ones merged
   with a heap to those that occur often enough, and these looked up in the long lists by binary search. In a block, a
   first pass leaves out sets already known to be connected to the class that is largest then; a second one queries all of
   these but the members of one class.
6. *Classes.* Components of the links found, with the least ``doc_id``.

Lists of very many groups are compared in parts, a pair of parts a task, so a task holds at most ``2 * LIST_PART`` bitmaps.

Shingles and sets are known by 64-bit hashes: a chance collision of two shingles counts only if both are in a compared
pair, one of two sets' names has odds of about rows**2 / 2**65. Rows with null or blank text have an empty set and are
alone. Rows with a null id take part but give none: their class is that of the least non-null id, else null.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, documents, frugal, slices, stored, text_bytes
from .components import components
from .shingles import shingle_sets

WORDS, PERCENT = 5, 80
#: Buckets of the count sketch (as powers of two), by the number of rows; the greatest is 8 MB on the driver.
SKETCH_BITS, SKETCH_PARTS = (20, 23), 16
#: Sets in a block, sets of a bundle that are searched along with each of its blocks, and groups in a part of a list.
BLOCK, PIVOTS, LIST_PART = 256, 8, 512
#: Up to so many rows, where sets go is broadcast (some 24 bytes a row); beyond, it is joined by a shuffle.
BROADCAST_SETS = 400_000
#: Bits of the filter that keeps most unneeded sets from being shipped (as powers of two), by their number; the greatest is
#: 32 MB. A set it lets through by chance is dropped later.
FILTER_BITS = (20, 28)
#: DivideSkip's weight of a binary search against a heap step (a constant of the method).
MU = 0.0085


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT):
    """The least intersection with which sets of n and m shingles link."""
    return -((-percent * (n + m)) // (100 + percent))


def name_of(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    if not len(s):
        return 0
    x = int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29)))) + int(s.sum(dtype=np.uint64)) * 0xD1342543DE82EF95 + len(s)
    return struct.unpack("<q", struct.pack("<Q", x & (1 << 64) - 1))[0]


def bitmap_bits(n: int) -> int:
    return max(64, 1 << max(0, 2 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles at each of 64 or more bits, a power of two of at least twice the set's size."""
    bits = bitmap_bits(len(s))
    at = (s >> np.uint64(11)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(b: np.ndarray, size: int) -> np.ndarray:
    while len(b) > size:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def hamming(a: bytes, b: bytes, most: int | None = None) -> int:
    """Hamming distance at the shorter length, or at ``most`` bits if that is less."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y), most // 8 if most else len(x))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())


def _power(n: int, limits: tuple[int, int]) -> int:
    """The least power of two that holds n, within limits."""
    return min(max(limits[0], max(1, n - 1).bit_length()), limits[1])


def _bucket(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, text):
            yield part, shingle_sets(text_bytes(part, text), WORDS)


_META = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def _describe(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for part, sets in _sets(batches, "text"):
            sigs, met = [], set()
            maps = []
            for s in sets:
                sig = name_of(s)
                sigs.append(sig)
                if sig not in met:  # once a slice: bitmaps and counts of copies add nothing
                    met.add(sig)
                    np.add.at(counts, _bucket(s, bits), 1)
                    maps.append(bitmap(s))
                else:
                    maps.append(None)
            k = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int64()), part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_META)
        size = len(counts) // SKETCH_PARTS
        for i in range(SKETCH_PARTS):
            blob = counts[i * size : (i + 1) * size]
            if blob.any():
                yield pa.RecordBatch.from_pylist([{"row": 1, "part": i, "counts": zlib.compress(blob.tobytes(), 1)}], schema=_META)

    return run


def _sketch(meta: DataFrame, bits: int) -> np.ndarray:
    """Orders of magnitude of the counts, eight steps to an octave, a byte each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), dtype="<u4").astype(np.int64)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "counts": np.minimum(255, np.rint(8 * np.log2(x + 1))).astype(np.uint8).tobytes()}], schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    rows = meta.where("row = 1").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(frugal(add), "part int, counts binary").collect()
    out = np.zeros(1 << bits, dtype=np.uint8)
    size = len(out) // SKETCH_PARTS
    for part, blob in rows:
        out[part * size : (part + 1) * size] = np.frombuffer(blob, dtype=np.uint8)
    return out


def _short_lists(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(h, sig, n): each set under its rarest shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        bits = len(often).bit_length() - 1
        for _, sets in _sets(batches, "text"):
            keys, sigs, sizes, met = [], [], [], set()
            for s in sets:
                n = len(s)
                sig = name_of(s)
                if not n or sig in met:
                    continue
                met.add(sig)
                p = n - -(-PERCENT * n // 100) + 1
                order = np.lexsort((s, often[_bucket(s, bits)]))[:p]
                keys.append(s[order].view(np.int64))
                sigs.append(np.full(p, sig, np.int64))
                sizes.append(np.full(p, n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sigs, sizes)], names=["h", "sig", "n"])

    return docs.mapInArrow(frugal(run), "h long, sig long, n long")


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, sig): those of lists with two sets or more, each once, with the list's first set."""
    held = first = last = None
    for batch in batches:
        h, sig = (batch.column(i).to_numpy() for i in (0, 1))
        if held is not None:
            h, sig = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], sig])
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
        h, sig = h[fresh], sig[fresh]
        start = np.ones(len(h), dtype=bool)
        start[1:] = h[1:] != h[:-1]
        lead = sig[np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))]
        if first is not None and len(h) and h[0] == first[0]:
            lead[: int(np.argmax(start[1:])) + 1 if start[1:].any() else len(h)] = first[1]
        # the last row waits for the next batch, which tells whether its list goes on
        many = lead != sig
        many[:-1] |= h[:-1] == h[1:]
        held, first = (h[-1], sig[-1]), (h[-1], lead[-1])
        out = slice(0, len(h) - 1)
        keep = np.flatnonzero(many[out])
        last = lead[-1] != sig[-1]
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(x[out][keep]) for x in (h, sig, lead)], names=["h", "sig", "lead"])
    if held is not None and last:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (held[0], held[1], first[1])], names=["h", "sig", "lead"])


def _distance_column(df: DataFrame) -> DataFrame:
    """Appends ``ham``, the Hamming distance of ``bits`` and ``lead_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ham = [hamming(x, y) for x, y in zip(b.column("bits").to_pylist(), b.column("lead_bits").to_pylist(), strict=True)]
            keep = [i for i, n in enumerate(b.schema.names) if n not in ("bits", "lead_bits")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(ham, pa.int64())], names=[*(b.schema.names[i] for i in keep), "ham"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ("bits", "lead_bits")) + ", ham long"
    return df.mapInArrow(frugal(run), schema)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, g, low, high, radius, bits) sorted by h, a list or a pair of its parts: pairs of groups that bitmaps can't
    keep apart."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        out = []
        rows.sort(key=lambda r: r[2])
        parent = list(range(len(rows)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, (_, g, low, high, radius, bits) in enumerate(rows):
            for j in range(i):
                _, g2, low2, high2, radius2, bits2 = rows[j]
                if high2 * 100 < low * PERCENT or find(i) == find(j):
                    continue
                # a radius was taken at its member's length or its leader's: it holds at no more bits than the smallest set's
                if hamming(bits, bits2, bitmap_bits(min(low, low2))) <= radius + radius2 + (high + high2) * (100 - PERCENT) // (100 + PERCENT):
                    parent[find(i)] = find(j)
                    out.append((g, g2))
        return out

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        return pairs(rows) if len(rows) > 1 else []

    rows: list[tuple] = []
    for b in batches:
        made: list[tuple[int, int]] = []
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and rows[0][0] != r[0]:
                made += flush(rows)
                rows = []
            rows.append(r)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], names=["a", "b"])
    if made := flush(rows):
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], names=["a", "b"])


class Index:
    """Inverted lists of a few sets, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.keys, self.at = every[at], np.append(at, len(every))

    def linked(self, q: int) -> np.ndarray:
        """The sets other than q that link to it."""
        n = int(self.sizes[q])
        slots = np.searchsorted(self.keys, self.sets[q])
        starts, ends = self.at[slots], self.at[slots + 1]
        lengths = ends - starts
        need = -(-PERCENT * n // 100)  # with the smallest partner
        several = lengths > 1
        if several.sum() < need:
            return np.empty(0, dtype=np.int64)
        order = np.argsort(lengths[several], kind="stable")
        starts, ends, lengths = starts[several][order], ends[several][order], lengths[several][order]
        aside = min(need - 1, int(need / (MU * np.log2(lengths[-1]) + 1)), len(lengths) - 1)
        short = len(lengths) - aside
        lists = [self.owner[a:b] for a, b in zip(starts[:short].tolist(), ends[:short].tolist(), strict=True)]
        found, counts = _merge(lists)
        keep = (counts >= need - aside) & (found != q)
        found, counts = found[keep], counts[keep]
        wanted = least_overlap(n, self.sizes[found])
        for a, b in zip(starts[short:].tolist(), ends[short:].tolist(), strict=True):
            if not len(found):
                break
            where = np.searchsorted(self.owner[a:b], found)
            counts += self.owner[a + np.minimum(where, b - a - 1)] == found
        return found[(counts >= wanted) & (wanted <= np.minimum(n, self.sizes[found]))]


def _merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and in how many lists each is. A heap of the lists' heads merges few entries; for many,
    numpy's run-merging sort of the lists laid end to end does the same."""
    total = sum(map(len, lists))
    if total > 256:
        merged = np.sort(np.concatenate(lists), kind="stable")
    else:
        merged = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), dtype=np.int64, count=total)
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    return merged[at], np.diff(np.append(at, total))


def classes(sets: list[np.ndarray], block: np.ndarray | None = None) -> list[int]:
    """For each set the first set of its class. With two blocks, links inside a block are left to other calls unless they
    come up; classes then only hold what this call has seen."""
    index = Index(sets)
    parent = list(range(len(sets)))
    members = [1] * len(sets)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def query(q: int) -> None:
        for r in index.linked(q).tolist():
            a, b = find(q), find(r)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
                members[a] += members[b]

    largest, left = 0, []
    for q in range(len(sets)):
        if q and find(q) == find(largest):
            left.append(q)
            continue
        query(q)
        if members[find(q)] > members[find(largest)]:
            largest = q
    for q in left:  # the class left out is the same one from here on
        if find(q) != find(largest):
            query(q)
    return [find(i) for i in range(len(sets))]


def crossed(sets: list[np.ndarray], asked: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each of ``asked`` its links to ``sets``, as places, one for each of their classes as far as this call finds them."""
    index = Index([*sets, *asked])
    parent = list(range(len(sets) + len(asked)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for q in range(len(sets), len(sets) + len(asked)):
        for r in index.linked(q).tolist():
            a, b = find(q), find(r)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((q, r))
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (task, sig, asked, shingles) sorted by task and set: links as (a, b). Where some sets are asked for, their
    links; else one for each set and its class."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        asked = [i for i, r in enumerate(rows) if r[2]]
        if not asked:
            return [(rows[i][1], rows[j][1]) for i, j in enumerate(classes(sets)) if i != j]
        order = [i for i, r in enumerate(rows) if not r[2]] + asked
        found = crossed([sets[i] for i in order[: -len(asked)]], [sets[i] for i in asked])
        return [(rows[order[q]][1], rows[order[r]][1]) for q, r in found]

    task, rows = None, []
    for b in batches:
        made: list[tuple[int, int]] = []
        for r in zip(*(b.column(c).to_pylist() for c in ("task", "sig", "asked", "shingles")), strict=True):
            if r[0] != task:
                made += flush(rows)
                task, rows = r[0], []
            if not rows or rows[-1][1] != r[1]:
                rows.append(r)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], names=["a", "b"])
    if made := flush(rows):
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _needed_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(sig, shingles) of rows whose set is needed, and a few others, found with a filter."""
    power = _power(16 * needed.count(), FILTER_BITS)
    bits = 1 << power

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=np.uint8)
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            seen[(x >> np.uint64(64 - power)).astype(np.int64)] = 1
        yield pa.RecordBatch.from_pylist([{"seen": zlib.compress(np.packbits(seen).tobytes(), 1)}])

    marks = np.zeros(bits // 8, dtype=np.uint8)
    for (blob,) in needed.select("sig").coalesce(32).mapInArrow(frugal(mark), "seen binary").toLocalIterator():
        marks |= np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for _, sets in _sets(batches, "text"):
            sigs, out, met = [], [], set()
            for s in sets:
                sig = name_of(s)
                at = (sig & (1 << 64) - 1) >> (64 - power)
                if sig not in met and marks[at >> 3] >> (7 - (at & 7)) & 1:
                    met.add(sig)
                    sigs.append(sig)
                    out.append(s.tobytes())
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(out, pa.binary())], names=["sig", "shingles"])

    return docs.mapInArrow(frugal(run), "sig long, shingles binary")


def _links(shingles: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b) of the sets that ``placed`` (sig, task, asked) brings together."""
    placed = stored(placed, "placed")
    near = F.broadcast if placed.count() <= BROADCAST_SETS else lambda x: x
    shipped = shingles.join(near(placed), "sig").select("task", "sig", "asked", "shingles")
    return stored(shipped.repartition("task").sortWithinPartitions("task", "sig").mapInArrow(frugal(_search), "a long, b long"), "links")


def _linked(docs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Links of the sets in (sig, bundle, sets), enough of them to make up all classes."""
    bundles = stored(bundles.withColumn("blocks", F.ceil(F.col("sets") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")), "bundles")
    shingles = stored(_needed_sets(docs.select("text"), bundles), "shingles")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = bundles.where("blocks > 1")
    pivots = large.where(F.pmod(F.xxhash64("sig", F.lit(3)), F.col("sets")) < PIVOTS).withColumn("block", every("blocks"))
    placed = bundles.union(pivots.select(bundles.columns)).select("sig", F.xxhash64("bundle", "block").alias("task")).distinct()
    links = _links(shingles, placed.withColumn("asked", F.lit(False)))
    # what is outside a large bundle's largest class: in chunks, against all of its blocks
    found = components(links.join(large.select(F.col("sig").alias("a")), "a", "left_semi"))
    classed = large.join(found.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    classed = stored(classed, "classed")
    largest = classed.groupBy("bundle", "root").agg(F.count("*").alias("k")).groupBy("bundle").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all"))
    largest = largest.select("bundle", F.col("m.root").alias("largest"), F.ceil((F.col("all") - F.col("m.k")) / BLOCK).cast("int").alias("chunks")).where("chunks > 0")
    classed = stored(classed.join(largest, "bundle"), "outside")
    if classed.isEmpty():
        return links
    task = F.xxhash64("bundle", "block", "chunk")
    asked = classed.where("root <> largest").withColumn("chunk", F.pmod(F.xxhash64("sig", F.lit(4)), F.col("chunks")).cast("int")).withColumn("block", every("blocks"))
    held = classed.withColumn("chunk", every("chunks"))
    placed = asked.select("sig", task.alias("task"), F.lit(True).alias("asked")).union(held.select("sig", task.alias("task"), F.lit(False).alias("asked")))
    return links.union(_links(shingles, placed.groupBy("task", "sig").agg(F.max("asked").alias("asked"))))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: Column | None = None, details: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``df``. With ``details`` also ``mark``, a long that is passed
    on for each row, and ``class_id``, the name of the row's class of sets, null for an empty set."""
    arrow_session(df.sparkSession)
    marked = F.lit(None).cast("long") if mark is None else mark
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), marked.alias("mark"), F.col(text).alias("text"))
    bits = _power(df.count(), SKETCH_BITS)
    meta = stored(docs.mapInArrow(frugal(_describe(bits)), "row long, doc_id long, mark long, n long, sig long, bits binary, part int, counts binary"), "sets")
    rows = meta.where("row = 0")
    lists = _short_lists(docs.select("text"), _sketch(meta, bits))
    lists = stored(lists.select("h", "sig").repartition("h").sortWithinPartitions("h", "sig").mapInArrow(frugal(_shared_lists), "h long, sig long, lead long"), "lists")

    nodes = rows.where("n > 0 and bits is not null").groupBy("sig").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    nodes = stored(nodes.join(lists.select("sig").union(lists.select(F.col("lead").alias("sig"))).distinct(), "sig", "left_semi"), "nodes")
    # groups: a set goes to the least list leader that it may link to, if that leader has no such leader itself
    lead = nodes.select(F.col("sig").alias("lead"), F.col("n").alias("lead_n"), F.col("bits").alias("lead_bits"))
    tried = lists.where("sig <> lead").select("sig", "lead").distinct().join(nodes, "sig").join(lead, "lead")
    passed = stored(_distance_column(tried.select("sig", "lead", "n", "lead_n", "bits", "lead_bits")).where(f"100 * least(n, lead_n) >= {PERCENT} * greatest(n, lead_n) and ham <= (n + lead_n) * {100 - PERCENT} div {100 + PERCENT}"), "passed")
    own = passed.groupBy("sig").agg(F.min(F.struct("lead", "ham")).alias("m")).select("sig", F.col("m.lead").alias("lead"), F.col("m.ham").alias("ham"))
    roots = own.select(F.col("sig").alias("lead")).distinct()
    followers = own.join(roots, "lead", "left_anti")
    groups = stored(nodes.select("sig", "n").join(followers, "sig", "left").select("sig", "n", F.coalesce("lead", "sig").alias("g"), F.coalesce("ham", F.lit(0)).alias("ham")), "groups")
    about = groups.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("ham").alias("radius"))
    about = about.join(nodes.select(F.col("sig").alias("g"), "bits"), "g")
    # bundles: groups that meet in a list and can't be kept apart
    met = stored(lists.select("h", "sig").join(groups.select("sig", "g"), "sig").select("h", "g").distinct(), "met")
    # lists of the same groups tell the same: one of them stays
    shape = met.groupBy("h").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y")).where("k > 1")
    several = shape.groupBy("k", "x", "y").agg(F.min("h").alias("h")).select("h", "k")
    parts = F.ceil(F.col("k") / LIST_PART).cast("int")
    part = F.pmod(F.xxhash64("g", F.lit(2)), parts).cast("int")
    pair = F.xxhash64("h", F.least(part, F.col("other")), F.greatest(part, F.col("other")))
    meetings = met.join(several, "h").withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(F.when(F.col("k") <= LIST_PART, F.col("h")).otherwise(pair).alias("h"), "g")
    meetings = meetings.join(about, "g").select("h", "g", "low", "high", "radius", "bits")
    ties = meetings.repartition("h").sortWithinPartitions("h").mapInArrow(frugal(_may_link), "a long, b long")
    tied = components(ties)
    bundles = groups.join(tied.select(F.col("node").alias("g"), F.col("root")), "g", "left").select("sig", F.coalesce("root", "g").alias("bundle"))
    sizes = bundles.groupBy("bundle").agg(F.count("*").alias("sets")).where("sets > 1")
    linked = components(_linked(docs, bundles.join(sizes, "bundle")))
    # classes: the least id of each set, then of each class
    least = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = least.join(linked.select(F.col("node").alias("sig"), "root"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(whole, "root").select("sig", "component_id", "root")
    out = rows.select("doc_id", "mark", F.col("n").alias("n_shingles"), "sig").join(named, "sig", "left")
    more = ["mark", F.when(F.col("n_shingles") > 0, F.col("root")).alias("class_id")] if details else []
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def op5_ngram_join(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
