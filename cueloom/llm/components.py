"""Connected components of an edge table, without gathering edges or nodes anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored

#: Rounds after which something must be wrong: each round at least halves the longest path of pointers.
MOST_ROUNDS = 60
#: Edges of a part that one task contracts.
PART_EDGES = 200_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of some edges but the least of its component, itself and that least one."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(i) for i in range(len(nodes))], dtype=np.int64)
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[others], nodes[root[others]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges, those that contracting parts of it leaves."""
    a = b = np.empty(0, dtype=np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 2 * PART_EDGES:
            a, b = contracted(a, b)
            if len(a) > PART_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = np.empty(0, dtype=np.int64)
    if len(a):
        a, b = contracted(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` undirected edges of long ids to ``(node, root)``, root being the least id that edges lead to.

    Parts of about ``PART_EDGES`` edges are contracted first, each in one task, which settles tables of one part. Beyond, large-star
    and small-star steps alternate: each node's larger neighbours are linked to its least neighbour, then its smaller ones
    are, until nothing changes. A step is an aggregation on the node id with partial sums, and a join of the edges with its
    one line a node; where a node with very many edges makes a partition large, adaptive execution splits it. A step's edges
    are never more than those before, and an edge is two numbers. Each round is written to the shared folder, so lost
    executors cost a round. Loops and repeated edges change nothing; no edges give no rows.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    parts = -(-edges.count() // PART_EDGES)
    edges = stored(edges.coalesce(max(1, parts)).mapInArrow(frugal(_contract), "a long, b long"), "edges")
    before = None
    for _ in range(MOST_ROUNDS if parts > 1 else 0):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if parts > 1:
            raise RuntimeError("components didn't settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
