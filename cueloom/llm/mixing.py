"""Mixing sources to target weights with a temperature (operator 4). Only DataFrame functions run.

A source's share is its part of all tokens, tokens being runs of bytes other than space and 0x09-0x0D. Weights are shares
to the power of an exponent between 0 (all sources equal) and 1 (as they are), normalised. The exponent is the least, by
bisection, that meets all limits given: no source is repeated more than ``repetition`` times its tokens, and the weights'
entropy is at most ``entropy`` times that of equal weights. The budget is ``budget`` tokens, or by default as many as let
every source be taken once as a whole, so that nothing is left out.

Weights become rows in block permutations. A source's part of the budget is so many whole passes (epochs) and a rest. Its
rows are dealt to blocks of about ``BLOCK_ROWS`` by a hash of the id; in each epoch the blocks are ordered by one hash and
the rows in a block by another, and the last epoch takes rows in this order while they fit the rest. The cut is found from
sums of stretches of blocks, of the blocks of one stretch, and then inside one block, so no task orders a source; what a row needs from its
source is one line, which is broadcast up to ``BROADCAST_SOURCES`` sources and otherwise joined with salted keys.

Null sources are one source, ``(none)``. Null texts have no tokens, and rows without tokens come along with each epoch
that covers them. Rows of one id are taken or left together. A source without tokens is taken once. An empty table gives
none. Columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, stored

REPETITION, BISECTIONS, LEVELS = 1.5, 20, 4
BLOCK_ROWS, BROADCAST_SOURCES, SALTS = 256, 50_000, 64
SEED = "mix"


def key(*parts: Column | str) -> Column:
    """60 bits of an MD5 over parts joined by colons."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _meets(a: dict, repetition: float | None, entropy: float | None, budget: float | None) -> bool:
    most = a["high"] / a["low"] if budget is None else a["high"] / a["z"] * budget / a["total"]
    return (repetition is None or most <= repetition) and (entropy is None or a["h"] <= entropy * a["flat"])


def exponent(sources: DataFrame, repetition: float | None, entropy: float | None = None, budget: float | None = None) -> float:
    """Bisects the exponent; each job evaluates all midpoints of LEVELS halvings in one aggregate over the sources."""
    total = F.lit(sources.agg(F.sum("tokens")).first()[0] or 1)
    p = F.col("tokens") / total
    low, high, left = 0.0, 1.0, BISECTIONS
    with_share = sources.where("tokens > 0").select(p.alias("p"), F.lit(1).alias("one"), total.alias("total"))

    def measure(exponents: list[float]) -> list[dict]:
        sums = [F.max("total").alias("total"), F.log(F.sum("one").cast("double")).alias("flat")]
        for i, t in enumerate(exponents):
            power = F.pow("p", F.lit(t))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("p") * t).alias(f"e{i}"), F.max(F.pow("p", F.lit(t - 1))).alias(f"high{i}"), F.min(F.pow("p", F.lit(t - 1))).alias(f"low{i}")]
        r = with_share.agg(*sums).first().asDict()
        if r["z0"] is None:
            return [{"z": 1.0, "h": 0.0, "high": 1.0, "low": 1.0, "total": 1, "flat": 0.0}] * len(exponents)
        return [{"total": r["total"], "flat": r["flat"], "z": r[f"z{i}"], "h": math.log(r[f"z{i}"]) - r[f"e{i}"] / r[f"z{i}"], "high": r[f"high{i}"], "low": r[f"low{i}"]} for i in range(len(exponents))]

    if _meets(measure([0.0])[0], repetition, entropy, budget):
        return 0.0
    while left:
        levels = min(LEVELS, left)
        step = (high - low) / 2**levels
        points = [low + step * i for i in range(1, 2**levels)]
        ok = dict(zip(points, (_meets(a, repetition, entropy, budget) for a in measure(points)), strict=True))
        a, b = 0, 2**levels
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if ok[points[m - 1]] else (m, b)
        low, high, left = low + step * a, low + step * b, left - levels
    return high


def _with_sources(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """Joins what a row needs from its source without gathering a source's rows."""
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "_source")
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"]).drop("_salt")


def plan(df: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: float | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, int]:
    """A line for each source: its weight, budget, whole epochs, blocks and cut; and the number of sources."""
    rows = stored(df.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(source), F.lit("(none)")).alias("_source"), tokens(text).alias("_tokens")), "tokens")
    sources = stored(rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    tau = exponent(sources, repetition, entropy, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(tau))).otherwise(0.0)
    z, least = sources.agg(F.sum(power), F.min(F.when(F.col("tokens") > 0, power / F.col("tokens")))).first()
    whole = budget if budget is not None else (z or 1.0) / (least or 1.0)
    made = sources.withColumn("weight", power / (z or 1.0)).withColumn("budget", F.floor(F.col("weight") * whole + 0.5))
    made = made.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    made = stored(made.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS)).withColumn("exponent", F.lit(tau)), "weights")
    n = made.count()
    placed = _with_sources(rows, made.where("rest > 0").select("_source", "blocks", "epochs", "rest"), n).select("*", *_place())
    sums = stored(placed.groupBy("_source", "rest", "block_key", "block").agg(F.sum("_tokens").alias("sum")), "blocks")
    # the cut's stretch of block keys first, then its block: a window sees at most 4096 stretches, or one stretch's blocks
    stretch = F.shiftright("block_key", 48)
    whole = sums.groupBy("_source", "rest", stretch.alias("stretch")).agg(F.sum("sum").alias("sum"))
    whole = whole.withColumn("upto", F.sum("sum").over(W.partitionBy("_source").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)))
    part = whole.where("upto - sum <= rest and rest < upto").groupBy("_source").agg(F.min(F.struct("stretch", (F.col("upto") - F.col("sum")).alias("before"))).alias("m")).select("_source", F.col("m.stretch").alias("stretch"), F.col("m.before").alias("before"))
    near = F.broadcast if n <= BROADCAST_SOURCES else lambda x: x
    blocks = sums.withColumn("stretch", stretch).join(near(part), ["_source", "stretch"])
    running = blocks.withColumn("upto", F.col("before") + F.sum("sum").over(W.partitionBy("_source").orderBy("block_key", "block").rowsBetween(W.unboundedPreceding, 0)))
    edge = stored(running.where("upto - sum <= rest and rest < upto").groupBy("_source").agg(F.min(F.struct("block_key", "block", (F.col("rest") - F.col("upto") + F.col("sum")).alias("room"))).alias("edge")).select("_source", "edge.*"), "edges")
    inside = placed.join(F.broadcast(edge) if n <= BROADCAST_SOURCES else edge, ["_source", "block_key", "block"])
    order = W.partitionBy("_source").orderBy("row_key", "_id").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = inside.withColumn("upto", F.sum("_tokens").over(order)).where("upto <= room").groupBy("_source").agg(F.max(F.struct("row_key", "_id")).alias("last"))
    cut = edge.join(last, "_source", "left").select("_source", F.struct("block_key", "block").alias("cut_block"), "last")
    return stored(made.join(cut, "_source", "left"), "mixture"), n


def _place(epoch: Column | None = None) -> list[Column]:
    """Block of a row, and the hashes that order blocks and rows in an epoch."""
    e = F.col("epochs") if epoch is None else epoch
    block = F.pmod(key("block", F.col("_id")), F.col("blocks"))
    return [block.alias("block"), key("order", e, F.col("_source"), block).alias("block_key"), key("row", e, F.col("_id")).alias("row_key")]


def mix(df: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: float | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id", details: bool = True) -> DataFrame:
    """The rows of ``df``, each as often as the mixture takes it. With ``details``, ``epoch``, ``block``, ``block_key`` and
    ``row_key`` are appended; an epoch's order is that of (block_key, block, row_key, id)."""
    mixture, n = plan(df, repetition, entropy, budget, text, source, doc_id)
    new = ["epoch", "block", "block_key", "row_key"] if details else []
    kept = [c for c in df.columns if c not in new]
    rows = df.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(source), F.lit("(none)")).alias("_source"), F.struct(*kept).alias("_row"))
    rows = _with_sources(rows, mixture.select("_source", "blocks", "epochs", "rest", "cut_block", "last"), n)
    block, block_key, row_key = _place()
    at = F.struct(block_key.alias("block_key"), block.alias("block"))
    partial = F.coalesce((at < F.col("cut_block")) | ((at == F.col("cut_block")) & (F.struct(row_key.alias("row_key"), F.col("_id")) <= F.col("last"))), F.lit(False))
    times = F.col("epochs") + F.when((F.col("rest") > 0) & partial, 1).otherwise(0)
    out = rows.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    return out.select("_row.*", *(["epoch", *_place(F.col("epoch"))] if details else []))


def op4_temperature_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "epoch", "block", "block_key", "row_key")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce(source, '(none)') AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
s AS (SELECT src, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS nrows FROM t GROUP BY src),
g AS (SELECT sum(tokens)::DOUBLE AS total, min(tokens) FILTER (tokens > 0)::DOUBLE AS least, max(tokens)::DOUBLE AS most FROM s),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, pow(most / least, 1.0) <= 1.5 AS flat FROM g
  UNION ALL
  SELECT step + 1, CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= 1.5 THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= 1.5 THEN (lo + hi) / 2 ELSE hi END, flat FROM b, g WHERE step < 20),
tau AS (SELECT CASE WHEN flat THEN 0.0 ELSE hi END AS tau FROM b WHERE step = 20),
p AS (SELECT src, tokens, nrows, CASE WHEN tokens > 0 THEN pow(tokens / total, tau) ELSE 0 END AS power FROM s, g, tau),
z AS (SELECT sum(power) AS z, min(power / tokens) FILTER (tokens > 0) AS least FROM p),
w AS (SELECT src, tokens, CAST(ceil(nrows / 256.0) AS BIGINT) AS blocks, CAST(floor(power / z * (z / least) + 0.5) AS BIGINT) AS budget FROM p, z),
m AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END * tokens AS rest FROM w),
d AS (SELECT t.*, m.epochs, m.rest, CAST(('0x' || substr(md5('mix:block:' || doc_id), 1, 15)) AS BIGINT) % blocks AS block FROM t JOIN m USING (src)),
k AS (SELECT *, CAST(('0x' || substr(md5('mix:order:' || epochs || ':' || src || ':' || block), 1, 15)) AS BIGINT) AS bk, CAST(('0x' || substr(md5('mix:row:' || epochs || ':' || doc_id), 1, 15)) AS BIGINT) AS rk FROM d),
c AS (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY bk, block, rk, doc_id ROWS UNBOUNDED PRECEDING) AS upto,
      sum(n) OVER (PARTITION BY src ORDER BY bk, block RANGE UNBOUNDED PRECEDING) AS block_upto FROM k),
x AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM c),
e AS (SELECT doc_id, source, src, block, unnest(range(times)) AS epoch FROM x)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block,
  CAST(('0x' || substr(md5('mix:order:' || epoch || ':' || src || ':' || block), 1, 15)) AS BIGINT) AS block_key,
  CAST(('0x' || substr(md5('mix:row:' || epoch || ':' || doc_id), 1, 15)) AS BIGINT) AS row_key FROM e
"""
