"""What the caption service remembers between requests, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bounded_cache(events: DataFrame, key: str, value: str, order: str, size: int = 50) -> DataFrame:
    """The last value of each of the ``size`` keys that came in last for the first time; a key that comes again keeps its
    place. A top-k over one line a key."""
    keys = events.groupBy(key).agg(F.min(order).alias("first_seen"), F.max_by(value, order).alias("value"))
    return keys.orderBy(F.desc("first_seen"), F.desc(key)).limit(size)


def sticky(value: str, order: str, partition: str | Column) -> Column:
    """The last value of a partition that isn't null, up to this row."""
    w = W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.last_value(F.col(value), F.lit(True)).over(w)


def sticky_over_all(df: DataFrame, value: str, order: str, output: str, ranges: int = 200) -> DataFrame:
    """The last value of the whole table that isn't null, up to this row; ``order`` is a number. Rows are dealt to even ranges
    of it, each range is read in order, and a range begins with the last value of those before, a line a range. Rows of
    equal order are in one range; null orders come first."""
    cuts = df.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    dealt = df.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(order)))))
    last = dealt.where(F.col(value).isNotNull()).groupBy("_range").agg(F.max_by(value, F.struct(F.col(order).isNotNull(), order)).alias("_last"))
    # a line a range at most, so this window is small
    every = df.sparkSession.range(-1, ranges + 1).select(F.col("id").cast("int").alias("_range")).join(last, "_range", "left")
    before = W.partitionBy().orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = every.select("_range", F.last_value(F.col("_last"), F.lit(True)).over(before).alias("_carried"))
    w = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = dealt.join(F.broadcast(carried), "_range", "left")
    return out.withColumn(output, F.coalesce(F.last_value(F.col(value), F.lit(True)).over(w), "_carried")).select(*df.columns, output)
