"""Weighted sampling with replacement, without random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def systematic(rows: DataFrame, key: str, weight: str, size: int, buckets: int = 64) -> DataFrame:
    """m, key: the row whose stretch of the running weight holds (m - 1/2) / size, for m = 1 ... size.

    Expected counts are in proportion to the weights; null, NaN, infinite and
    non-positive weights are never drawn. The running weight is worked out in
    buckets of the key: sums by bucket first (buckets rows), then within.
    """
    w = F.col(weight).cast("double")
    good = rows.where(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))).select(key, w.alias("sw"))
    lo, hi = good.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return good.select(F.lit(0).alias("m"), key).limit(0)
    span = max(1, (hi - lo) // buckets + 1)
    good = good.withColumn("bucket", F.floor((F.col(key) - F.lit(lo)) / span))
    sums = good.groupBy("bucket").agg(F.sum("sw").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket"))  # buckets rows
    total = sums.agg(F.sum("in_bucket").alias("all"))
    cdf = good.join(F.broadcast(sums.drop("in_bucket")), "bucket").crossJoin(F.broadcast(total))
    run = F.col("before") + F.sum("sw").over(Window.partitionBy("bucket").orderBy(key))
    ends = cdf.select(key, (run / F.col("all")).alias("hi"), (F.col("sw") / F.col("all")).alias("p"))
    first, last = F.floor((F.col("hi") - F.col("p")) * size + 0.5), F.floor(F.col("hi") * size + 0.5)
    draws = ends.select(key, F.greatest(first, F.lit(0)).cast("int").alias("a"), F.least(last, F.lit(size)).cast("int").alias("b")).where("b > a")
    return draws.select(F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("m"), key)
