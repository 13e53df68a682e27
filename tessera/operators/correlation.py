"""Correlation of long trajectories: by blocks that meet later blocks, with sums a lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut

#: Copies of what is joined to a trajectory's blocks, so that a long one is spread over as many tasks.
SPREAD = 32


def numbered(rows: DataFrame, traj: str, order: list[str], name: str = "row_no") -> DataFrame:
    """rows with their number in their trajectory, from 0, however long one is.

    Sorted into ranges of trajectory and order; only the counts by range and
    trajectory are summed over a whole trajectory.
    """
    parted = cut(rows.repartitionByRange(traj, *order).withColumn("range_no", F.spark_partition_id()))
    earlier = Window.partitionBy(traj).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy(traj, "range_no").agg(F.count(F.lit(1)).alias("in_range")).withColumn("before", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(traj, "range_no").orderBy(*order)) - 1
    return parted.join(counts.drop("in_range"), [traj, "range_no"]).withColumn(name, F.col("before") + within).drop("range_no", "before")


def blocks(rows: DataFrame, traj: str, order: list[str], column: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Each trajectory's n, mean and whether it is constant; and its blocks k of `size` deviations from the mean, with n."""
    own = rows.select(F.col(traj).alias("traj"), *[F.col(c).alias(f"order_{k}") for k, c in enumerate(order)], F.col(column).cast("double").alias("x")).dropna(subset=["traj", "x"])
    inner = cut(numbered(own, "traj", [f"order_{k}" for k in range(len(order))]).select("traj", "row_no", "x"))
    stats = cut(inner.groupBy("traj").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.min("x") == F.max("x")).alias("constant")))
    packed = inner.groupBy("traj", F.floor(F.col("row_no") / size).alias("k")).agg(F.sort_array(F.collect_list(F.struct("row_no", "x"))).alias("rows"))
    spread = stats.select("traj", "n", "mean", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    placed = packed.withColumn("salt", (F.col("k") % SPREAD).cast("int")).join(spread, ["traj", "salt"])
    return stats, cut(placed.select("traj", "k", "n", F.transform("rows", lambda r: r["x"] - F.col("mean")).alias("dev")))


def lag_sums(chunks: DataFrame, size: int, first: int, end: int) -> DataFrame:
    """traj, lag, v: sums of products of deviations `lag` rows apart, for lags from first * size up to end * size.

    Block k meets blocks k + first to k + end, each pair in one transform.
    """
    left = chunks.select("traj", "n", F.col("dev").alias("a"), "k", F.explode(F.sequence(F.lit(first), F.lit(end))).alias("d")).withColumn("k", F.col("k") + F.col("d"))
    pairs = left.join(chunks.select("traj", "k", F.col("dev").alias("b")), ["traj", "k"]).select("traj", "n", "d", "a", "b")
    kind = chunks.schema["traj"].dataType.simpleString()

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found: dict[tuple, np.ndarray] = {}
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                x, y = np.zeros((b.num_rows, 2 * size)), np.zeros((b.num_rows, 2 * size))
                for grid, name in ((x, "a"), (y, "b")):
                    lengths = np.diff(b.column(name).offsets.to_numpy())
                    grid[np.arange(2 * size) < lengths[:, None]] = b.column(name).flatten().to_numpy(zero_copy_only=False)
                products = np.fft.irfft(np.conj(np.fft.rfft(x)) * np.fft.rfft(y), 2 * size)
                for row, name, n, d in zip(products, b.column("traj").to_pylist(), b.column("n").to_pylist(), b.column("d").to_pylist(), strict=True):
                    ahead, behind = row[:size], np.concatenate([[0.0], row[size + 1 :]])  # lags d * size + 0, 1, ...; and those of the block before
                    for j, v in ((d, ahead), (d - 1, behind)):
                        if first <= j < end:
                            key = (name, n, j)
                            found[key] = found[key] + v if key in found else v
            if found:
                names, n, j = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, whole.schema.field("traj").type), pa.array(n, pa.int64()), pa.array(j, pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["traj", "n", "j", "v"])

    sums = pairs.mapInArrow(crossed, f"traj {kind}, n long, j int, v array<double>").select("traj", "n", "j", F.posexplode("v").alias("t", "v"))
    lag = F.col("j").cast("long") * size + F.col("t")
    return sums.withColumn("lag", lag).where("lag < n").groupBy("traj", "lag").agg(F.sum("v").alias("v"))


def inefficiency(rows: DataFrame, traj: str, order: list[str], column: str, size: int = 1024) -> DataFrame:
    """traj, n, g: each trajectory's statistical inefficiency, 1 + 2 sum of its autocorrelation up to the first that isn't positive.

    Blocks of `size` rows meet the blocks that hold their later partners: first
    the nearest lags for all trajectories, then twice as many more for those
    whose autocorrelation is positive still, until none is left. No task holds
    a trajectory. Rows without trajectory or value count as nothing; constant
    trajectories, and those of fewer than three rows, have g = 1.
    """
    stats, chunks = blocks(rows, traj, order, column, size)
    state = stats.select("traj", "n", (F.col("constant") | (F.col("n") < 3)).alias("settled"), F.lit(None).cast("double").alias("square"), F.lit(0.0).alias("total"))
    first, end = 0, 1
    while True:
        open_ones = state.where("not settled").select("traj", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
        live = chunks.withColumn("salt", (F.col("k") % SPREAD).cast("int")).join(open_ones, ["traj", "salt"], "left_semi").drop("salt")
        sums = cut(lag_sums(live, size, first, end))
        stops = sums.groupBy("traj").agg(F.min(F.when(F.col("v") <= 0, F.col("lag"))).alias("stop"))
        before = F.col("stop").isNull() | (F.col("lag") < F.col("stop"))
        found = sums.join(stops, "traj").groupBy("traj").agg(F.first("stop").alias("stop"), F.max(F.when(F.col("lag") == 0, F.col("v"))).alias("zero"), F.sum(F.when(before & (F.col("lag") > 0), F.col("v")).otherwise(0.0)).alias("more"))
        both = state.join(found, "traj", "left")
        settled = F.col("settled") | F.col("stop").isNotNull() | (F.col("n") <= end * size)
        state = cut(both.select("traj", "n", settled.alias("settled"), F.coalesce("square", "zero").alias("square"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
        if state.where("not settled").isEmpty():
            break
        first, end = end, 2 * end + 1
    g = F.when(F.col("square") > 0, F.greatest(F.lit(1.0), 1 + 2 * F.col("total") / F.col("square"))).otherwise(1.0)
    return state.select(F.col("traj").alias(traj), "n", g.alias("g"))
