"""Connected regions of bins that trajectories share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_bins(binned: DataFrame, traj: str) -> DataFrame:
    """a, b: each bin of a trajectory with the trajectory's least: a star, not all pairs."""
    seen = binned.select(traj, "bin").distinct()
    least = seen.groupBy(traj).agg(F.min("bin").alias("b"))
    return seen.join(least, traj).select(F.col("bin").alias("a"), "b").distinct()


def regions(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, region: the least node reached over links (a, b). Nodes are bins: their number is bounded by the grid.

    Least labels are passed on and shortened until nothing changes; a round is
    two small aggregations, and its lineage is cut.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(links.select("a", F.col("a").alias("b"))).distinct()
    label = both.groupBy("a").agg(F.min("b").alias("region"))
    for _ in range(rounds):
        spread = both.join(label.select(F.col("a").alias("b"), F.col("region").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        new = label.join(spread, "a").select("a", F.least("region", "near").alias("region"))
        jump = new.select(F.col("a").alias("region"), F.col("region").alias("further"))
        rows = new.join(jump, "region").select("a", F.col("further").alias("region")).collect()  # a row a bin
        before = {r["a"]: r["region"] for r in label.collect()}
        label = both.sparkSession.createDataFrame(rows, "a int, region int")
        if {r["a"]: r["region"] for r in rows} == before:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return label.select(F.col("a").alias("node"), "region")
