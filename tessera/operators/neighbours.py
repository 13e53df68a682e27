"""Distance range self-join by a cell list, with aggregation over edges."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(points: DataFrame, key: str, dims: list[str], r: float, frame: str | None = None, box: list[float] | None = None) -> DataFrame:
    """i, j, r (and frame): ordered pairs of different points closer than r.

    Points are dealt to cells of side r, and each is posted to the cells round
    its own, so that the join is an equi-join on frame and cell: by sorting, as
    Catalyst's sizes leave out what explode adds and it would broadcast the
    posted points. With box, the
    lengths of a periodic orthorhombic cell that each hold at least two cells
    of side r, distances are by the nearest image.
    """
    cells = [max(2, int(b / r)) if box else None for b in (box or [None] * len(dims))]
    sides = [b / c for b, c in zip(box, cells, strict=True)] if box else [r] * len(dims)
    at = [F.floor(F.col(d) / F.lit(float(s))) for d, s in zip(dims, sides, strict=True)]
    at = [F.pmod(a, F.lit(c)) if c else a for a, c in zip(at, cells, strict=True)]
    place = F.struct(*[a.alias(f"c{k}") for k, a in enumerate(at)])

    def moved(step: tuple[int, ...]) -> Column:
        parts = []
        for k, (s, c) in enumerate(zip(step, cells, strict=True)):
            x = F.col("cell")[f"c{k}"] + s
            parts.append((F.pmod(x, F.lit(c)) if c else x).alias(f"c{k}"))
        return F.struct(*parts)

    keep = ([F.col(frame).alias("frame")] if frame else []) + [F.col(d).alias(f"x{k}") for k, d in enumerate(dims)]
    left = points.select(F.col(key).alias("i"), *keep, place.alias("cell"))
    around = F.array_distinct(F.array(*[moved(s) for s in product((-1, 0, 1), repeat=len(dims))]))
    right = points.select(F.col(key).alias("j"), *([F.col(frame).alias("frame")] if frame else []), *[F.col(d).alias(f"y{k}") for k, d in enumerate(dims)], place.alias("cell")).withColumn("cell", F.explode(around))
    both = left.hint("merge").join(right, (["frame"] if frame else []) + ["cell"]).where(F.col("i") != F.col("j"))
    parts = []
    for k in range(len(dims)):
        d = F.col(f"y{k}") - F.col(f"x{k}")
        parts.append(d - F.lit(float(box[k])) * F.round(d / F.lit(float(box[k]))) if box else d)
    both = both.withColumn("r", F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts])))
    return both.where(F.col("r") < r).select(*(["frame"] if frame else []), "i", "j", "r")


def per_point(edge: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """i (and more keys), n, value: number and sum over a point's edges."""
    return edge.groupBy("i", *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))


def pairs(edge: DataFrame) -> DataFrame:
    """i < j."""
    return edge.where("i < j")


def triples(edge: DataFrame) -> DataFrame:
    """centre, a, b: two different neighbours a < b of one point."""
    left = edge.select(F.col("i").alias("centre"), F.col("j").alias("a"))
    return left.join(edge.select(F.col("i").alias("centre"), F.col("j").alias("b")), "centre").where("a < b")


def quads(edge: DataFrame) -> DataFrame:
    """a, b, c, d: chains of three pairs, each once, without closed ends."""
    middle = pairs(edge).select(F.col("i").alias("b"), F.col("j").alias("c"))
    out = middle.join(edge.select(F.col("i").alias("b"), F.col("j").alias("a")), "b").join(edge.select(F.col("i").alias("c"), F.col("j").alias("d")), "c")
    return out.where("a <> c and b <> d and a <> d").select("a", "b", "c", "d")


def nearest(edge: DataFrame, k: int) -> DataFrame:
    """Each point's k nearest within the join's range; ties to the smaller j."""
    from pyspark.sql import Window

    return edge.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("r", "j"))).where(F.col("rank") <= k)
