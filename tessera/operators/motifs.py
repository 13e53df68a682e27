"""Bonds, triples, quads and rings over periodic edges, each once up to a shift of the whole by the cell.

Edges are as environments.edges gives them: (frame, i, j, image, d, r), in both
directions. The chains and triples of a point are as many as its pairs of
neighbours, so that a point's neighbours are cut into blocks and pairs of blocks
are joined: a hub's work is shared out. Rings need no such pairs: edges lead
from the end with fewer neighbours to the one with more, and only what leaves a
point is paired.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g

#: Neighbours of a point that are paired with others in one step.
BLOCK = 64


def _none() -> Column:
    return F.array(F.lit(0), F.lit(0), F.lit(0))


def _plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def of_kinds(edge: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """Edges between two points whose kinds are wanted."""
    return edge.where(wanted(F.col("kind_i")) & wanted(F.col("kind_j")))


def bonds(edge: DataFrame) -> DataFrame:
    """Edges, each in one direction only: to the greater point, or to the greater image of the same."""
    return edge.where((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("image") > _none())))


def _blocks(edge: DataFrame) -> DataFrame:
    """frame, i, place (of the neighbour among i's), block, blocks, j, image, d, r."""
    by = Window.partitionBy("frame", "i")
    numbered = edge.withColumn("place", F.row_number().over(by.orderBy("j", "image")) - 1).withColumn("blocks", F.floor((F.count(F.lit(1)).over(by) - 1) / BLOCK))
    return numbered.select("frame", "i", "place", F.floor(F.col("place") / BLOCK).alias("block"), "blocks", "j", "image", "d", "r")


def triples(edge: DataFrame) -> DataFrame:
    """frame, i, a, image_a, d_a, b, image_b, d_b: two different neighbours of i (or images of one), in order."""
    rows = _blocks(edge)
    left = rows.select("frame", "i", F.col("block").alias("x"), F.explode(F.sequence("block", "blocks")).alias("y"), F.col("place").alias("place_a"), F.col("j").alias("a"), F.col("image").alias("image_a"), F.col("d").alias("d_a"))
    right = rows.select("frame", "i", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("x"), F.col("block").alias("y"), F.col("place").alias("place_b"), F.col("j").alias("b"), F.col("image").alias("image_b"), F.col("d").alias("d_b"))
    return left.join(right, ["frame", "i", "x", "y"]).where("place_a < place_b").drop("x", "y", "place_a", "place_b")


def quads(edge: DataFrame) -> DataFrame:
    """frame, a, b, c, d, image_a, image_c, image_d, d_a, d_c, d_d: chains of three bonds without closed ends; images and vectors from b.

    The middle bond meets the neighbours of its one end by blocks, and each
    such chain those of the other end.
    """
    rows = _blocks(edge)
    middle = bonds(edge).select("frame", F.col("i").alias("b"), F.col("j").alias("c"), F.col("image").alias("image_c"), F.col("d").alias("d_c"))
    ends = rows.groupBy("frame", "i").agg(F.max("blocks").alias("last"))
    for end, name in (("b", "a"), ("c", "d")):
        middle = middle.join(ends.select("frame", F.col("i").alias(end), "last"), ["frame", end]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
        there = rows.select("frame", F.col("i").alias(end), "block", F.col("j").alias(name), F.col("image").alias(f"image_{name}"), F.col("d").alias(f"d_{name}"))
        middle = middle.join(there, ["frame", end, "block"]).drop("block")
    middle = middle.withColumn("image_d", _plus(F.col("image_c"), F.col("image_d"))).withColumn("d_d", _plus(F.col("d_c"), F.col("d_d")))
    same = lambda x, y: (F.col(x) == F.col(y)) & (F.col(f"image_{x}") == F.col(f"image_{y}"))
    back = (F.col("d") == F.col("b")) & (F.col("image_d") == _none())
    return middle.where(~same("a", "c") & ~back & ~same("a", "d")).select("frame", "a", "b", "c", "d", "image_a", "image_c", "image_d", "d_a", "d_c", "d_d")


def rings(edge: DataFrame) -> DataFrame:
    """frame, a, b, c, image_b, image_c, d_b, d_c: three points that are all neighbours; images and vectors from a, which has the fewest neighbours."""
    degree = edge.groupBy("frame", "i").agg(F.count(F.lit(1)).alias("k"))
    ranked = edge.join(degree.withColumnRenamed("k", "k_i"), ["frame", "i"]).join(degree.select("frame", F.col("i").alias("j"), F.col("k").alias("k_j")), ["frame", "j"])
    low, high = F.struct("k_i", F.col("i").alias("p")), F.struct(F.col("k_j").alias("k_i"), F.col("j").alias("p"))
    out = ranked.where((low < high) | ((F.col("i") == F.col("j")) & (F.col("image") > _none()))).select("frame", "i", "j", "image", "d", high.alias("rank"))
    one = out.select("frame", F.col("i").alias("a"), F.col("j").alias("b"), F.col("image").alias("image_b"), F.col("d").alias("d_b"), F.col("rank").alias("rank_b"))
    two = out.select("frame", F.col("i").alias("a"), F.col("j").alias("c"), F.col("image").alias("image_c"), F.col("d").alias("d_c"), F.col("rank").alias("rank_c"))
    wedge = one.join(two, ["frame", "a"]).where((F.col("rank_b") < F.col("rank_c")) | ((F.col("rank_b") == F.col("rank_c")) & (F.col("image_b") < F.col("image_c"))))
    closing = out.select("frame", F.col("i").alias("b"), F.col("j").alias("c"), "image")
    return wedge.withColumn("image", _plus(F.col("image_c"), F.col("image_b"), -1)).join(closing, ["frame", "b", "c", "image"]).select("frame", "a", "b", "c", "image_b", "image_c", "d_b", "d_c")


def angle_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(a, b) / (g.length(a) * g.length(b))))
