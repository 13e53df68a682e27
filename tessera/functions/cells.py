"""Operations on periodic frames that can be kept and replayed: reductions, turns and shifts, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def apply_reduction(op: Column, cell: Column) -> Column:
    """op @ cell: the lattice basis that whole-number rows make."""
    return F.transform(op, lambda row: g.row_times(row, cell))


def turned(cell: Column) -> Column:
    """The rotation (rows) that brings a cell to lower triangular form with a positive diagonal: by Gram-Schmidt over its vectors.

    Row k is the k-th new axis, so new = old @ rotation^T.
    """
    scaled = lambda v, s: F.transform(v, lambda x: x * s)
    unit = lambda v: once(v, lambda w: scaled(w, 1 / g.length(w)))

    def axes(m: Column) -> Column:
        a, b, c = (g.at(m, k) for k in range(3))
        first = once(unit(a), lambda e1: F.array(e1, unit(g.minus(b, scaled(e1, g.dot(b, e1))))))
        third = lambda e: once(g.cross(g.at(e, 0), g.at(e, 1)), lambda e3: scaled(e3, F.when(g.dot(c, e3) < 0, -1.0).otherwise(1.0)))
        return once(first, lambda e: F.array(g.at(e, 0), g.at(e, 1), third(e)))

    return once(cell, axes)


def apply_rotation(rotation: Column, rows: Column) -> Column:
    """Each row (of positions or of a cell) along the new axes."""
    return F.transform(rows, lambda p: F.array(*[g.dot(p, g.at(rotation, k)) for k in range(3)]))


def wrap_shift(relative: Column, centred: bool = False) -> Column:
    """The whole shift that brings each relative position into [0, 1), or centred into [-1/2, 1/2)."""
    move = 0.5 if centred else 0.0
    return F.transform(relative, lambda p: F.transform(p, lambda x: -F.floor(x + move).cast("double")))


def apply_wrap(shift: Column, positions: Column, cell: Column) -> Column:
    """positions + shift @ cell."""
    return F.zip_with(positions, shift, lambda p, s: F.zip_with(p, g.row_times(s, cell), lambda x, y: x + y))


def canonical_steps(positions: Column, cell: Column, reduction: Column, centred: bool = False) -> Column:
    """The reduction, turn and shifts that make a frame canonical, to be replayed on others by apply_canonical."""

    def steps(cells: Column) -> Column:
        """Of an array with the reduced cell and its turn."""
        reduced, rotation = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
        shift = once(F.array(apply_rotation(rotation, positions), apply_rotation(rotation, reduced)), lambda m: wrap_shift(g.to_relative(F.get(m, F.lit(0)), F.get(m, F.lit(1))), centred))
        return F.struct(reduction.alias("reduction"), rotation.alias("rotation"), shift.alias("shift"))

    return once(once(apply_reduction(reduction, cell), lambda m: F.array(m, turned(m))), steps)


def apply_canonical(steps: Column, positions: Column, cell: Column) -> Column:
    """Positions and cell after the steps, in the order cell, turn, shift."""
    whole = lambda new: F.struct(apply_wrap(steps["shift"], apply_rotation(steps["rotation"], positions), new).alias("positions"), new.alias("cell"))
    return once(apply_rotation(steps["rotation"], apply_reduction(steps["reduction"], cell)), whole)


def gram_eigenvalues(cell: Column) -> Column:
    """Eigenvalues, rising, of the matrix of scalar products of a cell's vectors: invariants of its shape.

    In closed form for symmetric 3 x 3 matrices.
    """

    def solved(m: Column) -> Column:
        """Of the matrix and its mean diagonal."""
        at, mean = lambda i, j: F.get(F.get(m["rows"], F.lit(i)), F.lit(j)), m["mean"]
        squares = sum(((at(k, k) - mean) * (at(k, k) - mean) for k in range(3)), F.lit(0.0)) + 2 * (at(0, 1) * at(0, 1) + at(0, 2) * at(0, 2) + at(1, 2) * at(1, 2))
        return once(F.sqrt(squares / 6), lambda spread: values(at, mean, spread))

    def values(at: Callable[[int, int], Column], mean: Column, spread: Column) -> Column:
        b = F.array(*[F.array(*[(at(i, j) - (mean if i == j else 0.0)) / F.when(spread > 0, spread).otherwise(1.0) for j in range(3)]) for i in range(3)])
        phi = once(b, lambda x: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.determinant(x) / 2))) / 3)
        return once(phi, lambda p: F.transform(F.array(F.lit(2 * math.pi / 3), F.lit(-2 * math.pi / 3), F.lit(0.0)), lambda turn: mean + 2 * spread * F.cos(p + turn)))

    rows = F.array(*[F.array(*[g.dot(g.at(cell, i), g.at(cell, j)) for j in range(3)]) for i in range(3)])
    return once(once(rows, lambda m: F.struct(m.alias("rows"), ((g.at(m, 0, 0) + g.at(m, 1, 1) + g.at(m, 2, 2)) / 3).alias("mean"))), solved)


def random_rotation(seed: int) -> list[list[float]]:
    """A rotation drawn evenly over all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return (q * np.sign(np.linalg.det(q))).tolist()


def displaced(positions: Column, cell: Column, seed: int) -> Column:
    """Positions and cell, turned and moved at random: what invariants must not notice."""
    turn = F.array(*[F.array(*map(F.lit, row)) for row in random_rotation(seed)])
    move = np.random.default_rng(seed + 1).normal(size=3).tolist()
    return F.struct(F.transform(apply_rotation(turn, positions), lambda p: F.zip_with(p, F.array(*map(F.lit, move)), lambda x, y: x + y)).alias("positions"), apply_rotation(turn, cell).alias("cell"))


def permuted_within(points: DataFrame, frame: str, kind: str, place: str, seed: int) -> DataFrame:
    """points with `new_place`: places dealt anew among the points of one kind in a frame, by a hash of seed and place."""
    keys = Window.partitionBy(frame, kind)
    mixed = points.withColumns({"nth": F.row_number().over(keys.orderBy(place)), "mixed_nth": F.row_number().over(keys.orderBy(F.xxhash64(F.lit(seed), frame, place), place))})
    places = mixed.select(frame, kind, F.col(place).alias("new_place"), F.col("nth").alias("mixed_nth"))
    return mixed.join(places, [frame, kind, "mixed_nth"]).drop("nth", "mixed_nth")
