"""Geometry of frames: cells and positions as nested arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(m: Column, i: int, j: int | None = None) -> Column:
    row = F.get(m, F.lit(i))
    return row if j is None else F.get(row, F.lit(j))


def dot(a: Column, b: Column) -> Column:
    return at(a, 0) * at(b, 0) + at(a, 1) * at(b, 1) + at(a, 2) * at(b, 2)


def cross(a: Column, b: Column) -> Column:
    return F.array(at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1), at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2), at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def determinant(m: Column) -> Column:
    return dot(at(m, 0), cross(at(m, 1), at(m, 2)))


def volume(cell: Column) -> Column:
    return F.abs(determinant(cell))


def angles(cell: Column, degrees: bool = True) -> Column:
    """The matrix of angles between cell vectors."""
    f = F.degrees if degrees else (lambda x: x)
    cosine = lambda a, b: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (length(a) * length(b))))
    return F.array(*[F.array(*[f(F.acos(cosine(at(cell, i), at(cell, j)))) for j in range(3)]) for i in range(3)])


def inverse(m: Column) -> Column:
    """The inverse of a 3 x 3 matrix."""
    r = [at(m, k) for k in range(3)]
    columns = [cross(r[1], r[2]), cross(r[2], r[0]), cross(r[0], r[1])]
    d = determinant(m)
    return F.array(*[F.array(*[at(columns[j], i) / d for j in range(3)]) for i in range(3)])


def row_times(v: Column, m: Column) -> Column:
    """A row vector times a matrix."""
    return F.array(*[at(v, 0) * at(m, 0, j) + at(v, 1) * at(m, 1, j) + at(v, 2) * at(m, 2, j) for j in range(3)])


def to_relative(positions: Column, cell: Column) -> Column:
    back = inverse(cell)
    return F.transform(positions, lambda p: row_times(p, back))


def to_absolute(positions: Column, cell: Column) -> Column:
    return F.transform(positions, lambda p: row_times(p, cell))


def wrapped(relative: Column, centred: bool = False) -> Column:
    """Relative coordinates in [0, 1), or centred in [-1/2, 1/2)."""
    move = 0.5 if centred else 0.0
    return F.transform(relative, lambda p: F.transform(p, lambda x: x + move - F.floor(x + move) - move))


def min_distance(a: Column, b: Column, cell: Column) -> Column:
    """The least distance over the 27 nearest images of a reduced cell; under 1e-6 it counts as 0."""
    d = minus(b, a)
    images = F.array(*[F.array(*[F.lit(float(x)) for x in (i, j, k)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    squares = F.transform(images, lambda s: dot(F.zip_with(d, row_times(s, cell), lambda x, y: x + y), F.zip_with(d, row_times(s, cell), lambda x, y: x + y)))
    least = F.array_min(squares)
    return F.when(least < 1e-12, 0.0).otherwise(F.sqrt(least))


def distance(a: Column, b: Column) -> Column:
    d = minus(b, a)
    return F.when(dot(d, d) <= 1e-10, 0.0).otherwise(length(d))


def angle(a: Column, b: Column, c: Column) -> Column:
    """The angle at b."""
    x, y = minus(a, b), minus(c, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / (length(x) * length(y)))))


def dihedral(p: list[Column]) -> Column:
    """The torsion of four points, by atan2."""
    a, b, c = minus(p[1], p[0]), minus(p[2], p[1]), minus(p[3], p[2])
    n, m = cross(a, b), cross(b, c)
    return F.atan2(dot(cross(n, m), b) / length(b), dot(n, m))


def supercell(positions: Column, cell: Column, n: tuple[int, int, int]) -> Column:
    """The positions of n1 n2 n3 copies of a frame."""
    shifts = F.array(*[F.array(*[F.lit(float(x)) for x in (i, j, k)]) for i in range(n[0]) for j in range(n[1]) for k in range(n[2])])
    return F.flatten(F.transform(shifts, lambda s: F.transform(positions, lambda p: F.zip_with(p, row_times(s, cell), lambda x, y: x + y))))


def invert(positions: Column) -> Column:
    return F.transform(positions, lambda p: F.transform(p, lambda x: -x))


def coordination(r: Column, r0: float, n: int = 6, m: int = 12) -> Column:
    """(1 - (r/r0)^n) / (1 - (r/r0)^m), by its expansion close to 1."""
    x = r / F.lit(r0)
    e = x - 1
    second = (n - 1) * (n - 2) / 6 - (m - 1) * (m - 2) / 6 - (m - 1) * (n - m) / 4
    near = F.lit(n / m) * (1 + F.lit((n - m) / 2) * e + F.lit(second) * e * e)
    return F.when(F.abs(e) < 1e-3, near).otherwise((1 - F.pow(x, F.lit(float(n)))) / (1 - F.pow(x, F.lit(float(m)))))


def coordination_between(positions: Column, cell: Column | None, one: list[int], two: list[int], r0: float, n: int = 6, m: int = 12) -> Column:
    """The sum of coordination over all pairs of a point of one group and another of the second, by the nearest image in a cell."""
    at_ = lambda k: at(positions, k)
    r = lambda i, j: distance(at_(i), at_(j)) if cell is None else min_distance(at_(i), at_(j), cell)
    total = F.lit(0.0)
    for i in one:
        for j in two:
            if i != j:
                total = total + coordination(r(i, j), r0, n, m)
    return total
