"""Periodic arithmetic over the dimensions of a feature space, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fraction(x: Column) -> Column:
    """x - floor(x): the part of x in [0, 1), for either sign."""
    return x - F.floor(x)


@dataclass(frozen=True)
class Axis:
    """One dimension: bounds, whether they join up, and whether a grid may reach past them."""

    lo: float
    hi: float
    periodic: bool = False
    extensible: bool = True

    def map(self, x: Column, displace: bool = True) -> Column:
        """x in units of the box; without displace only scaled."""
        return ((x - F.lit(self.lo)) if displace else x) / F.lit(self.hi - self.lo)

    def unmap(self, u: Column, displace: bool = True) -> Column:
        """The inverse of map, shift included."""
        x = u * F.lit(self.hi - self.lo)
        return x + F.lit(self.lo) if displace else x

    def wrap(self, x: Column) -> Column:
        """x brought into the box if periodic."""
        return self.unmap(fraction(self.map(x))) if self.periodic else x

    def shortest(self, d: Column) -> Column:
        """A difference brought into half a box either way if periodic: (-1/2, 1/2] of the box."""
        if not self.periodic:
            return d
        u = fraction(self.map(d, displace=False))
        return self.unmap(F.when(u > 0.5, u - 1).otherwise(u), displace=False)

    def difference(self, a: Column, b: Column) -> Column:
        """b - a by the shortest way."""
        return self.shortest(b - a)

    def edges(self, n: int, margin: float = 0.0) -> tuple[float, float]:
        """Bounds of a grid of n edges; the margin is a part of the box and for extensible axes only."""
        extra = margin * (self.hi - self.lo) if self.extensible and not self.periodic else 0.0
        return self.lo - extra, self.hi + extra


@dataclass(frozen=True)
class Metric:
    """Axes in order."""

    axes: tuple[Axis, ...]

    def __add__(self, other: Metric) -> Metric:
        return Metric(self.axes + other.axes)

    def __getitem__(self, at: tuple[int, ...]) -> Metric:
        return Metric(tuple(self.axes[k] for k in at))

    def difference(self, a: list[Column], b: list[Column]) -> list[Column]:
        return [axis.difference(x, y) for axis, x, y in zip(self.axes, a, b, strict=True)]

    def norm(self, a: list[Column], b: list[Column], k: list[float] | None = None) -> Column:
        """Euclidean length of k times the difference."""
        parts = [d * F.lit(1.0 if k is None else k[i]) for i, d in enumerate(self.difference(a, b))]
        return F.sqrt(reduce(lambda x, y: x + y, [p * p for p in parts]))

    def grid(self, spark: SparkSession, n: int, margin: float = 0.0) -> DataFrame:
        """n - 1 midpoints along each axis, in all combinations: columns i0, i1, ... and x0, x1, ..."""
        out = None
        for k, axis in enumerate(self.axes):
            lo, hi = axis.edges(n, margin)
            line = spark.range(n - 1).select(F.col("id").cast("int").alias(f"i{k}"), (F.lit(lo) + (F.col("id") + 0.5) * F.lit((hi - lo) / (n - 1))).alias(f"x{k}"))
            out = line if out is None else out.crossJoin(F.broadcast(line))  # (n - 1) rows an axis
        return out


def bins_per_axis(samples: int, samples_per_bin: int, dims: int, max_bins: int = 10**6, max_per_axis: int = 1000) -> int:
    """Bins along each axis so that a bin has samples_per_bin samples on average."""
    return min(max_per_axis, int(min(samples / samples_per_bin, max_bins) ** (1 / dims)))
