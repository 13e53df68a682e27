"""Weighted and time-lagged moments, and their decomposition.

Sums run over the cluster by partial aggregation and give small tables; the
dense algebra on those is numpy's, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import cut


def effective_size(rows: DataFrame, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Kish's (sum w)^2 / sum w^2, by keys."""
    return rows.groupBy(*(keys or [])).agg((F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("n_eff"))


def covariance(rows: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """i, j (i <= j), c: the weighted covariance of columns, in one pass."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.agg(F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"m{k}") for k, c in enumerate(columns)], *[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs])
    value = lambda i, j: F.col(f"s{i}_{j}") / F.col("w") - F.col(f"m{i}") / F.col("w") * F.col(f"m{j}") / F.col("w")
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), value(i, j).alias("c")) for i, j in pairs])).alias("x")).select("x.i", "x.j", "x.c")


def array_moments(rows: DataFrame, x: str, y: str | None = None, weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of weights, weighted means of x and y, and the weighted mean of x y^T, of array columns. Rows with a null array count as nothing."""
    n, mean, second = joint_moments(rows, [x, y or x], weight)
    if not n:
        return 0.0, np.zeros(0), np.zeros(0), np.zeros((0, 0))
    return n, mean[0], mean[1], second[0][1]


def joint_moments(rows: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[float, list[np.ndarray], list[list[np.ndarray]]]:
    """Sum of weights, weighted means of array columns, and weighted means of their products, for each pair of columns.

    One pass and one job: each task sums X^T X of its batches, as one matrix,
    and these are added up; their size depends on the arrays' length only.
    """
    w = F.lit(1.0) if weight is None else weight
    base = rows.select(w.cast("double").alias("w"), *[F.col(c).cast("array<double>").alias(f"x{k}") for k, c in enumerate(columns)]).dropna()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, widths = None, None
        for b in batches:
            if not b.num_rows:
                continue
            parts = [np.ones((b.num_rows, 1)), *[b.column(f"x{k}").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in range(len(columns))]]
            whole = np.concatenate(parts, axis=1)
            widths = [p.shape[1] for p in parts[1:]]
            found = (whole * b.column("w").to_numpy()[:, None]).T @ whole
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([widths], pa.list_(pa.int32())), pa.array([total.ravel()], pa.list_(pa.float64()))], ["widths", "cells"])

    cells = base.mapInArrow(partial, "widths array<int>, cells array<double>").select("widths", F.posexplode("cells").alias("k", "v"))
    found = cells.groupBy("widths", "k").agg(F.sum("v").alias("v")).orderBy("k").toArrow()  # as many rows as the matrix has places
    if not found.num_rows:
        return 0.0, [], []
    widths = found["widths"][0].as_py()
    size = 1 + sum(widths)
    whole = found["v"].to_numpy().reshape(size, size)
    n, edges = float(whole[0, 0]), np.cumsum([1, *widths])
    cut = [slice(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return n, [whole[0, c] / n for c in cut], [[whole[c, e] / n for e in cut] for c in cut]


@dataclass
class Covariances:
    """Means and covariances of x (0) and its lagged partner y (1)."""

    n: float
    mean0: np.ndarray
    mean1: np.ndarray
    c00: np.ndarray
    c01: np.ndarray
    c11: np.ndarray

    @staticmethod
    def of(rows: DataFrame, x: str, y: str, weight: Column | None = None) -> Covariances:
        n, (m0, m1), ((s00, s01), (_, s11)) = joint_moments(rows, [x, y], weight)
        return Covariances(n, m0, m1, s00 - np.outer(m0, m0), s01 - np.outer(m0, m1), s11 - np.outer(m1, m1))

    @property
    def c10(self) -> np.ndarray:
        return self.c01.T

    def symmetrised(self) -> Covariances:
        """The mean of forward and backward moments."""
        m = (self.mean0 + self.mean1) / 2
        s00 = (self.c00 + np.outer(self.mean0, self.mean0) + self.c11 + np.outer(self.mean1, self.mean1)) / 2 - np.outer(m, m)
        s01 = self.c01 + np.outer(self.mean0, self.mean1)
        s01 = (s01 + s01.T) / 2 - np.outer(m, m)
        return Covariances(self.n, m, m, s00, s01, s00)

    def __add__(self, other: Covariances) -> Covariances:
        """Moments of both data sets together."""
        n = self.n + other.n
        f, g = self.n / n, other.n / n
        m0, m1 = f * self.mean0 + g * other.mean0, f * self.mean1 + g * other.mean1

        def merged(a: np.ndarray, b: np.ndarray, p: tuple, q: tuple, m: tuple) -> np.ndarray:
            return f * (a + np.outer(*p)) + g * (b + np.outer(*q)) - np.outer(*m)

        return Covariances(
            n, m0, m1,
            merged(self.c00, other.c00, (self.mean0, self.mean0), (other.mean0, other.mean0), (m0, m0)),
            merged(self.c01, other.c01, (self.mean0, self.mean1), (other.mean0, other.mean1), (m0, m1)),
            merged(self.c11, other.c11, (self.mean1, self.mean1), (other.mean1, other.mean1), (m1, m1)),
        )

    def intensity(self, n_eff: float | None = None) -> float:
        """How far to draw towards one variance for all: the oracle-approximating rule for n_eff independent rows."""
        n, c = n_eff or self.n, self.c00
        p, square, trace = len(c), float((c * c).sum()), float(np.trace(c))
        below = (n + 1 - 2 / p) * (square - trace * trace / p)
        return 1.0 if below <= 0 else float(np.clip(((1 - 2 / p) * square + trace * trace) / below, 0, 1))

    def shrunk(self, intensity: float, target: str = "diag") -> Covariances:
        """Covariances drawn towards their diagonal, or towards one variance for all."""

        def draw(c: np.ndarray) -> np.ndarray:
            goal = np.diag(np.diag(c)) if target == "diag" else np.eye(len(c)) * np.trace(c) / len(c)
            return (1 - intensity) * c + intensity * goal

        return Covariances(self.n, self.mean0, self.mean1, draw(self.c00), self.c01, draw(self.c11))

    def mask(self, least: float = 1e-10, most: int | None = None, threshold: float | None = None) -> np.ndarray:
        """Features with a deviation above `least`, by falling lagged autocorrelation."""
        s0, s1 = np.sqrt(np.clip(np.diag(self.c00), 0, None)), np.sqrt(np.clip(np.diag(self.c11), 0, None))
        good = np.flatnonzero((s0 > least) & (s1 > least))
        r = np.diag(self.c01)[good] / (s0 * s1)[good]
        order = np.argsort(-r, kind="stable")
        if threshold is not None:
            order = order[r[order] >= threshold]
        return good[order][:most]


def whitener(c: np.ndarray, eps: float = 1e-12, tikhonov: float = 0.0) -> np.ndarray:
    """Rows W with W C W^T = 1 on the directions whose variance is above eps times the greatest."""
    values, vectors = np.linalg.eigh(c)
    values = values + tikhonov**2
    good = values > eps * max(values.max(initial=0.0), 0.0)
    return (vectors[:, good] / np.sqrt(values[good])).T[::-1]


def class_moments(rows: DataFrame, label: str, x: str) -> DataFrame:
    """label, i, m, n: each class's mean in each dimension of an array column."""
    return rows.select(label, F.posexplode(x).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))


def most_varying(rows: DataFrame, x: str, most: int, least: float = 0.0) -> DataFrame:
    """i, sd: the dimensions of an array column that vary most, above `least`."""
    spread = rows.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("sd")).where(F.col("sd") > least)
    return spread.orderBy(F.desc("sd"), "i").limit(most)  # of as many rows as there are dimensions


#: Triangles that are folded into one at each level of the tree.
FAN = 16


def triangular(rows: DataFrame, x: str) -> tuple[int, np.ndarray]:
    """The number of rows of an array column, and R of their QR decomposition: X^T X = R^T R without X^T X.

    Each task folds its batches into a triangle, and triangles are folded FAN
    at a time, level by level; so small singular values keep all digits that
    X^T X would lose. Rows with a null array count as nothing.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, n = None, 0
        for b in batches:
            if b.num_rows:
                whole = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                r, n = np.linalg.qr(whole if r is None else np.concatenate([r, whole]), mode="r"), n + b.num_rows
        if r is not None:
            yield triangle(TaskContext.get().partitionId(), n, r)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, n, parts in zip(*[b.column(c).to_pylist() for c in ("part", "n", "parts")], strict=True):
                whole = np.concatenate([np.array(p["cells"]).reshape(-1, p["width"]) for p in parts])
                yield triangle(group, n, np.linalg.qr(whole, mode="r"))

    def triangle(part: int, n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([r.shape[1]], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "n", "width", "cells"])

    kind = "part long, n long, width int, cells array<double>"
    level = cut(rows.select(F.col(x).cast("array<double>").alias("x")).dropna().mapInArrow(folded, kind))
    while (most := level.agg(F.max("part")).first()[0] or 0) > 0:
        groups = level.groupBy(F.floor(F.col("part") / FAN).alias("part")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("width", "cells")).alias("parts"))  # FAN triangles at most
        level = cut(groups.mapInArrow(merged, kind))
        if most < FAN:
            break
    last = level.first()
    if last is None:
        return 0, np.zeros((0, 0))
    return last["n"], np.array(last["cells"]).reshape(-1, last["width"])


def singular_values(rows: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of an array column, largest first, and directions V (columns), each with its greatest part positive."""
    _, r = triangular(rows, x)
    return singular_of(r)


def singular_of(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not r.size:
        return np.zeros(0), np.zeros((0, 0))
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    greatest = vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)]
    return s, (vt * np.where(greatest < 0, -1, 1)[:, None]).T


def truncated_svd(rows: DataFrame, x: str) -> np.ndarray:
    """Columns V that project an array column on its singular directions, largest first; those below 10 max(n, d) eps of the largest are dropped."""
    n, r = triangular(rows, x)
    s, v = singular_of(r)
    return v[:, s > 10 * max(n, len(v)) * np.finfo(float).eps * s.max(initial=0.0)]


def class_scatter(rows: DataFrame, label: str, x: str) -> tuple[np.ndarray, np.ndarray, dict]:
    """Within and between scatter of an array column over classes, and class means, from sums by class."""
    means = class_moments(rows, label, x).toPandas()  # a row a class and dimension
    n, mean, _, second = array_moments(rows, x)
    counts = means.groupby(label)["n"].first()
    centre = {k: g.sort_values("i")["m"].to_numpy() for k, g in means.groupby(label)}
    between = sum(counts[k] / n * np.outer(m - mean, m - mean) for k, m in centre.items())
    return second - np.outer(mean, mean) - between, between, centre


def discriminants(within: np.ndarray, between: np.ndarray, dims: int) -> np.ndarray:
    """Linear discriminant directions (rows): leading solutions of B v = l W v."""
    w = whitener(within)
    values, vectors = np.linalg.eigh(w @ between @ w.T)
    return (w.T @ vectors[:, np.argsort(-values)[:dims]]).T
