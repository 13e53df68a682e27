"""Slow modes of time-lagged data: decomposition, timescales, stationary weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.transforms import Transform, matmul, periodic_pair, shift, take
from tessera.operators.moments import Covariances, joint_moments, whitener


@dataclass
class Koopman:
    """Left and right singular functions as (x - mean) @ rows.T, and singular values, falling."""

    mean0: np.ndarray
    mean1: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray
    tau: float = 1.0

    @staticmethod
    def fit(cov: Covariances, dims: int | None = None, symmetric: bool = False, eps: float = 1e-12, tau: float = 1.0) -> Koopman:
        if symmetric:
            cov = cov.symmetrised()
            w = whitener(cov.c00, eps)
            values, vectors = np.linalg.eigh(w @ cov.c01 @ w.T)
            order = np.argsort(-values)[:dims]
            rows = vectors[:, order].T @ w
            return Koopman(cov.mean0, cov.mean0, rows, rows, values[order], tau)
        w0, w1 = whitener(cov.c00, eps), whitener(cov.c11, eps)
        u, s, v = np.linalg.svd(w0 @ cov.c01 @ w1.T)
        k = len(s) if dims is None else min(dims, len(s))
        return Koopman(cov.mean0, cov.mean1, u[:, :k].T @ w0, v[:k] @ w1, s[:k], tau)

    def constants(self, tol: float = 1e-6) -> int:
        """Leading modes that don't decay: a constant feature's, for instance."""
        return int(np.argmax(self.values < 1 - tol)) if (self.values < 1 - tol).any() else len(self.values)

    def without_constants(self, skip: int | None = None) -> Koopman:
        """The model less its first `skip` modes (by default the constant ones)."""
        k = self.constants() if skip is None else skip
        return Koopman(self.mean0, self.mean1, self.left[k:], self.right[k:], self.values[k:], self.tau)

    def cut(self, fraction: float) -> Koopman:
        """The modes whose timescale is at least a fraction of the slowest's."""
        t = self.timescales()
        good = np.isfinite(t) & (t >= fraction * np.nanmax(np.where(np.isfinite(t), t, np.nan)))
        k = len(good) if good.all() else int(np.argmin(good))
        return Koopman(self.mean0, self.mean1, self.left[:k], self.right[:k], self.values[:k], self.tau)

    def timescales(self) -> np.ndarray:
        """-tau / ln s; infinite at 1, NaN where s isn't between 0 and 1."""
        return np.array([math.inf if s >= 1 else -self.tau / math.log(s) if s > 0 else math.nan for s in self.values])

    def f(self) -> Transform:
        """The projection on left singular functions."""
        return shift(*(-self.mean0).tolist()) * matmul(self.left.T.tolist())

    def g(self) -> Transform:
        return shift(*(-self.mean1).tolist()) * matmul(self.right.T.tolist())


def reweighted(rows: DataFrame, x: str, x_t: str, dims: int | None = None, symmetric: bool = False, tau: float = 1.0) -> tuple[Koopman, DataFrame]:
    """A model of rows weighed to equilibrium, and the rows with their weight w.

    The weight is linear in the features: the left eigenvector of the lagged
    map with a constant feature added, at the eigenvalue nearest 1. If it is
    negative anywhere, rows count alike.
    """
    one = Transform(lambda v: F.concat(v, F.array(F.lit(1.0))))
    both = rows.withColumns({"kp_x": one(F.col(x)), "kp_y": one(F.col(x_t))})
    _, _, ((s00, s01), _) = joint_moments(both, ["kp_x", "kp_y"])
    k = np.linalg.pinv(s00, rcond=1e-10) @ s01
    values, vectors = np.linalg.eig(k.T)
    u = np.linalg.pinv(s00, rcond=1e-10) @ vectors[:, np.argmin(np.abs(values - 1))].real
    weight = F.aggregate(F.zip_with("kp_x", F.array(*map(F.lit, u.tolist())), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    lo, hi, mean = both.agg(F.min(weight), F.max(weight), F.avg(weight)).first()
    if mean is None or mean == 0 or (lo < 0 < hi):
        weight, mean = F.lit(1.0), 1.0
    weighed = both.withColumn("w", weight / F.lit(float(mean))).drop("kp_x", "kp_y")
    return Koopman.fit(Covariances.of(weighed, x, x_t, F.col("w")), dims, symmetric, tau=tau), weighed


@dataclass
class PeriodicKoopman:
    """Two models side by side: of angles by cosine and sine, and of the other dimensions."""

    angles: tuple[int, ...]
    others: tuple[int, ...]
    periodic: Koopman | None
    plain: Koopman | None

    @staticmethod
    def fit(rows: DataFrame, x: str, x_t: str, angles: list[int], dims: int, each: int | None = None) -> PeriodicKoopman:
        rest = [k for k in range(dims) if k not in angles]
        wave, same = take(*angles) * periodic_pair(len(angles)), take(*rest)

        def model(f: Transform, there: list[int]) -> Koopman | None:
            return Koopman.fit(Covariances.of(rows.select(f(F.col(x)).alias("x"), f(F.col(x_t)).alias("y")), "x", "y"), each) if there else None

        return PeriodicKoopman(tuple(angles), tuple(rest), model(wave, angles), model(same, rest))

    def timescales(self) -> np.ndarray:
        """Of both models, slowest first."""
        found = [m.timescales() for m in (self.periodic, self.plain) if m is not None]
        return np.sort(np.concatenate(found))[::-1]

    def f(self) -> Transform:
        """Projections of both, the periodic one first."""
        parts = []
        if self.periodic is not None:
            parts.append(take(*self.angles) * periodic_pair(len(self.angles)) * self.periodic.f())
        if self.plain is not None:
            parts.append(take(*self.others) * self.plain.f())
        return parts[0] if len(parts) == 1 else parts[0] + parts[1]

    def refitted(self, rows: DataFrame, x: str, x_t: str, each: int | None = None) -> PeriodicKoopman:
        """The periodic model fitted to other rows, the other one kept."""
        again = PeriodicKoopman.fit(rows, x, x_t, list(self.angles), len(self.angles) + len(self.others), each)
        return PeriodicKoopman(self.angles, self.others, again.periodic, self.plain)


def transition_matrix(counts: DataFrame, n: int, pseudo: float = 0.0) -> np.ndarray:
    """A dense row-stochastic matrix of counts (src, dst, c); n bounds its size. Rows without counts stay put."""
    table = counts.toPandas()
    out = np.full((n, n), pseudo)
    out[table["src"], table["dst"]] += table["c"]
    empty = out.sum(axis=1) == 0
    out[empty, empty] = 1
    return out / out.sum(axis=1, keepdims=True)


def stationary(t: np.ndarray) -> np.ndarray | None:
    """The left eigenvector nearest 1, as probabilities; None unless it is real and of one sign."""
    values, vectors = np.linalg.eig(t.T)
    k = int(np.argmin(np.abs(values - 1)))
    if abs(values[k].imag) > 1e-3:
        return None
    v = vectors[:, k].real
    v = v / v.sum()
    return np.clip(v, 0, None) if (v > -1e-9).all() else None


def implied_timescales(t: np.ndarray, tau: float = 1.0) -> np.ndarray:
    values = np.sort(np.abs(np.linalg.eigvals(t)))[::-1][1:]
    return -tau / np.log(np.clip(values, 1e-300, 1 - 1e-15))
