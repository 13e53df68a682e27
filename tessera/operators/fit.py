"""Estimators: fit on a table, give a Transform; `a * b` fits one after the other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import transforms as t
from tessera.operators import moments as mo
from tessera.operators.koopman import Koopman


@dataclass(frozen=True)
class Estimator:
    """fit(rows, x, x_t) gives the transform; x_t is the lagged partner column or None."""

    fit: Callable[[DataFrame, str, str | None], t.Transform]

    def __mul__(self, after: Estimator) -> Estimator:
        def both(rows: DataFrame, x: str, x_t: str | None) -> t.Transform:
            first = self.fit(rows, x, x_t)
            mapped = rows.withColumns({x: first(F.col(x))} | ({x_t: first(F.col(x_t))} if x_t else {}))
            return first * after.fit(mapped, x, x_t)

        return Estimator(both)


def fixed(transform: t.Transform) -> Estimator:
    return Estimator(lambda rows, x, x_t: transform)


def _by_place(rows: DataFrame, x: str, *aggregates) -> list:  # noqa: ANN002
    return rows.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(*aggregates).orderBy("i").collect()  # a row a dimension


def _min_max(rows: DataFrame, x: str, x_t: str | None) -> t.Transform:
    found = _by_place(rows, x, F.min("v").alias("lo"), F.max("v").alias("hi"))
    return t.min_max([r["lo"] for r in found], [r["hi"] for r in found])


def _standardise(rows: DataFrame, x: str, x_t: str | None) -> t.Transform:
    found = _by_place(rows, x, F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    good = [r for r in found if r["s"] >= 1e-8]  # constants are dropped
    return t.take(*[r["i"] for r in good]) * t.standardise([r["m"] for r in good], [r["s"] for r in good])


MIN_MAX, STANDARDISE = Estimator(_min_max), Estimator(_standardise)


def slow_modes(dims: int, symmetric: bool = False) -> Estimator:
    """The slowest modes of lagged pairs."""
    return Estimator(lambda rows, x, x_t: Koopman.fit(mo.Covariances.of(rows, x, x_t), dims, symmetric).f())


def whitened(dims: int | None = None) -> Estimator:
    """Principal directions scaled to unit variance, largest first."""

    def fit(rows: DataFrame, x: str, x_t: str | None) -> t.Transform:
        _, mean, _, second = mo.array_moments(rows, x)
        w = mo.whitener(second - np.outer(mean, mean))[:dims]
        return t.shift(*(-mean).tolist()) * t.matmul(w.T.tolist())

    return Estimator(fit)


def discriminant(label: str, dims: int) -> Estimator:
    """Directions that set classes apart."""

    def fit(rows: DataFrame, x: str, x_t: str | None) -> t.Transform:
        within, between, _ = mo.class_scatter(rows, label, x)
        return t.matmul(mo.discriminants(within, between, dims).T.tolist())

    return Estimator(fit)


def _apart(between: np.ndarray, total: np.ndarray, of: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading ratios of v^T B v to v^T T v over combinations v of the columns of `of`, and those v, with v^T T v = 1."""
    w = mo.whitener(of.T @ total @ of)
    values, vectors = np.linalg.eigh(w @ (of.T @ between @ of) @ w.T)
    best = np.argsort(-values)[:dims]
    return values[best], of @ (w.T @ vectors[:, best])


def steps_apart(between: np.ndarray, total: np.ndarray, each: int, dims: int, most: int = 500, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights of `each` steps (a row an input) and the matrix that mixes the weighed inputs, and the score after each move.

    The score is the sum of the `dims` leading ratios of between to total
    moments. The best mix for given weights is an eigenproblem of the inputs, so
    only weights move: first to the nearest to the best free combination of all
    steps, then up the score's gradient, by strides that never lower it.
    """
    inputs = len(total) // each

    def spread(weights: np.ndarray) -> np.ndarray:  # all steps to inputs
        out = np.zeros((len(total), inputs))
        for k in range(inputs):
            out[k * each : (k + 1) * each, k] = weights[k]
        return out

    def unit(weights: np.ndarray) -> np.ndarray:
        return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-300)

    free = _apart(between, total, np.eye(len(total)), dims)[1]
    starts = [np.linalg.svd(free[k * each : (k + 1) * each])[0][:, 0] for k in range(inputs)]
    weights = max((unit(np.array(starts)), np.full((inputs, each), each**-0.5)), key=lambda v: _apart(between, total, spread(v), dims)[0].sum())
    ratios, mixed = _apart(between, total, spread(weights), dims)
    scores, stride = [float(ratios.sum())], 1.0
    for _ in range(most):
        pull = (2 * (between @ mixed - total @ mixed * ratios)).reshape(inputs, each, -1)
        share = np.einsum("ike,ik->ie", mixed.reshape(inputs, each, -1), weights)  # the mix: what each input adds to each outcome
        slope = np.einsum("ike,ie->ik", pull, share)
        slope -= weights * (slope * weights).sum(1, keepdims=True)
        while stride > 1e-12:
            moved = unit(weights + stride * slope)
            found, there = _apart(between, total, spread(moved), dims)
            if found.sum() >= scores[-1] + 1e-4 * stride * (slope**2).sum():
                break
            stride /= 2
        else:
            break
        weights, mixed, ratios, stride = moved, there, found, stride * 2
        scores.append(float(ratios.sum()))
        if scores[-1] - scores[-2] < tol:
            break
    mix = np.einsum("ike,ik->ie", mixed.reshape(inputs, each, -1), weights)
    return weights, mix, scores


def soft_steps(n: int, dims: int, label: str | None = None, periodic: list[bool] | None = None) -> Estimator:
    """n soft steps along each input, weighed to one indicator an input and mixed to `dims` outcomes of variance 1 that set groups apart.

    Groups are the values of `label`; without it, outcomes are to change least
    from x to its lagged partner. Bounds, then moments of all steps, are all that
    the score depends on, so no move reads the rows again. The largest weight of each input and the largest part of each mix are positive.
    Periodic inputs are angles in [-pi, pi]. An input of one value adds nothing.
    """

    def fit(rows: DataFrame, x: str, x_t: str | None) -> t.Transform:
        if label is None and x_t is None:
            raise ValueError("soft steps need a label or a lagged partner")
        found = _by_place(rows, x, F.min("v").alias("lo"), F.max("v").alias("hi"))
        turns = periodic or [False] * len(found)
        boxes = [(-np.pi, np.pi) if turn else (r["lo"], r["hi"] if r["hi"] > r["lo"] else r["lo"] + 1.0) for r, turn in zip(found, turns, strict=True)]
        parts = [t.indicators(lo, hi, n, k, turn) for k, ((lo, hi), turn) in enumerate(zip(boxes, turns, strict=True))]
        steps = parts[0]
        for p in parts[1:]:
            steps = steps + p
        here = rows.select(steps(F.col(x)).alias("x"), *([F.col(label).alias("label")] if label else [steps(F.col(x_t)).alias("x_t")]))
        if label:
            within, between, _ = mo.class_scatter(here, "label", "x")
            total = within + between
        else:
            c = mo.Covariances.of(here, "x", "x_t").symmetrised()
            between, total = c.c01, c.c00
        weights, mix, _ = steps_apart(between, total, n, dims)
        turned = np.where(np.take_along_axis(weights, np.abs(weights).argmax(1)[:, None], 1) < 0, -1, 1)
        weights, mix = weights * turned, mix * turned
        mix = mix * np.where(np.take_along_axis(mix, np.abs(mix).argmax(0)[None], 0) < 0, -1, 1)
        weighed = np.zeros((len(total), len(boxes)))
        for k, w in enumerate(weights):
            weighed[k * n : (k + 1) * n, k] = w
        return steps * t.matmul((weighed @ mix).tolist())

    return Estimator(fit)
