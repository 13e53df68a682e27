"""Partial correlations with few links, by group: coordinate descent on a precision matrix of unit diagonal.

The precision is D R D, with a diagonal D and R of unit diagonal, so the
penalty falls on partial correlations and doesn't depend on units:

    -log det R - 2 (1 - alpha) sum log d + d^T (R o C) d + penalty sum_{i != j} |r_ij|

for a correlation matrix C. Sums of products come from one aggregation; each
group's matrix is then a row, solved where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def objective(r: np.ndarray, d: np.ndarray, c: np.ndarray, penalty: float, alpha: float = 0.0) -> float:
    off = np.abs(r).sum() - np.abs(np.diag(r)).sum()
    return float(-np.linalg.slogdet(r)[1] - 2 * (1 - alpha) * np.log(d).sum() + d @ (r * c) @ d + penalty * off)


def _scales(a: np.ndarray, d: np.ndarray, alpha: float, tol: float) -> np.ndarray:
    """The d that minimise d^T A d - 2 (1 - alpha) sum log d, one after the other: each is a quadratic's positive root."""
    for _ in range(1000):
        old = d.copy()
        for i in range(len(d)):
            b = a[i] @ d - a[i, i] * d[i]
            root = np.sqrt(b * b + 4 * a[i, i] * (1 - alpha))
            d[i] = (root - b) / (2 * a[i, i]) if b < 0 else 2 * (1 - alpha) / (root + b)
        if np.abs(d - old).max() < tol:
            break
    return d


def _step(w: np.ndarray, i: int, j: int, r: float, b: float, penalty: float) -> float:
    """How far r_ij goes: the one stationary point of -log det R + 2 b r_ij + 2 penalty |r_ij| along it, for the inverse w of R."""
    det = w[i, i] * w[j, j] - w[i, j] ** 2

    def along(beta: float) -> float:  # where (w_ij - t det) = beta (1 + 2 t w_ij - t^2 det), on the branch that keeps det R > 0
        lead = det + 2 * beta * w[i, j]
        root = np.sqrt(det * det + 4 * beta * beta * w[i, i] * w[j, j])
        return 2 * (w[i, j] - beta) / (lead + root) if lead > 0 else (lead - root) / (2 * beta * det)

    for sign in (1, -1):
        t = along(b + sign * penalty)
        if sign * (r + t) > 0:
            return t
    return -r


def scaled_precision(c: np.ndarray, penalty: float = 0.1, alpha: float = 0.0, tol: float = 1e-9, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """R (unit diagonal) and d of a correlation matrix, from no links at all; rounds of scales and coordinates until neither moves by tol.

    Links that are 0 and whose slope is within the penalty are skipped. c may be singular if penalty > 0.
    """
    p = len(c)
    r, w, d = np.eye(p), np.eye(p), np.full(p, np.sqrt(1 - alpha))
    for _ in range(most):
        before = r.copy(), d.copy()
        d = _scales(r * c, d, alpha, tol / 10)
        b = c * np.outer(d, d)
        for i, j in zip(*np.triu_indices(p, 1), strict=True):
            if r[i, j] == 0 and abs(b[i, j] - w[i, j]) <= penalty:
                continue
            t = _step(w, i, j, r[i, j], b[i, j], penalty)
            if abs(t) < 1e-15:
                continue
            r[i, j] = r[j, i] = 0.0 if t == -r[i, j] else r[i, j] + t
            two = w[:, [i, j]]
            core = np.array([[w[i, i], w[i, j] + 1 / t], [w[i, j] + 1 / t, w[j, j]]])
            w = w - two @ np.linalg.solve(core, two.T)
        w = np.linalg.inv(r)  # updates don't add up their errors
        if max(np.abs(r - before[0]).max(), np.abs(d - before[1]).max()) < tol:
            break
    return r, d


def partial_links(rows: DataFrame, columns: list[str], keys: list[str] | None = None, weight: str | None = None, penalty: float = 0.1, alpha: float = 0.0) -> DataFrame:
    """keys, n, i, j (i < j), c, partial, precision: correlations, partial correlations and precisions of columns, by keys.

    n counts rows. Rows with a null in a column or weight, or a negative or no
    weight, take no part; dimensions that are constant in a group are linked
    with nothing (c and partial 0, precision null). A group is one row of an
    aggregation with map-side sums, whatever its size. Covariances are kept about
    running means; weighted ones come from plain sums, so centre columns whose
    mean is far larger than their spread.
    """
    keys, p = keys or [], len(columns)
    if not p:
        raise ValueError("there are no columns to link")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    base = rows.select(*keys, w.alias("_w"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    base = base.dropna(subset=["_w", *[f"_x{k}" for k in range(p)]]).where("_w > 0")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moments = [F.count(F.lit(1)).alias("_n"), *[F.covar_pop(F.col(f"_x{i}"), F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i, j in pairs]]
    if weight is not None:  # weighted sums about a mean by group that isn't known yet: two sums and a product a pair
        total = F.sum("_w")
        mean = [F.sum(F.col("_w") * F.col(f"_x{k}")) / total for k in range(p)]
        moments[1:] = [(F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")) / total - mean[i] * mean[j]).alias(f"_s{i}_{j}") for i, j in pairs]
    sums = base.groupBy(*keys).agg(*moments).where("_n > 0")
    picked = sums.select(*keys, F.col("_n").alias("n"), F.array(*[f"_s{i}_{j}" for i, j in pairs]).alias("_s"))
    upper, off = np.triu_indices(p), np.triu_indices(p, 1)
    link = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("c", pa.float64()), ("partial", pa.float64()), ("precision", pa.float64())])

    def linked(found: list[float]) -> list[dict]:
        s = np.zeros((p, p))
        s[upper] = found
        s = s + np.triu(s, 1).T
        sd = np.sqrt(np.maximum(np.diag(s), 0))
        good = np.flatnonzero(sd > 1e-12)
        c, r, precision = np.zeros((p, p)), np.eye(p), np.full((p, p), np.nan)
        if len(good):
            at = np.ix_(good, good)
            c[at] = np.clip(s[at] / np.outer(sd[good], sd[good]), -1, 1)
            r[at], d = scaled_precision(c[at], penalty, alpha)
            precision[at] = r[at] * np.outer(d / sd[good], d / sd[good])
        return [{"i": i, "j": j, "c": c[i, j], "partial": 0.0 - r[i, j], "precision": None if np.isnan(precision[i, j]) else precision[i, j]} for i, j in zip(*off, strict=True)]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = pa.array([linked(s) for s in b.column("_s").to_pylist()], pa.list_(link))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(b.num_columns - 1)], links], [*b.schema.names[:-1], "links"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(solved, f"{kinds}, links array<struct<i:int,j:int,c:double,partial:double,precision:double>>").select(*keys, "n", F.inline("links"))
