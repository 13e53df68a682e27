"""Multi-window reweighting on (window, bin) counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_counts(binned: DataFrame, window: str, bias: Column | None = None) -> DataFrame:
    """window, bin, n and u (mean of the bias): all that the solvers need of the rows."""
    return binned.groupBy(F.col(window).alias("i"), F.col("bin").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.lit(0.0) if bias is None else bias).alias("u"))


def wham(n_ik: np.ndarray, u_ik: np.ndarray, steps: int = 100_000, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Bin probabilities and window free energies (in kT) by the fixed point of the histogram equations.

    u is the dimensionless bias of each window at each bin. All in logarithms;
    bins without counts have probability 0, windows without counts weigh nothing.
    """
    n_i, n_k = n_ik.sum(axis=1), n_ik.sum(axis=0)
    seen = n_k > 0
    log_n = np.full(len(n_k), -np.inf)
    log_n[seen] = np.log(n_k[seen])
    log_p = log_n - _lse(log_n)
    with np.errstate(divide="ignore"):
        log_w = np.log(n_i)
    f = np.zeros(len(n_i))
    for _ in range(steps):
        new = -_lse(log_p[None, :] - u_ik, axis=1)
        log_p = log_n - _lse(log_w[:, None] + new[:, None] - u_ik, axis=0)
        log_p = log_p - _lse(log_p)
        done = np.abs(new - f).max(initial=0.0) < tol
        f = new
        if done:
            break
    return np.exp(log_p), f


def _lse(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze() if axis is None else out.squeeze(axis)


def wham_errors(n_ik: np.ndarray, u_ik: np.ndarray, p: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Standard errors of -ln p from the inverse Fisher matrix of the multinomial windows."""
    q = p[None, :] * np.exp(f[:, None] - u_ik)  # each window's bin probabilities
    n_i = n_ik.sum(axis=1)
    fisher = np.diag((n_i[:, None] * q).sum(axis=0)) - np.einsum("i,ik,il->kl", n_i, q, q)
    return np.sqrt(np.clip(np.diag(np.linalg.pinv(fisher)), 0, None))


def dham(c_ikl: np.ndarray, u_ik: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased transition matrix and stationary weights from biased window counts (window, src, dst)."""
    n_ik = c_ikl.sum(axis=2)
    change = np.exp(-(u_ik[:, None, :] - u_ik[:, :, None]) / 2)  # favours lower bias
    below = np.einsum("ik,ikl->kl", n_ik, change)
    top = c_ikl.sum(axis=0)
    m = np.divide(top, below, out=np.zeros_like(top, float), where=below > 0)
    rows = m.sum(axis=1, keepdims=True)
    t = np.divide(m, rows, out=np.eye(len(m)), where=rows > 0)
    w = np.full(len(t), 1 / len(t))
    for _ in range(100_000):
        new = w @ t
        new /= new.sum()
        if np.abs(new - w).max() < 1e-14:
            break
        w = new
    return t, new


def row_weights(binned: DataFrame, solved: DataFrame) -> DataFrame:
    """binned with w = p(bin) / n(bin): each bin's probability shared by its rows. solved has bin and p."""
    n = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_bin"))
    return binned.drop("w").join(F.broadcast(solved.join(n, "bin").select("bin", (F.col("p") / F.col("n_bin")).alias("w"))), "bin")  # a row a bin


def rescale(weight: Column, energy: Column, factor: float, t: float = 300.0) -> Column:
    """Weights at another temperature: w exp(beta (1 - 1/factor) E)."""
    from tessera.operators.histogram import BOLTZMANN

    return weight * F.exp(energy * F.lit((1 - 1 / factor) / (BOLTZMANN * t)))
