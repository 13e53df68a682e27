"""Per-frame algorithms that expressions can't hold: lattice reduction, canonical frames, descriptors, transport.

Most are plain numpy for one frame; `per_frame` runs one over a table in Arrow
batches, and `per_block` runs one that takes many padded frames at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def per_frame(rows: DataFrame, columns: list[str], f: Callable[..., np.ndarray], name: str, kind: str = "array<array<double>>") -> DataFrame:
    """rows with `name` = f(columns as numpy arrays); rows where a column is null get null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = []
            for row in zip(*[b[c] for c in columns], strict=True):
                values.append(None if any(v is None for v in row) else f(*[np.array([np.asarray(x, float) for x in v]) if np.ndim(v[0]) else np.asarray(v, float) for v in row]).tolist())
            yield b.assign(**{name: pd.Series(values, index=b.index, dtype=object)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name)
    return rows.mapInPandas(run, f"{fields}, `{name}` {kind}")


#: Numbers of one padded block that are worked on at once, at most.
BLOCK = 1 << 20


def per_block(rows: DataFrame, column: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str, power: int = 1) -> DataFrame:
    """rows with `name`, an array of arrays: f's rows for each point of a frame, an array<array<double>> column.

    Frames of like sizes are padded with NaN to one (frames, points, d) array
    and f works on all of them at once, with their sizes; it gives (frames,
    points, ...), of which the padding is cut off. power says by which power of
    the number of points f's memory grows; blocks are sized by it. Frames that
    are null or hold a null give null, frames without points an empty array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values: list = [None] * b.num_rows
            frames = b.column(column).to_pylist()
            sizes = np.array([-1 if x is None or any(v is None or None in v for v in x) else len(x) for x in frames], np.int64)
            for k in np.flatnonzero(sizes == 0):
                values[k] = []
            like = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))), -1).astype(int)
            for width in np.unique(like[like >= 0]):
                own = np.flatnonzero(like == width)
                most = int(sizes[own].max())
                step = max(1, BLOCK // most**power)
                for part in (own[at : at + step] for at in range(0, len(own), step)):
                    block = np.full((len(part), most, len(frames[part[0]][0])), np.nan)
                    for place, k in enumerate(part):
                        block[place, : sizes[k]] = frames[k]
                    for k, found in zip(part, f(block, sizes[part]), strict=True):
                        values[k] = found[: sizes[k]].reshape(sizes[k], -1).tolist()
            names = [n for n in b.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(values, pa.list_(pa.list_(pa.float64())))], [*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name)
    return rows.mapInArrow(run, f"{fields}, `{name}` array<array<double>>")


def minkowski_reduce(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shortest basis of a lattice and the whole-number rows that make it: reduced = op @ cell.

    The longest vector is shortened by whole multiples of the others until
    nothing gets shorter; vectors come by length, and ties by their parts.
    """
    op = np.eye(3)
    steps = np.array(list(product((-1, 0, 1), repeat=2)))
    while True:
        now = op @ cell
        order = np.lexsort((*now.T[::-1], np.round(np.linalg.norm(now, axis=1), 12)))
        op, now = op[order], now[order]
        a, b, c = now
        # The nearest multiples of the shorter two to the longest, and their neighbours.
        g = np.array([[a @ a, a @ b], [a @ b, b @ b]])
        x = np.round(np.linalg.solve(g, [a @ c, b @ c])) if abs(np.linalg.det(g)) > 1e-14 else np.zeros(2)
        trial = x + steps
        lengths = np.linalg.norm(c - trial @ now[:2], axis=1)
        best = trial[lengths.argmin()]
        k = np.round(a @ b / (a @ a))
        if np.linalg.norm(b - k * a) < np.linalg.norm(b) - 1e-10:
            op[1] -= k * op[0]
        elif lengths.min() < np.linalg.norm(c) - 1e-10:
            op[2] -= best @ op[:2]
        else:
            return now, op


def rotate_cell(cell: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell in lower triangular form with a positive diagonal, and positions turned with it."""
    q, r = np.linalg.qr(cell.T)
    sign = np.sign(np.diag(r))
    sign[sign == 0] = 1
    return (r * sign[:, None]).T, positions @ (q * sign)


def canonical(cell: np.ndarray, positions: np.ndarray, rotate: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Reduced, optionally turned, and wrapped into the cell."""
    cell, _ = minkowski_reduce(cell)
    if rotate:
        cell, positions = rotate_cell(cell, positions)
    u = positions @ np.linalg.inv(cell)
    u = u - np.floor(u + 1e-12)
    return cell, u @ cell


def lattice_invariants(cell: np.ndarray) -> np.ndarray:
    """Three lengths and three acute angles of the reduced cell."""
    c, _ = minkowski_reduce(cell)
    n = np.linalg.norm(c, axis=1)
    cosines = [abs(c[i] @ c[j]) / (n[i] * n[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.concatenate([n, np.arccos(np.clip(cosines, 0, 1))])


def spherical_jn(top: int, z: np.ndarray) -> np.ndarray:
    """Spherical Bessel functions of order 0 to top: downward recurrence, scaled by j0 (or j1 where j0 is near 0)."""
    z = np.asarray(z, float)
    safe = np.where(np.abs(z) < 1e-8, 1.0, z)
    j0, j1 = np.sin(safe) / safe, np.sin(safe) / safe**2 - np.cos(safe) / safe
    start = top + 20 + int(np.max(np.abs(safe), initial=0))
    out = np.zeros((start + 2, *z.shape))
    out[start] = 1e-30
    for n in range(start, 0, -1):
        out[n - 1] = (2 * n + 1) / safe * out[n] - out[n + 1]
        large = np.abs(out[n - 1]) > 1e150
        out[:, large] *= 1e-150
    use0 = np.abs(j0) >= np.abs(j1)
    scale = np.where(use0, j0 / np.where(out[0] == 0, 1, out[0]), j1 / np.where(out[1] == 0, 1, out[1]))
    out = out[: top + 1] * scale
    small = np.abs(z) < 1e-8
    out[0] = np.where(small, 1.0, out[0])
    out[1:] = np.where(small, 0.0, out[1:])
    return out


def legendre(top: int, x: np.ndarray) -> np.ndarray:
    out = [np.ones_like(x), x]
    for n in range(1, top):
        out.append(((2 * n + 1) * x * out[n] - n * out[n - 1]) / (n + 1))
    return np.stack(out[: top + 1])


def bessel_spectrum(positions: np.ndarray, r_cut: float = 3.0, n_max: int = 3, l_max: int = 2) -> np.ndarray:
    """A power spectrum for each atom: radial Bessel functions of neighbours, joined over pairs by Legendre polynomials of their angle."""
    d = positions[None] - positions[:, None]
    r = np.linalg.norm(d, axis=-1)
    out = []
    for i in range(len(positions)):
        near = np.flatnonzero((r[i] < r_cut) & (r[i] > 1e-12))
        u, x = d[i, near] / r[i, near, None], r[i, near]
        fade = 0.5 * (1 + np.cos(np.pi * x / r_cut))
        radial = np.stack([spherical_jn(l_max, (n + 1) * np.pi * x / r_cut) * fade for n in range(n_max)])
        angular = legendre(l_max, np.clip(u @ u.T, -1, 1))
        p = np.einsum("nlj,ljk,mlk->nml", radial, angular, radial)
        out.append(p[np.triu_indices(n_max)].ravel())
    return np.array(out)


def bessel_spectra(positions: np.ndarray, sizes: np.ndarray, r_cut: float = 3.0, n_max: int = 3, l_max: int = 2) -> np.ndarray:
    """bessel_spectrum of many frames at once, padded to one (frames, points, 3) array."""
    live = np.arange(positions.shape[1]) < sizes[:, None]
    p = np.where(live[..., None], positions, 0.0)
    d = p[:, None] - p[:, :, None]
    r = np.linalg.norm(d, axis=-1)
    near = (r < r_cut) & (r > 1e-12) & live[:, None] & live[:, :, None]
    x = np.where(near, r, 1.0)
    fade = np.where(near, 0.5 * (1 + np.cos(np.pi * x / r_cut)), 0.0)
    radial = np.stack([spherical_jn(l_max, (n + 1) * np.pi * x / r_cut) * fade for n in range(n_max)])
    u = d / x[..., None]
    angular = legendre(l_max, np.clip(u @ u.swapaxes(-1, -2), -1, 1))
    half = np.einsum("laijk,mlaik->mlaij", angular, radial)
    spectrum = np.einsum("nlaij,mlaij->nmlai", radial, half)[np.triu_indices(n_max)]
    return np.moveaxis(spectrum, (0, 1), (-2, -1)).reshape(*positions.shape[:2], -1)


def sinkhorn(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, steps: int = 1000, tol: float = 1e-12) -> float:
    """Entropic transport cost between two sets of feature rows with even weights, in logarithms."""
    cost = ((x[:, None] - y[None]) ** 2).sum(-1)
    a, b = -np.log(len(x)), -np.log(len(y))
    f, g = np.zeros(len(x)), np.zeros(len(y))
    lse = lambda m, axis: m.max(axis=axis) + np.log(np.exp(m - m.max(axis=axis, keepdims=True)).sum(axis=axis))
    for _ in range(steps):
        new = -alpha * lse((g[None] - cost) / alpha + b, 1)
        g = -alpha * lse((new[:, None] - cost) / alpha + a, 0)
        done = np.abs(new - f).max() < tol
        f = new
        if done:
            break
    plan = np.exp((f[:, None] + g[None] - cost) / alpha + a + b)
    return float((plan * cost).sum())


def transport(costs_from: np.ndarray, kinds: np.ndarray, references: list[tuple[np.ndarray, np.ndarray]], alpha: float = 0.1) -> np.ndarray:
    """Entropic transport costs of a frame's feature rows to each reference's, summed over kinds that both hold."""
    out = []
    for rows, own in references:
        shared = np.intersect1d(kinds, own)
        out.append(sum(sinkhorn(costs_from[kinds == k], rows[own == k], alpha) for k in shared))
    return np.array(out, float)


def bessel_j(order: int, z: np.ndarray) -> np.ndarray:
    """Bessel functions of whole order: downward recurrence, scaled by 1 = J0 + 2 J2 + 2 J4 + ..."""
    z = np.asarray(z, float)
    safe = np.where(np.abs(z) < 1e-12, 1.0, z)
    start = 2 * ((order + 30 + int(1.5 * np.max(np.abs(safe), initial=0))) // 2)
    above, now, total, found = np.zeros_like(safe), np.full_like(safe, 1e-280), np.zeros_like(safe), np.zeros_like(safe)
    for n in range(start, -1, -1):
        if n == order:
            found = now.copy()
        if n % 2 == 0:
            total += now if n == 0 else 2 * now
        above, now = now, 2 * n / safe * now - above
        large = np.abs(now) > 1e200
        for x in (above, now, total, found):
            x[large] *= 1e-200
    return np.where(np.abs(z) < 1e-12, float(order == 0), found / total)


def envelope_inefficiency(x: np.ndarray, cut: float = 0.05) -> float:
    """Statistical inefficiency (1 + e) / (1 - e), where e = exp(-1 / tau) is the decay a row of the autocorrelation's envelope.

    The envelope at a lag is the greatest modulus from there on, so that
    oscillations count by their peaks; tau comes from a straight line through
    its logarithm as far as it stays above `cut`, and above the noise.
    """
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    if n < 4 or not x.any():
        return 1.0
    acf = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2)[:n]
    envelope = np.maximum.accumulate(np.abs(acf / acf[0])[::-1])[::-1]
    low = envelope < max(cut, 2 / np.sqrt(n))
    stop = int(np.argmax(low)) if low.any() else n
    if stop < 2:
        return 1.0
    t, weight = np.arange(stop), envelope[:stop]
    e = np.exp(min(0.0, (weight * t * np.log(weight)).sum() / (weight * t * t).sum()))
    return float(n if e >= 1 else max(1.0, (1 + e) / (1 - e)))


def block_inefficiency(x: np.ndarray) -> float:
    """Statistical inefficiency from the variances of block means for sizes 1 to n / 10: fitted by b g / (b + g - 1), which tends to g."""
    x = np.asarray(x, float)
    n = len(x)
    sizes = np.arange(1, max(2, n // 10))
    if n < 20 or x.var() == 0:
        return 1.0
    total, spread = np.append(0.0, np.cumsum(x - x.mean())), x.var()
    seen = np.array([np.diff(total[: n // b * b + 1 : b]).var() / b for b in sizes]) / spread
    trials = np.geomspace(1, max(2.0, n / 2), 400)
    few = max(1, (1 << 20) // len(sizes))
    misfit = np.concatenate([((sizes * g / (sizes + g - 1) - seen) ** 2).sum(axis=1) for g in (trials[k : k + few, None] for k in range(0, len(trials), few))])
    return float(trials[int(np.argmin(misfit))])


def best_start(x: np.ndarray, points: int = 20, rule: Callable[[np.ndarray], float] = envelope_inefficiency) -> int:
    """The row to start from, of `points` even ones, that leaves most independent rows."""
    starts = np.linspace(0, len(x), points, endpoint=False).astype(int)
    return int(starts[int(np.argmax([(len(x) - s) / rule(x[s:]) for s in starts]))])


def inefficiency(x: np.ndarray) -> float:
    """Statistical inefficiency of a series: 1 + 2 sum of its autocorrelation up to the first that isn't positive, by FFT."""
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    if n < 3 or not x.any():
        return 1.0
    power = np.abs(np.fft.rfft(x, 2 * n)) ** 2
    acf = np.fft.irfft(power)[:n] / np.arange(n, 0, -1)
    acf /= acf[0]
    stop = int(np.argmax(acf <= 0)) if (acf <= 0).any() else n
    return float(max(1.0, 1 + 2 * (acf[1:stop] * (1 - np.arange(1, stop) / n)).sum()))


def series_inefficiencies(rows: DataFrame, traj: str, order: list[str], column: str, rules: dict[str, Callable[[np.ndarray], float]]) -> DataFrame:
    """traj and a column a rule: each trajectory's statistical inefficiency by several rules over its series, read once."""
    kind = rows.schema[traj].dataType.simpleString()

    def one(group: pa.Table) -> pa.Table:
        x = group.sort_by([(c, "ascending") for c in order]).column(column).to_numpy()
        return pa.table({traj: group.column(traj).slice(0, 1), **{name: pa.array([rule(x)], pa.float64()) for name, rule in rules.items()}})

    schema = f"`{traj}` {kind}, " + ", ".join(f"`{name}` double" for name in rules)
    return rows.select(traj, *order, column).groupBy(traj).applyInArrow(one, schema)


def series_inefficiency(rows: DataFrame, traj: str, order: list[str], column: str, rule: Callable[[np.ndarray], float] | None = None) -> DataFrame:
    """traj, g: each trajectory's statistical inefficiency, by a rule over its series."""
    return series_inefficiencies(rows, traj, order, column, {"g": rule or inefficiency})


def sparse_precision(s: np.ndarray, weight: float = 0.1, steps: int = 500, rho: float = 1.0) -> np.ndarray:
    """Graphical lasso: the inverse of a correlation matrix with small partial correlations drawn to 0 (alternating directions)."""
    z = u = np.zeros_like(s)
    for _ in range(steps):
        values, vectors = np.linalg.eigh(rho * (z - u) - s)
        x = (vectors * ((values + np.sqrt(values**2 + 4 * rho)) / (2 * rho))) @ vectors.T
        old, t = z, x + u
        z = np.sign(t) * np.maximum(np.abs(t) - weight / rho * (1 - np.eye(len(s))), 0)
        u = u + x - z
        if np.abs(z - old).max() < 1e-10:
            break
    return z
