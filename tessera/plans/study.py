"""A study over a store: free energies of its rounds, biases from them, new features, and rounds until they agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import bias as b
from tessera.functions.metric import Metric
from tessera.operators import histogram as h
from tessera.operators.fit import Estimator
from tessera.plans.loader import Bias, Loader
from tessera.sources.shared import cut
from tessera.sources.store import Store


@dataclass(frozen=True)
class Study:
    """The first features `cv` of a store's newest rounds, one for each axis of a metric.

    bounds fixes the grid (a pair a feature), so that surfaces of different
    rounds have the same bins; without it, each surface has its frames' own.
    windows has a row for each round (column win) with what its biases need;
    biases are energies in kT of a round at given features.
    """

    store: Store
    metric: Metric
    rounds: int = 1
    edges: int = 30
    bounds: list[tuple[float, float]] | None = None
    windows: DataFrame | None = None
    biases: dict[str, Bias] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [f"x{k}" for k in range(len(self.metric.axes))]

    def rows(self) -> DataFrame:
        """Frames of the last rounds with x0, x1, ..., their first features (within the box if periodic), and a name for their window."""
        frames = self.store.scan(num=self.rounds)
        found = {f"x{k}": axis.wrap(F.get("cv", F.lit(k))) for k, axis in enumerate(self.metric.axes)}
        return frames.withColumns(found | {"traj_id": F.concat_ws("-", "cv_round", "round", "traj"), "win": F.col("round")})

    def free_energy(self, t: float = 300.0, skip: int = 0, lag: int = 0) -> DataFrame:
        """bin, n, n_eff, density, f, sigma, observable and i0, i1, ..., the bin's place in each dimension: by weights over windows, with its spread. Bins without frames have no row."""
        loader = Loader("traj_id", ["row_id"], "row_id", self.features, "win", self.windows, self.biases, self.edges, skip, lag, bounds=self.bounds)
        found, rest, places = h.surface(loader.load(self.rows()), t, F.col("w")), F.col("bin"), {}
        for k in reversed(range(len(self.features))):  # the first is the most significant
            places[f"i{k}"] = F.pmod(rest, F.lit(self.edges - 1)).cast("int")
            rest = F.floor(rest / (self.edges - 1))
        return found.withColumns(places)

    def boxes(self) -> list[tuple[float, float]]:
        """The grid's bounds in each dimension."""
        if self.bounds is not None:
            return self.bounds
        found = h.bounds(self.rows(), self.features).first()
        return [(found[f"lo_{c}"], found[f"hi_{c}"]) for c in self.features]

    def midpoints(self, feature: int = 0) -> np.ndarray:
        lo, hi = self.boxes()[feature]
        return lo + (np.arange(self.edges - 1) + 0.5) * (hi - lo) / (self.edges - 1)

    def flattening(self, surface: DataFrame, kernel: str = "gaussian", epsilon: float = 8.0, smoothing: float = 1e-3, most: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
        """The bias that undoes a free energy, for the program that makes new frames: an interpolant through -f at midpoints, weighed by its spread.

        A dense solve on the driver over the bins that hold frames; `energies` has no such bound.
        """
        found = surface.orderBy("bin").toPandas()  # a row a bin
        boxes, d = self.boxes(), len(self.features)
        at = np.stack([lo + (found[f"i{k}"] + 0.5) * (hi - lo) / (self.edges - 1) for k, (lo, hi) in enumerate(boxes)], axis=1)
        f = found["f"].to_numpy() if most is None else np.minimum(found["f"].to_numpy(), most)
        fitted = b.interpolant(self.metric, at, -f, kernel, epsilon, smoothing, 0, found["sigma"].to_numpy())
        return lambda x: b.interpolated(self.metric, np.asarray(x, float).reshape(-1, d), at, fitted, kernel, epsilon)

    def energies(self, points: DataFrame, surface: DataFrame, most: float, name: str = "energy") -> DataFrame:
        """points (x0, x1, ...) with the energy of the flattening bias, -f and at least -most: linear between the sparse grid's midpoints, -most where there were no frames."""
        grid = surface.select(*[f"i{k}" for k in range(len(self.features))], F.greatest(-F.col("f"), F.lit(-most)).alias("value"))
        return b.grid_energy(points, grid, self.metric, self.boxes(), self.edges - 1, -most, name)

    def start_frames(self, energy: Column | None, kt: float, groups: list[str], seed: int = 0) -> DataFrame:
        """A frame for each group, drawn with the chance its energy gives it: where new runs begin."""
        return h.draw_near(self.rows(), F.lit(0.0) if energy is None else energy, kt, "row_id", groups, seed)

    def update_features(self, estimator: Estimator, cv_round: int, name: str, lag: int = 1) -> None:
        """Fits new features on the frames and their lagged partners, and stores the frames under a new cv_round, the old features with them.

        The transform is kept in the store, unless it holds free functions: `store.features(cv_round)` gives it back.
        """
        from tessera.operators import series as s

        pairs = s.lag_pairs(self.rows(), "traj_id", ["row_id"], ["cv"], lag).select("cv", F.col("cv_t").alias("later"))
        f = estimator.fit(pairs, "cv", "later")
        self.store.add_cv(name, {"lag": lag}, cv_round)
        if f.spec is not None:
            self.store.keep_features(cv_round, f)
        self.store.copy_round(cv_round, f(F.col("cv")))  # before its round is the newest
        self.store.add_round({"cv_round": cv_round, "round": 0})

    def until_agreed(self, advance: Callable[[int, Callable], None], most: int = 10, agreed: float = 0.1, t: float = 300.0) -> list[float]:
        """Divergences between successive free energies; `advance` adds a round under the bias that it is handed, until one is below `agreed`."""
        seen, old = [], self._kept(t)
        for k in range(most):
            advance(k, self.flattening(self.free_energy(t=t)))
            new = self._kept(t)
            seen.append(float(h.divergence(old, new, t).first()[0]))
            if seen[-1] < agreed:
                break
            old = new
        return seen

    def _kept(self, t: float) -> DataFrame:
        """A free energy as it is now: a row a bin."""
        return cut(self.free_energy(t=t).select("bin", "f"))
