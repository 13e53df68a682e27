"""The central plan: scan, trim, pair with later rows, weigh, sample, free energy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import histogram as h
from tessera.operators import reweight as rw
from tessera.operators import sample as sa
from tessera.operators import series as s
from tessera.operators import sparse as sp
from tessera.sources.shared import cut


def load(frames: DataFrame, traj: str, order: list[str], column: str, window: str | None = None, bias=None, edges: int = 30, skip: int = 0, lag: int = 0, least: int = 1, size: int | None = None, key: str = "row_id") -> DataFrame:  # noqa: ANN001
    """Frames with bin, w and (with lag) the column's later value; with size, a weighted sample of that many.

    bias maps (window name, bin midpoints) to energies in kT. Bins with fewer
    than `least` rows go. The solver sees one number a window and bin.
    """
    rows = s.trim(frames, traj, order, skip, lag)
    if lag:
        rows = s.lag_pairs(rows, traj, order, [column], lag)
    box = h.bounds(rows, [column])
    binned = h.assign(rows, [column], edges, box)
    kept = h.renumber(binned, least).select("bin")
    binned = binned.join(F.broadcast(kept), "bin", "left_semi")  # a row a bin
    counts = rw.window_counts(binned.withColumn("all_windows", F.lit("all")) if window is None else binned, window or "all_windows").toPandas()
    windows, bins = sorted(counts["i"].unique()), sorted(int(b) for b in counts["k"].unique())
    n = np.zeros((len(windows), len(bins)))
    for r in counts.itertuples():
        n[windows.index(r.i), bins.index(r.k)] = r.n
    lo, hi = box.first()
    middle = lo + (np.array(bins) + 0.5) * (hi - lo) / (edges - 1)
    u = np.array([bias(w, middle) for w in windows]) if bias else np.zeros_like(n)
    p, _ = rw.wham(n, u)
    solved = frames.sparkSession.createDataFrame([(b, float(v)) for b, v in zip(bins, p, strict=True)], "bin int, p double")
    weighed = rw.row_weights(binned, solved)
    if size is None:
        return weighed
    return sa.systematic(weighed, key, "w", size).join(weighed, key)


def free_energy(weighed: DataFrame, t: float = 300.0) -> DataFrame:
    """bin, n, f of loaded frames by their weights."""
    return h.free_energy(weighed, t, F.col("w"))


#: From the columns of a window and the features, an energy in kT.
Bias = Callable[[dict[str, Column], list[Column]], Column]


@dataclass(frozen=True)
class Loader:
    """How to load frames of many windows: what orders them, what they are binned by, and what biased them.

    traj and order say which frames follow each other, key names a frame.
    features are binned together, on one grid. windows has a row for each
    window, by the column `window`, with what its biases need; biases, by
    name, are energies in kT of a window at given features, of which the sum
    biased the window's frames. A window that windows doesn't have is dropped,
    as it can't be weighed.

    skip: frames left out at each trajectory's start; lag: how far on a
    frame's partner is; least: frames a bin needs; hottest: trajectories in
    which the column `temperature` goes beyond it go as a whole; wall: an
    energy in kT that makes frames rarer in a draw; most: the free energy in
    kT up to which bins are drawn from; action: a column of which a partner's
    gain gives a frame's dynamic weight; bounds: of each feature's grid, and the
    frames' own if there are none (frames beyond them go).
    """

    traj: str
    order: list[str]
    key: str
    features: list[str]
    window: str | None = None
    windows: DataFrame | None = None
    biases: dict[str, Bias] = field(default_factory=dict)
    edges: int = 30
    skip: int = 0
    lag: int = 0
    least: int = 1
    temperature: str | None = None
    hottest: float | None = None
    wall: Column | None = None
    most: float | None = None
    action: str | None = None
    bounds: list[tuple[float, float]] | None = None

    def box(self, rows: DataFrame) -> DataFrame:
        """One row: lo_<c> and hi_<c> of each feature."""
        if self.bounds is None:
            return h.bounds(rows, self.features)
        names = [f"{p}_{c}" for c in self.features for p in ("lo", "hi")]
        return rows.sparkSession.createDataFrame([tuple(float(v) for b in self.bounds for v in b)], ", ".join(f"`{n}` double" for n in names))

    def frames(self, frames: DataFrame) -> DataFrame:
        """Frames that count, each with its partner's features."""
        if self.hottest is not None:
            hot = frames.where(F.col(self.temperature) > self.hottest).select(self.traj).distinct()
            frames = frames.join(hot, self.traj, "left_anti")
        rows = s.trim(frames, self.traj, self.order, self.skip, self.lag)
        if self.lag:
            rows = s.lag_pairs(rows, self.traj, self.order, [*self.features, *([self.action] if self.action else [])], self.lag)
        if self.action:
            rows = rows.withColumn("w_dyn", F.exp(F.col(f"{self.action}_t") - F.col(self.action)) if self.lag else F.lit(1.0)).drop(f"{self.action}_t")
        return rows

    def biased(self, rows: DataFrame, features: list[Column], name: str) -> DataFrame:
        """rows of windows (column i) with each bias there, as bias_<name>, and their sum as `name`."""
        if not self.biases:
            return rows.withColumn(name, F.lit(0.0))
        known = self.windows.select(*[F.col(c).alias(f"window_{c}") for c in self.windows.columns])
        joined = rows.join(known, F.col("i") == F.col(f"window_{self.window}"))
        w = {c: F.col(f"window_{c}") for c in self.windows.columns}
        joined = joined.withColumns({f"bias_{b}": f(w, features) for b, f in self.biases.items()})
        return joined.withColumn(name, sum((F.col(f"bias_{b}") for b in self.biases), F.lit(0.0))).drop(*known.columns)

    def solved(self, binned: DataFrame, box: DataFrame, steps: int | None = None) -> DataFrame:
        """bin, n, p: rows and probability of each bin. With steps, so many of the fixed point's instead of all."""
        counts = binned.groupBy("i", F.col("bin").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        middles, rest = {}, F.col("k")
        for c in reversed(self.features):  # the first is the most significant
            number, rest = F.pmod(rest, F.lit(self.edges - 1)), F.floor(rest / (self.edges - 1))
            middles[c] = F.col(f"lo_{c}") + (number + 0.5) * (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (self.edges - 1)
        seen = self.biased(counts.crossJoin(F.broadcast(box)), [middles[c] for c in self.features], "u")  # box is one row
        state = sp.pairs(seen.select("i", "k", (-F.col("u")).alias("log_u")), counts)
        if steps is None:
            bins = sp.solve(state).bins()
        else:
            for _ in range(steps):
                state = sp.step(state)
            bins = sp.normalised(state).groupBy("k").agg(F.exp(F.first("log_p")).alias("p"))
        return bins.join(counts.groupBy("k").agg(F.sum("n").alias("n")), "k").select(F.col("k").alias("bin"), "n", "p")

    def load(self, frames: DataFrame, size: int | None = None, steps: int | None = None, select: str = "weight") -> DataFrame:
        """Frames with all their columns, `<feature>_t`, bin, i (the window), bias_<name> and bias at their own features, f, w and rho.

        f is the bin's free energy in kT, w the frame's share of the unbiased
        whole (all add up to 1). With size, so many draws (m = 1 ... size) with
        replacement, in proportion to w (select="weight") or alike for each
        bin (select="bins"), less by the wall; rho is then what a draw counts
        for so that sums over draws stand for sums over frames: without size it
        is 1. With lag, frames without partners go; labels, partners, biases
        and weights are those of the very frame, as all come from one table,
        which is written once. Only the solver's norms reach the driver.
        """
        rows = self.frames(frames).withColumn("i", F.lit("all") if self.window is None else F.col(self.window))
        rows = cut(self.biased(rows, [F.col(c) for c in self.features], "bias"))
        box = self.box(rows)
        rows = h.assign(rows, self.features, self.edges, box)
        enough = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("rows_in")).where(F.col("rows_in") >= self.least).select("bin")
        rows = rows.join(enough, "bin", "left_semi")
        bins = cut(self.solved(rows, box, steps))
        top = bins.agg(F.max("p").alias("top"))
        bins = bins.crossJoin(F.broadcast(top)).select("bin", "n", "p", (F.ln("top") - F.ln("p")).alias("f"))  # one row
        weighed = rows.join(bins, "bin").withColumn("w", F.col("p") / F.col("n"))
        if size is None:
            return weighed.withColumn("rho", F.lit(1.0)).drop("n", "p")
        share = F.col("w") if select == "weight" else 1 / F.col("n")
        share = share if self.wall is None else share * F.exp(-self.wall)
        share = share if self.most is None else F.when(F.col("f") < self.most, share).otherwise(0.0)
        weighed = cut(weighed.withColumn("share", share.cast("double")))
        total = weighed.agg(F.sum("share").alias("all_shares"))
        drawn = sa.systematic(weighed, self.key, "share", size).join(weighed, self.key).crossJoin(F.broadcast(total))  # one row
        return drawn.withColumn("rho", F.col("all_shares") / (F.col("share") * size)).drop("n", "p", "share", "all_shares")
