"""Multi-window reweighting without a matrix: the solvers' state is a table of the (window, bin) pairs that were seen.

Both the histogram equations and the likelihood of dynamic histograms lead to
one fixed point for bin probabilities p:

    z_i = sum_k p_k U_ik,    p_k = N_k / sum_i N_i U_ik / z_i,

over pairs that were seen; U is exp(-bias) and N are counts (of rows, or of
moves by their source). A step is two windowed sums, over the pairs of a window
and those of a bin. Nothing but norms and the loss reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import series as s
from tessera.sources.shared import cut


def pairs(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """The state of the solvers: i, k, log_u, n, log_n_i, log_n_k, log_p, with p at the counts' shares.

    seen has a row for each window i and bin k that it visited, with log_u
    (minus its bias there, in kT); counts has i, k, n and may lack pairs.
    """
    both = seen.select("i", "k", F.col("log_u").cast("double").alias("log_u")).join(counts.select("i", "k", F.col("n").cast("double").alias("n")), ["i", "k"], "left").fillna(0.0, ["n"])
    both = both.withColumns({"n_i": F.sum("n").over(Window.partitionBy("i")), "n_k": F.sum("n").over(Window.partitionBy("k"))})
    total = both.agg(F.sum("n").alias("all"))
    # A bin or window without counts has probability 0 and no weight.
    both = both.where("n_k > 0 and n_i > 0").crossJoin(F.broadcast(total))  # one row
    return both.select("i", "k", "log_u", "n", F.ln("n_i").alias("log_n_i"), F.ln("n_k").alias("log_n_k"), F.ln(F.col("n_k") / F.col("all")).alias("log_p"))


def _lse(value: str, keys: str):  # noqa: ANN202
    """ln sum exp over a window, the greatest value first."""
    w = Window.partitionBy(keys)
    top = F.max(value).over(w)
    return top + F.ln(F.sum(F.exp(F.col(value) - F.col(f"{value}_top"))).over(w)), top


def step(state: DataFrame, start: str = "log_p", end: str = "log_p") -> DataFrame:
    """state with column `end`: the fixed point's next value from `start`, up to a constant; and log_z, each window's normalisation at `start`."""
    for value, keys, out in (("step_a", "i", "log_z"), ("step_b", "k", "step_d")):
        term = F.col(start) + F.col("log_u") if keys == "i" else F.col("log_n_i") + F.col("log_u") - F.col("log_z")
        total, top = _lse(value, keys)
        state = state.withColumn(value, term).withColumn(f"{value}_top", top).withColumn(out, total).drop(value, f"{value}_top")
    return state.withColumn(end, F.col("log_n_k") - F.col("step_d")).drop("step_d")


def _by_bin(state: DataFrame, columns: list[str]) -> DataFrame:
    return state.groupBy("k").agg(*[F.first(c).alias(c) for c in columns])


def normalised(state: DataFrame, column: str = "log_p") -> DataFrame:
    """state with the column's probabilities adding up to 1."""
    bins = _by_bin(state, [column])
    top = bins.agg(F.max(column).alias("top"))
    total = bins.crossJoin(F.broadcast(top)).agg((F.max("top") + F.ln(F.sum(F.exp(F.col(column) - F.col("top"))))).alias("log_all"))
    return state.crossJoin(F.broadcast(total)).withColumn(column, F.col(column) - F.col("log_all")).drop("log_all")  # one row each


def loss(state: DataFrame, column: str, log_z: str = "log_z") -> DataFrame:
    """One row: minus the likelihood at `column`, whose normalisation of windows is log_z, without what p doesn't move."""
    windows = state.groupBy("i").agg(F.first(log_z).alias("z"), F.first("log_n_i").alias("m")).agg(F.sum(F.exp("m") * F.col("z")).alias("z"))
    return state.agg(F.sum(F.col("n") * F.col(column)).alias("x")).crossJoin(windows).select((F.col("z") - F.col("x")).alias("loss"))


@dataclass(frozen=True)
class Solution:
    """state: the pairs with log_p and log_z, normalised; steps that were taken; whether a step moved no bin by `tol` any more."""

    state: DataFrame
    steps: int
    loss: float
    converged: bool

    def bins(self) -> DataFrame:
        """k, p, f: probabilities, and free energies in kT with the least at 0."""
        rows = _by_bin(self.state, ["log_p"])
        return rows.crossJoin(F.broadcast(rows.agg(F.max("log_p").alias("top")))).select("k", F.exp("log_p").alias("p"), (F.col("top") - F.col("log_p")).alias("f"))

    def weights(self) -> DataFrame:
        """i, k, log_w: what a row of window i in bin k weighs."""
        return self.state.select("i", "k", (F.col("log_p") - F.col("log_u")).alias("log_w"))


def solve(state: DataFrame, most: int = 3000, tol: float = 1e-9) -> Solution:
    """The fixed point, by pairs of steps and their extrapolation.

    A round takes two steps, measures how they differ and goes on along their
    difference; where that made the likelihood worse, it goes back to the last
    step's end. A round is a table in the shared folder; the driver sees four
    numbers of it.
    """
    state, taken, reach, worst = cut(state.withColumn("safe", F.col("log_p"))), 0, 4.0, math.inf
    while True:
        now = step(step(state, "log_p", "p1").withColumnRenamed("log_z", "z0"), "p1", "p2")
        now = cut(normalised(normalised(now, "p1"), "p2"))
        taken += 2
        r, v = F.col("p1") - F.col("log_p"), F.col("p2") - 2 * F.col("p1") + F.col("log_p")
        moves = _by_bin(now, ["log_p", "p1", "p2"]).agg(F.sum(r * r), F.sum(v * v), F.max(F.abs(F.col("p2") - F.col("p1")))).first()
        here = loss(now, "log_p", "z0").first()["loss"]
        if here > worst + 1e-12 * abs(worst):  # the extrapolation went too far
            state, worst, reach = now.withColumn("log_p", F.col("safe")).drop("z0", "p1", "p2", "log_z"), math.inf, 1.0
            state = cut(state)
            continue
        worst = here
        if moves[2] < tol or taken >= most:
            done = now.withColumn("log_p", F.col("p2")).drop("safe", "z0", "p1", "p2", "log_z")
            done = cut(normalised(step(done, "log_p", "next").drop("next")))
            return Solution(done, taken, loss(done, "log_p").first()["loss"], moves[2] < tol)
        far = min(max(math.sqrt(moves[0] / moves[1]) if moves[1] > 0 else 1.0, 1.0), reach)
        reach = reach * 4 if far == reach else reach
        onward = F.col("log_p") + 2 * far * r + far * far * v
        state = now.select(*[c for c in now.columns if c not in ("log_p", "safe", "z0", "p1", "p2", "log_z")], onward.alias("log_p"), F.col("p2").alias("safe"))


@dataclass(frozen=True)
class Dynamics:
    """A solution for bins, and moves (src, dst, c, log_t) between them."""

    solution: Solution
    moves: DataFrame


def dynamic(moves: DataFrame, seen: DataFrame, neighbours: int | None = None, most: int = 3000, tol: float = 1e-9) -> Dynamics:
    """Dynamic histograms by their likelihood, over the moves that occur.

    moves has i, src, dst and c; seen as in pairs. With neighbours, only that
    many most frequent destinations of a source (over all windows) count. The
    likelihood falls into two parts: transition chances are shares of the
    pooled counts, and bins have the fixed point with counts by source.
    """
    pooled = moves.groupBy("src", "dst").agg(F.sum("c").alias("c"))
    if neighbours is not None:
        pooled = s.top_destinations(pooled, neighbours).drop("rank")
        moves = moves.join(pooled.select("src", "dst"), ["src", "dst"], "left_semi")
    counts = moves.groupBy("i", F.col("src").alias("k")).agg(F.sum("c").alias("n"))
    chances = s.stochastic(pooled).select("src", "dst", "c", F.ln("p").alias("log_t"))
    return Dynamics(solve(pairs(seen, counts), most, tol), chances)
