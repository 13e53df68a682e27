"""Queries on weighing without matrices, and on the loader in several dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import histogram as h
from tessera.operators import series as s
from tessera.operators import sparse as sp
from tessera.plans.common import ORDER, SQL_BINNED, events, r6
from tessera.plans.loader import Loader


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Moves at lag 2 of three made-up windows, and the pairs that they visit with a made-up harmonic bias."""
    binned = h.assign(events(spark, sf_dir), ["value"], 30).withColumn("i", (F.col("user_id") % 3).cast("int"))
    seen = binned.groupBy("i", F.col("bin").alias("k")).agg((-0.01 * (F.first("bin") - 6.0 * F.first("i")) * (F.first("bin") - 6.0 * F.first("i"))).alias("log_u"))
    return s.transitions(binned, "user_id", ORDER, 2, "i"), seen


def dham_likelihood_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps of the likelihood's fixed point over counts by source."""
    moves, seen = _moves(spark, sf_dir)
    state = sp.pairs(seen, moves.groupBy("i", F.col("src").alias("k")).agg(F.sum("c").alias("n")))
    for _ in range(5):
        state = sp.step(state)
    return sp.normalised(state).groupBy(F.col("k").alias("bin")).agg(F.round(F.exp(F.first("log_p")), 8).alias("p"))


def dham_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converged bins, with what is known of the moves that leave them."""
    moves, seen = _moves(spark, sf_dir)
    found = sp.dynamic(moves, seen, neighbours=20)
    out = found.moves.groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias("neighbours"), F.sum(F.exp("log_t")).alias("chance"))
    return found.solution.bins().join(out, "k", "left").select(F.col("k").alias("bin"), "p", "f", "neighbours", "chance")


def _loader(spark: SparkSession) -> Loader:
    windows = spark.range(3).select(F.col("id").alias("win"), (F.col("id") * 120.0 + 60).alias("c0"), (F.col("id") * 20.0 + 25).alias("c1"), F.lit(2e-5).alias("k0"), F.lit(1e-4).alias("k1"))
    square = lambda d: d * d
    return Loader("user_id", ORDER, "event_id", ["value", "phase"], "win", windows, {"first": lambda w, x: w["k0"] * square(x[0] - w["c0"]), "second": lambda w, x: w["k1"] * square(x[1] - w["c1"])}, edges=9, skip=4, lag=3, least=2)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumns({"win": F.col("user_id") % 3, "phase": (F.col("event_id") % 97).cast("double")})


def loaded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of three windows by two features: partner, biases, bin and weight, after five steps of the solver."""
    rows = _loader(spark).load(_frames(spark, sf_dir), steps=5)
    return rows.select("event_id", "event_type", "bin", r6("value_t").alias("value_t"), "phase_t", r6("bias_first").alias("bias_first"), r6("bias_second").alias("bias_second"), F.round("f", 5).alias("f"), F.round(F.col("w") * 1000, 5).alias("w"))


def loaded_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 draws alike for each bin, with what belongs to the very frames."""
    rows = _loader(spark).load(_frames(spark, sf_dir), 100, 5, "bins")
    return rows.select("m", "event_id", "event_type", r6("value_t").alias("value_t"), r6("bias").alias("bias"), F.round("rho", 5).alias("rho"))


QUERIES = {f.__name__: f for f in (dham_likelihood_steps, dham_likelihood, loaded_frames, loaded_draw)}


def _steps(n: int) -> str:
    """CTEs s1 ... sn of the fixed point over c (i, k, n, u), from s0 (k, p)."""
    out = "ni AS (SELECT i, sum(n) n FROM c GROUP BY i), nk AS (SELECT k, sum(n) n FROM c GROUP BY k HAVING sum(n) > 0), s0 AS (SELECT k, n / sum(n) OVER () p FROM nk)"
    for t in range(1, n + 1):
        out += f""", z{t} AS (SELECT i, sum(p * exp(-u)) z FROM c JOIN s{t - 1} USING (k) GROUP BY i),
s{t} AS (SELECT k, any_value(nk.n) / sum(ni.n * exp(-u) / z) p FROM c JOIN z{t} USING (i) JOIN ni USING (i) JOIN nk USING (k) GROUP BY k)"""
    return out


_LOAD = f"""WITH e AS (SELECT *, user_id % 3 win, CAST(event_id % 97 AS DOUBLE) phase, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 r, count(*) OVER (PARTITION BY user_id) rows_in FROM events),
l AS (SELECT *, lead(value, 3) OVER q value_t, lead(phase, 3) OVER q phase_t FROM e WHERE r >= 4 AND rows_in > 7 WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, 2e-5 * pow(value - win * 120 - 60, 2) b1, 1e-4 * pow(phase - win * 20 - 25, 2) b2 FROM l WHERE value_t IS NOT NULL),
x AS (SELECT min(value) l0, (max(value) - min(value)) / 8 h0, max(value) m0, min(phase) l1, (max(phase) - min(phase)) / 8 h1, max(phase) m1 FROM g),
o AS (SELECT g.*, CAST(least(floor((value - l0) / h0), 7) * 8 + least(floor((phase - l1) / h1), 7) AS INT) bin FROM g, x WHERE value > l0 AND value < m0 AND phase > l1 AND phase < m1),
y AS (SELECT * FROM o WHERE bin IN (SELECT bin FROM o GROUP BY bin HAVING count(*) >= 2)),
c AS (SELECT win i, bin k, count(*) n, any_value(2e-5 * pow(l0 + (bin // 8 + 0.5) * h0 - win * 120 - 60, 2) + 1e-4 * pow(l1 + (bin % 8 + 0.5) * h1 - win * 20 - 25, 2)) u FROM y, x GROUP BY win, bin), {_steps(5)},
t AS (SELECT k bin, p / sum(p) OVER () p, n, ln(max(p) OVER ()) - ln(p) f FROM s5 JOIN nk USING (k)),
w AS (SELECT y.*, f, p / n w, 1.0 / n share FROM y JOIN t USING (bin))"""

SQL = {
    "dham_likelihood_steps": f"""WITH {SQL_BINNED}, d AS (SELECT CAST(user_id % 3 AS INT) i, bin, lead(bin, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) later FROM m),
c AS (SELECT i, bin k, count(later) n, 0.01 * (bin - 6.0 * i) * (bin - 6.0 * i) u FROM d GROUP BY i, bin), {_steps(5)} SELECT k AS bin, round(p / sum(p) OVER (), 8) AS p FROM s5""",
    "loaded_frames": _LOAD + " SELECT event_id, event_type, bin, round(value_t, 6) AS value_t, phase_t, round(b1, 6) AS bias_first, round(b2, 6) AS bias_second, round(f, 5) AS f, round(w * 1000, 5) AS w FROM w",
    "loaded_draw": _LOAD + """, h AS (SELECT *, sum(share) OVER (ORDER BY event_id) hi, sum(share) OVER () s FROM w)
SELECT CAST(m AS INT) AS m, event_id, event_type, round(value_t, 6) AS value_t, round(b1 + b2, 6) AS bias, round(s / (share * 100), 5) AS rho FROM range(1, 101) r(m) JOIN h ON (m - 0.5) / 100 >= (hi - share) / s AND (m - 0.5) / 100 < hi / s""",
}
