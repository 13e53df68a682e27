"""Queries of operators for long trajectories, tall tables, many centres, and fits to moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bias as b
from tessera.functions.metric import Axis, Metric
from tessera.operators import correlation, fit, hills, precision
from tessera.operators import histogram as h
from tessera.operators import moments as mo
from tessera.plans.common import KT, ORDER, events, r6, table, vectors


def independent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical inefficiency of a slow wave under noise, a trajectory an event type."""
    rows = events(spark, sf_dir).withColumn("wave", F.col("value") / 100 + 3 * F.sin(F.col("event_id") / 400))
    return correlation.inefficiency(rows, "event_type", ORDER, "wave", 64).select("event_type", "n", F.round("g", 4).alias("g"))


def singular_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's parts along the two singular directions of (value, user_id), and the singular values."""
    rows = events(spark, sf_dir).select("event_id", F.array("value", F.col("user_id").cast("double")).alias("x"))
    s, v = mo.singular_values(rows, "x")
    part = lambda k: F.abs(F.get("x", F.lit(0)) * float(v[0, k]) + F.get("x", F.lit(1)) * float(v[1, k]))
    return rows.select("event_id", *[F.round(part(k), 5).alias(f"p{k}") for k in range(2)], *[F.round(F.lit(float(s[k])), 4).alias(f"s{k}") for k in range(2)])


def hills_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hill at every event, on a periodic axis of value and a plain one of user, summed at every event."""
    rows = events(spark, sf_dir)
    points = rows.select("event_id", F.col("value").alias("x0"), F.col("user_id").cast("double").alias("x1"))
    centres = rows.select(F.col("value").alias("c0"), F.col("user_id").cast("double").alias("c1"), (1 + F.col("event_id") % 3).alias("height"))
    axes = Metric((Axis(0.0, 500.0, periodic=True), Axis(0.0, 1500.0)))
    return hills.near_sums(points, "event_id", centres, axes, [5.0, 2.0]).select("event_id", r6("bias").alias("bias"))


def flattened_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bias that undoes the free energy over (value, user_id), at every event."""
    rows = events(spark, sf_dir).select("event_id", F.col("value").alias("x0"), F.col("user_id").cast("double").alias("x1"))
    axes, boxes = Metric((Axis(0.0, 500.0), Axis(0.0, 60.0, periodic=True))), [(0.0, 500.0), (0.0, 60.0)]
    inside = rows.withColumn("x1", F.col("x1") % 60 + 0.5)
    box = spark.createDataFrame([(0.0, 500.0, 0.0, 60.0)], "lo_x0 double, hi_x0 double, lo_x1 double, hi_x1 double")
    found = h.surface(h.assign(inside, ["x0", "x1"], 13, box), 300.0)
    grid = found.select(F.floor(F.col("bin") / 12).alias("i0"), (F.col("bin") % 12).alias("i1"), F.greatest(-F.col("f"), F.lit(-6.0)).alias("value"))
    return b.grid_energy(rows, grid, axes, boxes, 12, -6.0).select("event_id", F.round("energy", 5).alias("energy"))


def partial_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalised partial correlation of quantity with a price that it is part of, by return flag and status."""
    rows = table(spark, sf_dir, "lineitem").withColumn("part_price", F.col("l_quantity") + F.col("l_extendedprice") / 2000)
    found = precision.partial_links(rows, ["l_quantity", "part_price"], ["l_returnflag", "l_linestatus"], penalty=0.1)
    return found.select("l_returnflag", "l_linestatus", "n", *[r6(c).alias(c) for c in ("c", "partial", "precision")])


def fitted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's indicator: two soft steps along its first dimension, weighed to set labels apart."""
    rows = vectors(spark, sf_dir).select("vec_id", "label", F.slice("x", 1, 1).alias("x"))
    f = fit.soft_steps(2, 1, "label").fit(rows, "x", None)
    return rows.select("vec_id", F.round(F.get(f(F.col("x")), F.lit(0)), 5).alias("indicator"))


QUERIES = {f.__name__: f for f in (independent_rows, singular_parts, hills_near, flattened_2d, partial_links, fitted_steps)}

SQL = {
    "flattened_2d": f"""WITH g AS (SELECT CAST(floor(value / (500 / 12)) AS INT) i0, CAST(floor((user_id % 60 + 0.5) / 5) AS INT) i1, count(*) n FROM events WHERE value > 0 AND value < 500 GROUP BY 1, 2),
v AS (SELECT i0, i1, greatest({KT} * ln(n / (SELECT max(n) FROM g)), -6) v FROM g),
u AS (SELECT event_id, least(greatest(value / (500 / 12) - 0.5, 0), 11) u0, (user_id % 60) / 5 - 0.5 u1 FROM events),
c AS (SELECT *, CAST(least(floor(u0), 10) AS INT) c0, CAST(floor(u1) AS INT) c1 FROM u)
SELECT event_id, round(sum((CASE WHEN o0 = 1 THEN u0 - c0 ELSE 1 - u0 + c0 END) * (CASE WHEN o1 = 1 THEN u1 - c1 ELSE 1 - u1 + c1 END) * coalesce(v, -6)), 5) energy
FROM c CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(o0, o1) LEFT JOIN v ON v.i0 = c0 + o0 AND v.i1 = (c1 + o1 + 12) % 12 GROUP BY event_id""",
    "independent_rows": """WITH w AS (SELECT event_type, value / 100 + 3 * sin(event_id / 400) x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) r FROM events),
m AS (SELECT event_type, avg(x) mean, count(*) n FROM w GROUP BY 1),
d AS (SELECT w.event_type, r, x - mean d, n FROM w JOIN m USING (event_type)),
s AS (SELECT a.event_type, a.n, b.r - a.r lag, sum(a.d * b.d) v FROM d a JOIN d b ON a.event_type = b.event_type AND b.r >= a.r GROUP BY 1, 2, 3),
e AS (SELECT event_type, min(lag) stop FROM s WHERE v <= 0 GROUP BY 1)
SELECT s.event_type, n, round(greatest(1, 1 + 2 * coalesce(sum(v) FILTER (lag > 0), 0) / max(v) FILTER (lag = 0)), 4) g
FROM s LEFT JOIN e ON s.event_type = e.event_type WHERE lag < coalesce(stop, n) GROUP BY 1, 2""",
    "singular_parts": """WITH m AS (SELECT sum(value * value) a, sum(value * user_id) b, sum(user_id::DOUBLE * user_id) c FROM events),
t AS (SELECT *, atan2(2 * b, a - c) / 2 u, sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) h FROM m)
SELECT event_id, round(abs(value * cos(u) + user_id * sin(u)), 5) p0, round(abs(user_id * cos(u) - value * sin(u)), 5) p1,
round(sqrt((a + c) / 2 + h), 4) s0, round(sqrt((a + c) / 2 - h), 4) s1 FROM events, t""",
    "hills_near": """SELECT p.event_id, round(sum((1 + c.event_id % 3) * exp(-pow(p.value - c.value - 500 * round((p.value - c.value) / 500), 2) / 50 - pow(p.user_id - c.user_id, 2) / 8)), 6) bias
FROM events p JOIN events c ON c.user_id BETWEEN p.user_id - 40 AND p.user_id + 40 GROUP BY 1""",
    "partial_links": """WITH RECURSIVE g AS (SELECT l_returnflag, l_linestatus, count(*) n, corr(l_quantity, l_quantity + l_extendedprice / 2000) c, stddev_pop(l_quantity) s0, stddev_pop(l_quantity + l_extendedprice / 2000) s1 FROM lineitem GROUP BY 1, 2),
h AS (SELECT *, 0 k, -c lo, 0::DOUBLE hi FROM g
UNION ALL SELECT l_returnflag, l_linestatus, n, c, s0, s1, k + 1, CASE WHEN (lo + hi) / 2 + c < 0.1 * (1 - (lo + hi) * (lo + hi) / 4) * (1 + (lo + hi) / 2 * c) THEN (lo + hi) / 2 ELSE lo END,
CASE WHEN (lo + hi) / 2 + c < 0.1 * (1 - (lo + hi) * (lo + hi) / 4) * (1 + (lo + hi) / 2 * c) THEN hi ELSE (lo + hi) / 2 END FROM h WHERE k < 50)
SELECT l_returnflag, l_linestatus, n, round(c, 6) c, round(-lo, 6) partial, round(lo / (1 + lo * c) / (s0 * s1), 6) "precision" FROM h WHERE k = 50""",
    "fitted_steps": """WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE x FROM embeddings), b AS (SELECT min(x) lo, (max(x) - min(x)) / 2 w FROM v),
s AS (SELECT vec_id, label, (tanh((x - lo - w / 2) / w) + 1) / 2 p, (tanh((x - lo - 3 * w / 2) / w) + 1) / 2 q FROM v, b),
t AS (SELECT var_pop(p) tp, covar_pop(p, q) tx, var_pop(q) tq FROM s),
l AS (SELECT avg(p) OVER (PARTITION BY label) p, avg(q) OVER (PARTITION BY label) q FROM s),
m AS (SELECT *, tp * tq - tx * tx det FROM t, (SELECT var_pop(p) bp, covar_pop(p, q) bx, var_pop(q) bq FROM l)),
e AS (SELECT *, (bp * tq + bq * tp - 2 * bx * tx) / (2 * det) half, (bp * bq - bx * bx) / det prod FROM m),
r AS (SELECT *, half + sqrt(half * half - prod) top FROM e),
d AS (SELECT *, top * tx - bx y0, bp - top * tp y1 FROM r),
n AS (SELECT *, sqrt(y0 * y0 * tp + 2 * y0 * y1 * tx + y1 * y1 * tq) len FROM d)
SELECT vec_id, round((y0 * p + y1 * q) / len * sign(CASE WHEN abs(y0) > abs(y1) THEN y0 ELSE y1 END), 5) AS indicator FROM s, n""",
}
