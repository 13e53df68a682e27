"""Queries on moments, reweighting, sampling, biases, neighbours, slow modes and the store."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bias as b
from tessera.functions.metric import Axis, Metric
from tessera.operators import histogram as h
from tessera.operators import koopman as k
from tessera.operators import moments as mo
from tessera.operators import neighbours as nb
from tessera.operators import reweight as rw
from tessera.operators import sample as sa
from tessera.operators import series as s
from tessera.plans.common import ORDER, SQL_BINNED, events, r6, table, vectors


def weighted_mean_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", (1 - F.col("l_discount")).alias("w"))
    scaled = rows.select(F.col("l_quantity").alias("x0"), (F.col("l_extendedprice") / 1000).alias("x1"), (F.col("l_tax") * 10).alias("x2"), "w")
    return mo.covariance(scaled, ["x0", "x1", "x2"], "w").select("i", "j", F.round("c", 5).alias("c"))


def lagged_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("x", F.array("value"))
    c = mo.Covariances.of(s.lag_pairs(rows, "user_id", ORDER, ["x"], 3), "x", "x_t")
    c00, c01, c11 = (float(m[0, 0]) for m in (c.c00, c.c01, c.c11))
    return spark.createDataFrame([(c01, c00, c01 / math.sqrt(c00 * c11))], "c01 double, c00 double, r double").select(F.round("c01", 5).alias("c01"), F.round("c00", 5).alias("c00"), r6("r").alias("r"))


def kish_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.effective_size(events(spark, sf_dir).withColumn("w", F.col("value") + 1), "w", ["user_id"]).select("user_id", r6("n_eff").alias("n_eff"))


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.class_moments(vectors(spark, sf_dir), "label", "x").select("label", "i", r6("m").alias("m"), "n")


def feature_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dimensions that vary most."""
    return mo.most_varying(vectors(spark, sf_dir), "x", 5).select("i", r6("sd").alias("sd"))


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, second = mo.array_moments(vectors(spark, sf_dir), "x")
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(second)], "i int, j int, g double").select("i", "j", r6("g").alias("g"))


def lda_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    within, between, _ = mo.class_scatter(vectors(spark, sf_dir), "label", "x")
    rows = mo.discriminants(within, between, 2)
    ratio = np.einsum("ki,ij,kj->k", rows, between, rows) / np.einsum("ki,ij,kj->k", rows, within, rows)
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratio)], "mode int, ratio double")


def window_bin_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.window_counts(h.assign(events(spark, sf_dir), ["value"], 30), "event_type", F.col("value") / 100).select(F.col("i").alias("event_type"), F.col("k").alias("bin"), "n", r6("u").alias("u"))


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray, np.ndarray, list[int]]:
    """Counts by parity of the user and bin, with a made-up harmonic bias for each window."""
    binned = h.assign(events(spark, sf_dir), ["value"], 30).withColumn("win", (F.col("user_id") % 3).cast("int"))
    table_ = rw.window_counts(binned, "win").toPandas()
    bins = sorted(table_["k"].unique().tolist())
    n = np.zeros((3, len(bins)))
    n[table_["i"], [bins.index(x) for x in table_["k"]]] = table_["n"]
    u = np.array([[0.5 * 0.02 * (x - 6.0 * i) ** 2 for x in bins] for i in range(3)])
    return binned, n, u, bins


def wham_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps of the fixed point."""
    _, n, u, bins = _windows(spark, sf_dir)
    p, _ = rw.wham(n, u, steps=5)
    return spark.createDataFrame([(int(x), float(v)) for x, v in zip(bins, p, strict=True)], "bin int, p double").select("bin", F.round("p", 8).alias("p"))


def wham_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converged weights, shared by the rows of each bin."""
    binned, n, u, bins = _windows(spark, sf_dir)
    p, _ = rw.wham(n, u)
    solved = spark.createDataFrame([(int(x), float(v)) for x, v in zip(bins, p, strict=True)], "bin int, p double")
    return rw.row_weights(binned, solved).select("event_id", "bin", "w")


def dham_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned, _, u, bins = _windows(spark, sf_dir)
    counts = s.transitions(binned, "user_id", ORDER, 1, "win").toPandas()
    c = np.zeros((3, len(bins), len(bins)))
    for r in counts.itertuples():
        c[r.win, bins.index(r.src), bins.index(r.dst)] += r.c
    _, w = rw.dham(c, u)
    return spark.createDataFrame([(int(x), float(v)) for x, v in zip(bins, w, strict=True)], "bin int, w double")


def rho_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", r6(rw.rescale(F.lit(1.0), F.col("value") / 100, 1.5)).alias("w"))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("value") + 1).cast("double").alias("w"))
    return sa.systematic(rows, "event_id", "w", 200)


_AXES = Metric((Axis(0.0, 500.0, periodic=True), Axis(0.0, 60.0)))


def harmonic_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = [F.col("value"), F.col("user_id") % 60], [Decimal("0.01"), Decimal("0.02")]
    energy = F.round(b.harmonic(_AXES, x, [400, 30], k, 1.2) * 1e6) / 1e6  # as SQL rounds: many energies end on half a unit
    return events(spark, sf_dir).select("event_id", energy.alias("e"), *[r6(g).alias(f"g{i}") for i, g in enumerate(b.harmonic_gradient(_AXES, x, [400, 30], k))])


def hills_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hill at the mean of each bin, over all rows."""
    rows = events(spark, sf_dir)
    centres = h.assign(rows, ["value"], 30).groupBy("bin").agg(F.avg("value").alias("c0")).withColumn("height", F.lit(1.5))
    points = rows.select("event_id", F.col("value").alias("x0"))
    return b.hills(points, centres, Metric((Axis(0.0, 500.0, periodic=True),)), 1, [40.0]).select("event_id", F.round("bias", 5).alias("bias"))


def bias_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = F.col("value") / 10, F.lit(25.0)
    return events(spark, sf_dir).select("event_id", r6(b.total([one, None, two])).alias("both"), r6(b.least([one, two])).alias("least"), r6(b.tempered(one, 300.0, 600.0)).alias("tempered"), r6(b.round_bias(F.lit(0.9), one, two)).alias("in_round"))


def grid_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(20).select(F.col("id").cast("int").alias("i"), ((F.col("id") * 25 + 12.5) * (F.col("id") * 25 + 12.5)).alias("value"))
    points = events(spark, sf_dir).select("event_id", F.col("value").alias("x"))
    return b.grid_lookup(points, grid, 0.0, 25.0, 20).select("event_id", F.round("value", 4).alias("v"))


def rbf_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = spark.range(5).select((F.col("id") * 100.0 + 50).alias("c0"), (F.col("id") - 2.0).alias("coefficient"))
    points = events(spark, sf_dir).select("event_id", F.col("value").alias("x0"))
    return b.rbf_evaluate(points, centres, Metric((Axis(0.0, 500.0),)), 1, "gaussian", 4.0, 0.5).select("event_id", r6("value").alias("v"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the part table: size and price in hundreds, in frames of 400 keys."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.floor(F.col("p_partkey") / 400).alias("frame"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))


def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.per_point(nb.edges(_parts(spark, sf_dir), "p_partkey", ["x", "y"], 2.0, "frame"), F.exp(-F.col("r"))).select("i", "n", r6("value").alias("value"))


def neighbour_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _parts(spark, sf_dir)
    e = nb.edges(points, "p_partkey", ["x", "y"], 2.0, "frame").hint("merge").join(points.select(F.col("p_partkey").alias("j"), "p_brand"), "j")
    return e.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 4).alias("r"))


def neighbour_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _parts(spark, sf_dir).select("p_partkey", "frame", (F.col("x") % 50).alias("x"), (F.col("y") % 60).alias("y"))
    return nb.per_point(nb.edges(points, "p_partkey", ["x", "y"], 3.0, "frame", [50.0, 60.0]), F.col("r")).select("i", "n", r6("value").alias("value"))


def neighbour_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nb.edges(_parts(spark, sf_dir), "p_partkey", ["x", "y"], 1.5, "frame")
    return nb.triples(e).groupBy("centre").agg(F.count(F.lit(1)).alias("n"))


def neighbour_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nb.edges(_parts(spark, sf_dir), "p_partkey", ["x", "y"], 3.0, "frame")
    return nb.nearest(e, 2).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 4).alias("r"))


def koopman_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values and timescales of event values and their running means at lag 1."""
    rows = s.running(events(spark, sf_dir), "user_id", ORDER, "value").withColumn("x", F.array(F.col("value") / 100, F.col("run_sum") / 1000))
    pairs = s.lag_pairs(rows, "user_id", ORDER, ["x"], 1)
    model = k.Koopman.fit(mo.Covariances.of(pairs, "x", "x_t"), 2)
    return spark.createDataFrame([(i, float(v), float(t) if math.isfinite(t) else None) for i, (v, t) in enumerate(zip(model.values, model.timescales(), strict=True))], "mode int, s double, tau double")


def stationary_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = h.assign(events(spark, sf_dir), ["value"], 6)
    t = k.transition_matrix(s.transitions(binned, "user_id", ORDER, 1), 5)
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(k.stationary(t))], "bin int, p double")


def round_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trajectories, customers' segments as rounds: share finished among valid ones."""
    from tessera.sources.store import fraction_finished

    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 12).cast("int").alias("round"), F.col("o_orderkey").alias("traj"), (F.col("o_orderstatus") == "F").alias("finished"), (F.col("o_totalprice") < 20000).alias("invalid"))
    return fraction_finished(o, ["round"]).select("round", r6("fraction").alias("fraction"))


def parse_timescales(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.store import numbers_after

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.size(numbers_after(F.col("text"), "version")).alias("n")).where("n > 0")


def trajectory_inefficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.frames import series_inefficiency

    return series_inefficiency(events(spark, sf_dir), "user_id", ORDER, "value").select("user_id", F.round("g", 5).alias("g"))


def loaded_fes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over events: trimmed, weighed over three made-up windows, summed to a free energy."""
    from tessera.plans.loader import free_energy, load

    rows = events(spark, sf_dir).withColumn("win", (F.col("user_id") % 3).cast("int"))
    return free_energy(load(rows, "user_id", ORDER, "value", "win", lambda w, x: 1e-5 * (x - 100.0 * w) ** 2, skip=5, lag=1, key="event_id"))


def lattice_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.frames import minkowski_reduce, per_frame

    cell = F.array(*[F.slice("x", 3 * i + 1, 3) for i in range(3)])
    return per_frame(vectors(spark, sf_dir).select("vec_id", cell.alias("cell")), ["cell"], lambda c: minkowski_reduce(c)[0], "reduced").select("vec_id", "reduced")


def descriptor_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.frames import bessel_spectra, per_block

    atoms = F.array(*[F.slice("x", 3 * i + 1, 3) for i in range(8)])
    return per_block(vectors(spark, sf_dir).select("vec_id", atoms.alias("atoms")), "atoms", bessel_spectra, "spectrum", 3).select("vec_id", "spectrum")


def fitted_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scaling, then the directions that set labels apart."""
    from tessera.operators.fit import MIN_MAX, discriminant

    rows = vectors(spark, sf_dir)
    f = (MIN_MAX * discriminant("label", 2)).fit(rows, "x", None)
    return rows.select("vec_id", f(F.col("x")).alias("y"))


QUERIES = {f.__name__: f for f in (weighted_mean_cov, lagged_cov, kish_size, class_means, feature_top, gram_matrix, lda_directions, window_bin_matrix, wham_steps, wham_weights, dham_weights, rho_rescale, systematic_sample, harmonic_capped, hills_sum, bias_composite, grid_interpolate, rbf_field, neighbour_counts, neighbour_by_class, neighbour_periodic, neighbour_triples, neighbour_nearest, koopman_modes, stationary_weights, trajectory_inefficiency, loaded_fes, lattice_reduced, descriptor_spectrum, fitted_pipeline, round_validity, parse_timescales)}

_L = "l AS (SELECT l_quantity x0, l_extendedprice/1000 x1, l_tax*10 x2, 1-l_discount w FROM lineitem)"
_PT = "p AS (SELECT p_partkey k, p_brand, p_partkey//400 f, CAST(p_size AS DOUBLE) x, p_retailprice/10 y FROM part)"


def _edge(r: float, source: str = "p") -> str:
    return f"e AS (SELECT a.k i, b.k j, b.p_brand, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) r FROM {source} a JOIN {source} b ON a.f=b.f AND a.k<>b.k WHERE sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) < {r})"


def _wham(steps: int) -> str:
    out = f"""WITH {SQL_BINNED}, c AS (SELECT CAST(user_id%3 AS INT) i, bin k, count(*) n FROM m GROUP BY 1,2), ni AS (SELECT i, sum(n) n FROM c GROUP BY i), hk AS (SELECT k, sum(n) h FROM c GROUP BY k),
u AS (SELECT i, k, 0.5*0.02*(k-6.0*i)*(k-6.0*i) u FROM ni CROSS JOIN hk), p0 AS (SELECT k, h/sum(h) OVER () p FROM hk)"""
    for t in range(1, steps + 1):
        out += f""", f{t} AS (SELECT i, -ln(sum(p*exp(-u))) f FROM u JOIN p{t - 1} USING (k) GROUP BY i), d{t} AS (SELECT k, sum(n*exp(f-u)) d FROM u JOIN f{t} USING (i) JOIN ni USING (i) GROUP BY k),
p{t} AS (SELECT k, (h/d)/sum(h/d) OVER () p FROM hk JOIN d{t} USING (k))"""
    return out + f" SELECT k AS bin, round(p,8) AS p FROM p{steps}"


_H = "(SELECT event_id, value-400 d, (user_id%60)-30 y, (value-400)/500-floor((value-400)/500) u FROM events)"

SQL = {
    "weighted_mean_cov": f"WITH {_L}, s AS (SELECT sum(w) w, " + ", ".join(f"sum(w*x{i})/sum(w) m{i}" for i in range(3)) + ", " + ", ".join(f"sum(w*x{i}*x{j})/sum(w) s{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM l) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(s{i}{j}-m{i}*m{j},5) AS c FROM s" for i in range(3) for j in range(i, 3)),
    "lagged_cov": "WITH l AS (SELECT value a, lead(value,3) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) SELECT round(covar_pop(a,b),5) AS c01, round(var_pop(a),5) AS c00, round(corr(a,b),6) AS r FROM l WHERE b IS NOT NULL",
    "kish_size": "SELECT user_id, round(sum(value+1)*sum(value+1)/sum((value+1)*(value+1)),6) AS n_eff FROM events GROUP BY user_id",
    "class_means": "SELECT label, CAST(i-1 AS INT) AS i, round(avg(CAST(embedding[i] AS DOUBLE)),6) AS m, count(*) AS n FROM embeddings CROSS JOIN range(1,65) r(i) GROUP BY 1,2",
    "feature_top": "SELECT CAST(i-1 AS INT) AS i, round(stddev_pop(CAST(embedding[i] AS DOUBLE)),6) AS sd FROM embeddings CROSS JOIN range(1,65) r(i) GROUP BY 1 ORDER BY stddev_pop(CAST(embedding[i] AS DOUBLE)) DESC, 1 LIMIT 5",
    "gram_matrix": "SELECT CAST(i-1 AS INT) AS i, CAST(j-1 AS INT) AS j, round(avg(CAST(embedding[i] AS DOUBLE)*CAST(embedding[j] AS DOUBLE)),6) AS g FROM embeddings CROSS JOIN range(1,65) r(i) CROSS JOIN range(1,65) s(j) GROUP BY 1,2",
    "window_bin_matrix": f"WITH {SQL_BINNED} SELECT event_type, bin, count(*) AS n, round(avg(value/100),6) AS u FROM m GROUP BY 1,2",
    "wham_steps": _wham(5),
    "rho_rescale": "SELECT event_id, round(exp(value/100*((1-1/1.5)/(0.0083144626*300))),6) AS w FROM events",
    "systematic_sample": """WITH w AS (SELECT event_id, floor(value+1) w FROM events), c AS (SELECT event_id, w, sum(w) OVER (ORDER BY event_id) hi, sum(w) OVER () s FROM w)
SELECT CAST(m AS INT) AS m, event_id FROM range(1,201) r(m) JOIN c ON (m-0.5)/200 >= (hi-w)/s AND (m-0.5)/200 < hi/s""",
    "harmonic_capped": f"""WITH q AS (SELECT event_id, 500*CASE WHEN u>0.5 THEN u-1 ELSE u END d, y FROM {_H} x), r AS (SELECT *, sqrt(d*d*0.01/0.015+y*y*0.02/0.015) r FROM q)
SELECT event_id, round(CASE WHEN r<80 THEN 0.5*0.015*r*r ELSE 0.5*0.015*6400+1.2*(r-80) END,6) AS e, round(d*0.01,6) AS g0, round(y*0.02,6) AS g1 FROM r""",
    "hills_sum": f"""WITH {SQL_BINNED}, c AS (SELECT bin, avg(value) c FROM m GROUP BY bin), d AS (SELECT event_id, (value-c)/500-floor((value-c)/500) u FROM events CROSS JOIN c)
SELECT event_id, round(sum(1.5*exp(-pow(500*CASE WHEN u>0.5 THEN u-1 ELSE u END,2)/3200)),5) AS bias FROM d GROUP BY event_id""",
    "bias_composite": "SELECT event_id, round(value/10+25,6) AS both, round(least(value/10,25.0),6) AS least, round(value/10*(300.0/900.0),6) AS tempered, round(0.9*(value/10)+25,6) AS in_round FROM events",
    "grid_interpolate": """WITH u AS (SELECT event_id, value/25-0.5 u, least(floor(value/25-0.5),18) i FROM events)
SELECT event_id, round(CASE WHEN u>=0 AND u<=19 THEN pow(i*25+12.5,2)*(1-(u-i))+pow(i*25+37.5,2)*(u-i) END,4) AS v FROM u""",
    "rbf_field": "SELECT event_id, round(0.5+sum((c-2)*exp(-pow(abs(value-(c*100+50))/500*4,2))),6) AS v FROM events CROSS JOIN range(5) r(c) GROUP BY event_id",
    "neighbour_counts": f"WITH {_PT}, {_edge(2.0)} SELECT i, count(*) AS n, round(sum(exp(-r)),6) AS value FROM e GROUP BY i",
    "neighbour_by_class": f"WITH {_PT}, {_edge(2.0)} SELECT p_brand, count(*) AS n, round(sum(r),4) AS r FROM e GROUP BY p_brand",
    "neighbour_periodic": """WITH p AS (SELECT p_partkey k, p_partkey//400 f, CAST(p_size%50 AS DOUBLE) x, p_retailprice/10-60*floor(p_retailprice/600) y FROM part),
d AS (SELECT a.k i, b.x-a.x-50*round((b.x-a.x)/50) dx, b.y-a.y-60*round((b.y-a.y)/60) dy FROM p a JOIN p b ON a.f=b.f AND a.k<>b.k)
SELECT i, count(*) AS n, round(sum(sqrt(dx*dx+dy*dy)),6) AS value FROM d WHERE sqrt(dx*dx+dy*dy)<3 GROUP BY i""",
    "neighbour_triples": f"WITH {_PT}, {_edge(1.5)} SELECT a.i AS centre, count(*) AS n FROM e a JOIN e b ON a.i=b.i AND a.j<b.j GROUP BY 1",
    "neighbour_nearest": f"WITH {_PT}, {_edge(3.0)}, q AS (SELECT r, row_number() OVER (PARTITION BY i ORDER BY r, j) rank FROM e) SELECT rank, count(*) AS n, round(sum(r),4) AS r FROM q WHERE rank<=2 GROUP BY rank",
    "round_validity": "SELECT CAST(o_custkey%12 AS INT) AS round, round(coalesce(avg(CASE WHEN o_totalprice>=20000 THEN CAST(o_orderstatus='F' AS INT) END),0),6) AS fraction FROM orders GROUP BY 1",
    "parse_timescales": "SELECT doc_id, len(regexp_extract_all(text, 'version\\s+([0-9]+(\\.[0-9]+)?)')) AS n FROM documents WHERE len(regexp_extract_all(text, 'version\\s+([0-9]+(\\.[0-9]+)?)')) > 0",
    "trajectory_inefficiency": """WITH d AS (SELECT user_id, value-avg(value) OVER (PARTITION BY user_id) d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k, count(*) OVER (PARTITION BY user_id) n FROM events),
c AS (SELECT a.user_id, a.n, b.k-a.k lag, sum(a.d*b.d)/(a.n-(b.k-a.k)) c FROM d a JOIN d b ON a.user_id=b.user_id AND b.k>=a.k GROUP BY 1,2,3), r AS (SELECT user_id, n, lag, c/max(CASE WHEN lag=0 THEN c END) OVER (PARTITION BY user_id) r FROM c),
f AS (SELECT *, min(CASE WHEN r<=0 THEN lag END) OVER (PARTITION BY user_id) stop FROM r) SELECT user_id, round(greatest(1,1+2*coalesce(sum(CASE WHEN lag>0 AND lag<coalesce(stop,n) THEN r*(1-lag*1.0/n) END),0)),5) AS g FROM f GROUP BY user_id""",
}
