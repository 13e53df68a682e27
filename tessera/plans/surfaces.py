"""Queries on free energies with their spread, maps between surfaces, interpolation, features and slow modes of angles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bias as b
from tessera.functions import frames as fr
from tessera.functions import transforms as t
from tessera.functions.metric import Axis, Metric
from tessera.operators import histogram as h
from tessera.operators import moments as mo
from tessera.operators import series as s
from tessera.plans.common import KT, ORDER, SQL_BINNED, events, r6, vectors


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.assign(events(spark, sf_dir), ["value"], 30)


def fes_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = h.surface(_binned(spark, sf_dir), weight=F.col("user_id") % 5 + 1.0, log_rho=F.col("value") / 500, observable=F.col("value"), most=20.0)
    return found.select("bin", "n", *[r6(c).alias(c) for c in ("n_eff", "density", "f", "sigma", "observable")])


def masked_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = _binned(spark, sf_dir)
    found = h.masked_histogram(binned, h.renumber(binned, 20), F.col("user_id") % 3 + 1.0, F.col("value"))
    return found.select("number", "n", r6("mass").alias("mass"), r6("observable").alias("observable"))


def drawn_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.bin_weights(_binned(spark, sf_dir)).select("event_id", "bin", "n_bin", F.round("p_select", 8).alias("p_select"))


def fes_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface over 29 bins of value, carried to bins of its logarithm."""
    rows = _binned(spark, sf_dir).withColumnRenamed("bin", "old_bin")
    old = h.free_energy(_binned(spark, sf_dir))
    new = rows.withColumn("bin", F.floor(F.ln(F.col("value") + 1) * 4).cast("int"))
    return h.mapped_surface(new, old).select("bin", r6("f").alias("f"))


def bias_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(40).crossJoin(spark.range(5).withColumnRenamed("id", "j")).select(F.col("id").alias("i"), (-0.05 * (F.col("id") - 20) * (F.col("id") - 20) - 0.5 * F.col("j")).alias("e"))  # a grid of 200 places
    return h.bounds_of_bias(grid, "i", "e", cut=0.05)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"w": F.lit(1.0), "same": F.lit(2.0), "u": F.col("user_id").cast("double")})
    found = h.box_of(rows, ["value", "u"], "w", 5.0, 21).crossJoin(rows.agg((F.max("same") - F.min("same") <= 1e-12).alias("constant_same")))  # one row each
    return found.select(*[r6(f"{p}_{c}").alias(f"{p}_{c}") for c in ("value", "u") for p in ("lo", "hi")], *[F.col(f"constant_{c}").cast("int").alias(f"constant_{c}") for c in ("value", "u", "same")])


def inside_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = spark.range(1).select(F.lit(50.0).alias("lo_value"), F.lit(200.0).alias("hi_value"))
    return h.inside(events(spark, sf_dir), ["value"], box).select("event_id", F.col("inside").cast("int").alias("inside"))


def nearest_by_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group, drawn so cold that it is the nearest to a point."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    return h.draw_near(rows, h.close_to([F.col("value")], [100.0], [1.0]), 1e-9, "event_id", ["event_type"]).select("event_type", r6(F.abs(F.col("value") - 100)).alias("off"))


def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(20).select(F.col("id").cast("int").alias("i0")).crossJoin(spark.range(15).select(F.col("id").cast("int").alias("i1"))).withColumn("value", F.pow(F.col("i0") * 25 + 12.5, 2) + 3 * (F.col("i1") * 10 + 5.0))  # 300 grid places
    points = events(spark, sf_dir).select("event_id", F.col("value").alias("x0"), F.col("user_id").cast("double").alias("x1"))
    axes = [(0.0, 25.0, 20), (0.0, 10.0, 15)]
    near = b.grid_lookup_nd(points, grid, axes, order=0).select("event_id", F.col("value").alias("near"))
    return b.grid_lookup_nd(points, grid, axes).join(near, "event_id").select("event_id", F.round("value", 4).alias("linear"), F.round("near", 4).alias("near"))


def harmonic_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients that agree with the capped energy."""
    axes = Metric((Axis(0.0, 500.0), Axis(0.0, 60.0)))
    x = [F.col("value"), (F.col("user_id") % 60).cast("double")]
    found = b.harmonic_gradient(axes, x, [100.0, 30.0], [0.01, 0.02], 1.2)
    return events(spark, sf_dir).select("event_id", *[r6(g).alias(f"g{k}") for k, g in enumerate(found)])


def spread_of_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", r6(b.spread_bias(F.col("value") / 100, F.lit(0.5), KT)).alias("s"), r6(b.of_function(lambda v: F.greatest(F.lit(0.0), v - 100) / 7, [F.col("value")])).alias("f"))


def gradient_by_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain rule through a transform: derivatives of two features by three inputs."""
    f = t.of_function(lambda x: F.array(F.get(x, F.lit(0)) * F.get(x, F.lit(1)), F.get(x, F.lit(2)) * F.get(x, F.lit(2)) + F.get(x, F.lit(0))))
    rows = events(spark, sf_dir).select("event_id", F.array(F.col("value") / 100, (F.col("user_id") % 7).cast("double"), (F.col("event_id") % 5).cast("double")).alias("x"))
    g = b.chained_gradient([F.lit(2.0), F.lit(-1.0)], f.jacobian(3)(F.col("x")))
    return rows.select("event_id", *[F.round(F.get(g, F.lit(k)), 4).alias(f"g{k}") for k in range(3)])


def transform_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.shift(1.0, -2.0) * t.scale(3.0, 0.5)
    x = F.array(F.col("value"), F.col("user_id").cast("double"))
    return events(spark, sf_dir).select("event_id", *[r6(F.get(f.inverse()(f(x)), F.lit(k))).alias(f"x{k}") for k in range(2)], r6(F.get(f(x), F.lit(0))).alias("y0"))


def more_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array((F.col("value") - 100) / 20, (50 - F.col("value")) / 7)
    one = lambda name, k: r6(F.get(t.activation(name)(x), F.lit(k)))
    return events(spark, sf_dir).select("event_id", one("hard_sigmoid", 0).alias("hard_sigmoid"), one("hard_swish", 1).alias("hard_swish"), one("sort", 0).alias("least"), r6(F.get(t.clip(-1.0, 1.0)(x), F.lit(0))).alias("clipped"))


def angle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.col("value") / 50 - 3, F.col("user_id") / 50 - 1.5)
    pair = t.periodic_pair(2)(a)
    back, real = t.angle_of_pair(2)(pair), (t.real_parts(2) * t.scatter(1, 0))(pair)
    return events(spark, sf_dir).select("event_id", *[r6(F.get(back, F.lit(k))).alias(f"a{k}") for k in range(2)], *[r6(F.get(real, F.lit(k))).alias(f"r{k}") for k in range(2)])


def pair_distance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array(*[F.slice("x", 3 * i + 1, 3) for i in range(4)])
    v = vectors(spark, sf_dir)
    plain, other = t.pair_distances(p, 4), t.pair_distances(p, 4, 2.0, inverse=True, log=True)
    return v.select("vec_id", *[r6(F.get(plain, F.lit(k))).alias(f"d{k}") for k in range(6)], r6(F.get(other, F.lit(5))).alias("log_inverse"))


def body_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array(*[F.slice("x", 3 * i + 1, 3) for i in range(3)])
    r = [F.get(t.pair_distances(p, 3), F.lit(k)) for k in range(3)]
    body, periodic = t.body_features(r[:1], [r[1]], [r[2]], 1.0, 4.0)
    ratios, like = t.ratio_powers(r[:1], 1.5, 2, 1), t.invariant_polynomials([r], 2)
    out = F.concat(body, ratios, like)
    return vectors(spark, sf_dir).select("vec_id", *[r6(F.get(out, F.lit(k))).alias(f"f{k}") for k in range(len(periodic) + 5)])


def singular_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array column on its singular directions keeps its length."""
    rows = vectors(spark, sf_dir)
    v = mo.truncated_svd(rows, "x")
    y = t.matmul(v.tolist())(F.col("x"))
    return rows.select("vec_id", F.round(F.aggregate(y, F.lit(0.0), lambda acc, u: acc + u * u), 5).alias("square"))


def lag_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of lagged pairs of arrays in one pass."""
    rows = events(spark, sf_dir).withColumn("x", F.array(F.col("value") / 100, F.sqrt("value")))
    c = mo.Covariances.of(s.lag_pairs(rows, "user_id", ORDER, ["x"], 2), "x", "x_t")
    return spark.createDataFrame([(i, j, float(c.c00[i, j]), float(c.c01[i, j]), float(c.c11[i, j])) for i in range(2) for j in range(2)], "i int, j int, c00 double, c01 double, c11 double").select("i", "j", *[F.round(k, 5).alias(k) for k in ("c00", "c01", "c11")])


def correlation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical inefficiency by the envelope of the autocorrelation and by block means."""
    rows = events(spark, sf_dir)
    return fr.series_inefficiencies(rows, "user_id", ORDER, "value", {"by_envelope": fr.envelope_inefficiency, "by_blocks": fr.block_inefficiency})


def transport_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of each frame of eight points, in two kinds, to two references."""
    import numpy as np

    kinds = np.arange(8) % 2
    references = [(np.stack([np.cos(np.arange(8) + k), np.sin(np.arange(8) * (k + 1)), np.zeros(8)], axis=1) / 5, kinds) for k in range(2)]
    atoms = F.array(*[F.slice("x", 3 * i + 1, 3) for i in range(8)])
    rows = vectors(spark, sf_dir).select("vec_id", atoms.alias("atoms"))
    return fr.per_frame(rows, ["atoms"], lambda p: fr.transport(p, kinds, references), "costs", "array<double>").select("vec_id", "costs")


QUERIES = {f.__name__: f for f in (fes_spread, masked_bins, drawn_alike, fes_mapped, bias_bounds, boxes, inside_box, nearest_by_energy, grid_bilinear, harmonic_forces, spread_of_bias, gradient_by_inputs, transform_undone, more_activations, angle_features, pair_distance_features, body_polynomials, singular_share, lag_moments, correlation_times, transport_costs)}

_R = [f"sqrt({'+'.join(f'pow(x[{3 * j + k}]-x[{3 * i + k}],2)' for k in (1, 2, 3))})" for i in range(4) for j in range(i + 1, 4)]
_V = "v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) x FROM embeddings)"
_T = ["sqrt(" + "+".join(f"pow(x[{3 * j + k}]-x[{3 * i + k}],2)" for k in (1, 2, 3)) + ")" for i in range(3) for j in range(i + 1, 3)]
_BODY = [f"pow(r0,{n})/(1+exp(4.0*(r0-1.0)))" for n in range(3)] + [f"pow(r1,{n})" for n in (1, 2)] + [f"r2*{n}" for n in (1, 2)] + ["r0/1.5", "pow(r0/1.5,2)", "1.5/r0", "r0+r1+r2", "r0*r0+r1*r1+r2*r2"]


def _middle(c: str, x: str) -> str:
    """Bounds of the bins that hold the middle 90 % of the rows."""
    return f"""{c}b AS (SELECT min({x}) lo, max({x}) hi FROM events), {c}m AS (SELECT CAST(floor(({x}-lo)/((hi-lo)/20)) AS INT) bin FROM events CROSS JOIN {c}b WHERE {x}>lo AND {x}<hi), {c}h AS (SELECT bin, count(*) w FROM {c}m GROUP BY bin),
{c}r AS (SELECT bin, w, sum(w) OVER (ORDER BY bin) run, sum(w) OVER () al FROM {c}h), {c}k AS (SELECT min(bin) f, max(bin) l FROM {c}r WHERE run/al>0.05 AND (run-w)/al<0.95), {c}o AS (SELECT round(lo+f*(hi-lo)/20,6) lo, round(lo+(l+1)*(hi-lo)/20,6) hi, hi-lo<=1e-12 same FROM {c}k CROSS JOIN {c}b)"""


SQL = {
    "fes_spread": f"""WITH {SQL_BINNED}, w AS (SELECT bin, (user_id%5+1)*exp(value/500) w, value FROM m), g AS (SELECT bin, count(*) n, sum(w) s, sum(w)*sum(w)/sum(w*w) e, sum(w*value)/sum(w) o FROM w GROUP BY bin)
SELECT bin, n, round(e,6) AS n_eff, round(s/sum(s) OVER (),6) AS density, round(least(-{KT!r}*ln(s/max(s) OVER ()),20),6) AS f, round({KT!r}/sqrt(e),6) AS sigma, round(o,6) AS observable FROM g""",
    "masked_bins": f"WITH {SQL_BINNED}, g AS (SELECT bin, count(*) n, sum(user_id%3+1) w, sum((user_id%3+1)*value)/sum(user_id%3+1) o FROM m GROUP BY bin HAVING count(*)>=20) SELECT CAST(row_number() OVER (ORDER BY bin)-1 AS INT) AS number, n, round(w,6) AS mass, round(o,6) AS observable FROM g",
    "drawn_alike": f"WITH {SQL_BINNED} SELECT event_id, bin, count(*) OVER (PARTITION BY bin) AS n_bin, round(1.0/count(*) OVER (PARTITION BY bin),8) AS p_select FROM m",
    "fes_mapped": f"""WITH {SQL_BINNED}, o AS (SELECT bin, count(*) n FROM m GROUP BY bin), q AS (SELECT bin ob, CAST(floor(ln(value+1)*4) AS INT) nb, count(*) c FROM m GROUP BY 1,2), z AS (SELECT nb, sum(c*1.0/n*(n*1.0/(SELECT max(n) FROM o))) mass FROM q JOIN o ON ob=bin GROUP BY nb)
SELECT nb AS bin, round(-{KT!r}*ln(mass/max(mass) OVER ()),6) AS f FROM z""",
    "bias_bounds": f"""WITH g AS (SELECT i, sum(exp((-0.05*(i-20)*(i-20)-0.5*j)/{KT!r})) m FROM range(40) a(i) CROSS JOIN range(5) b(j) GROUP BY i), r AS (SELECT i, m, sum(m) OVER (ORDER BY i) run, sum(m) OVER () al FROM g) SELECT min(i) AS lo, max(i) AS hi FROM r WHERE run/al>0.05 AND (run-m)/al<0.95""",
    "boxes": f"WITH {_middle('a', 'value')}, {_middle('u', 'user_id')} SELECT ao.lo AS lo_value, ao.hi AS hi_value, uo.lo AS lo_u, uo.hi AS hi_u, CAST(ao.same AS INT) AS constant_value, CAST(uo.same AS INT) AS constant_u, 1 AS constant_same FROM ao CROSS JOIN uo",
    "inside_box": "SELECT event_id, CAST(value>50 AND value<200 AS INT) AS inside FROM events",
    "nearest_by_energy": "SELECT event_type, round(min(abs(value-100)),6) AS off FROM events GROUP BY 1",
    "grid_bilinear": """WITH u AS (SELECT event_id, value/25-0.5 u, user_id/10.0-0.5 v FROM events), c AS (SELECT *, greatest(0,least(floor(u),18)) i, greatest(0,least(floor(v),13)) j FROM u)
SELECT event_id, round(CASE WHEN u>=0 AND u<=19 AND v>=0 AND v<=14 THEN pow(i*25+12.5,2)*(1-(u-i))+pow(i*25+37.5,2)*(u-i)+3*((v+0.5)*10) END,4) AS linear,
round(CASE WHEN u>=-0.5 AND u<=19.5 AND v>=-0.5 AND v<=14.5 THEN pow(least(floor(u+0.5),19)*25+12.5,2)+3*(least(floor(v+0.5),14)*10+5) END,4) AS near FROM c""",
    "harmonic_forces": "WITH d AS (SELECT event_id, value-100 x, (user_id%60)-30 y FROM events), r AS (SELECT *, sqrt(x*x*0.01/0.015+y*y*0.02/0.015) r FROM d) SELECT event_id, round(x*0.01*CASE WHEN r<80 THEN 1 ELSE 80/r END,6) AS g0, round(y*0.02*CASE WHEN r<80 THEN 1 ELSE 80/r END,6) AS g1 FROM r",
    "spread_of_bias": f"SELECT event_id, round(-exp(0.5-value/100/{KT!r}),6) AS s, round(greatest(0,value-100)/7,6) AS f FROM events",
    "gradient_by_inputs": "SELECT event_id, round(2.0*(user_id%7)-1,4) AS g0, round(2*value/100,4) AS g1, round(-2.0*(event_id%5),4) AS g2 FROM events",
    "transform_undone": "SELECT event_id, round(value,6) AS x0, round(CAST(user_id AS DOUBLE),6) AS x1, round((value+1)*3,6) AS y0 FROM events",
    "more_activations": "WITH x AS (SELECT event_id, (value-100)/20 a, (50-value)/7 b FROM events) SELECT event_id, round(least(greatest(a+3,0),6)/6,6) AS hard_sigmoid, round(b*least(greatest(b+3,0),6)/6,6) AS hard_swish, round(least(a,b),6) AS least, round(greatest(-1,least(1,a)),6) AS clipped FROM x",
    "angle_features": "WITH a AS (SELECT event_id, value/50-3 a, user_id/50.0-1.5 b FROM events) SELECT event_id, round(atan2(sin(a),cos(a)),6) AS a0, round(atan2(sin(b),cos(b)),6) AS a1, round(cos(b),6) AS r0, round(cos(a),6) AS r1 FROM a",
    "pair_distance_features": f"WITH {_V} SELECT vec_id, " + ", ".join(f"round({r},6) AS d{k}" for k, r in enumerate(_R)) + f", round(ln(1/({_R[5]}/2.0+1e-8)+1e-8),6) AS log_inverse FROM v",
    "body_polynomials": f"WITH {_V}, r AS (SELECT vec_id, {_T[0]} r0, {_T[1]} r1, {_T[2]} r2 FROM v) SELECT vec_id, " + ", ".join(f"round({e},6) AS f{k}" for k, e in enumerate(_BODY)) + " FROM r",
    "singular_share": f"WITH {_V} SELECT vec_id, round(list_dot_product(x,x),5) AS square FROM v",
    "lag_moments": "WITH l AS (SELECT value/100 a0, sqrt(value) a1, lead(value,2) OVER w/100 b0, sqrt(lead(value,2) OVER w) b1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT * FROM l WHERE b0 IS NOT NULL) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_pop(a{i},a{j}),5) AS c00, round(covar_pop(a{i},b{j}),5) AS c01, round(covar_pop(b{i},b{j}),5) AS c11 FROM k" for i in range(2) for j in range(2)),
}
