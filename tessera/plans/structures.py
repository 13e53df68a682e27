"""Queries on periodic frames: neighbours of any cell, spectra, kept operations, masses, and row structure.

Frames are made of embeddings: six points from the first 18 dimensions, of two
kinds in turn, in a skewed cell that depends on the id.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cells as c
from tessera.functions import geometry as g
from tessera.operators import environments as en
from tessera.operators import rows as ro
from tessera.plans.common import events, r6, vectors

POINTS, SIZE, CUT = 6, 4.0, 1.6


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    row = lambda *x: F.array(*[y if isinstance(y, Column) else F.lit(float(y)) for y in x])
    cell = F.array(row(2 + v % 3 * 0.25, 0, 0), row(0.5, 2, 0), row(0.3, -0.4, 1.5 + v % 2 * 0.5))
    points = F.array(*[F.transform(F.slice("x", 3 * i + 1, 3), lambda y: y * SIZE) for i in range(POINTS)])
    return vectors(spark, sf_dir).select("vec_id", "label", points.alias("positions"), cell.alias("cell"), "x")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.atoms(frames(spark, sf_dir), "vec_id", "positions", "cell", F.array(*[F.lit(i % 2) for i in range(POINTS)]))


def heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a mass of 1 + i, and with the next three dimensions as velocity."""
    more = frames(spark, sf_dir).select(F.col("vec_id").alias("frame"), F.posexplode(F.array(*[F.slice("x", 3 * i + 19, 3) for i in range(POINTS)])).alias("i", "v"))
    return points(spark, sf_dir).join(more, ["frame", "i"]).withColumn("mass", F.col("i") + 1.0)


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.edges(points(spark, sf_dir), CUT)


def neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.reduced(near(spark, sf_dir), F.exp(-F.col("r"))).select("frame", "i", "n", r6("value").alias("value"))


def neighbour_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.reduced(near(spark, sf_dir), F.exp(-F.col("r")), "z").select("frame", "i", "kind_j", "n", r6("value").alias("value"))


def neighbour_kinds_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.reduced(near(spark, sf_dir), F.col("r"), "split_z").select("frame", "kind_i", "kind_j", "n", r6("value").alias("value"))


def neighbour_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = [g.at(F.col("d"), k) for k in range(3)]
    return near(spark, sf_dir).groupBy("frame").agg(*[r6(F.sum(d[i] * d[j])).alias(f"d{i}{j}") for i in range(3) for j in range(i, 3)])


def neighbour_pair_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = en.pairs(near(spark, sf_dir))
    return en.pairs_reduced(pair, F.col("cosine") * F.exp(-F.col("r") - 2 * F.col("r_2")), "z").select("frame", "i", "kind_j", "kind_j_2", "n", r6("value").alias("value"))


def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.pairs_reduced(en.pairs(near(spark, sf_dir)), F.col("cosine")).select("frame", "i", "n", r6("value").alias("value"))


def neighbours_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = points(spark, sf_dir)
    new = old.withColumn("p", F.transform("p", lambda x: x * (1 + F.col("frame") % 4 * 0.05)))
    return en.needs_update(old, new, 0.2)


def neighbours_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges made with a skin, cut to a shorter range."""
    return en.reduced(en.within(near(spark, sf_dir), 1.2), F.col("r"), "frame").select("frame", "n", r6("value").alias("value"))


def kinds_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = en.one_hot(F.col("kind"), [0, 1, 2])
    return en.kinds(points(spark, sf_dir)).select("kind", "n", *[F.get(hot, F.lit(k)).alias(f"is{k}") for k in range(3)])


def _entries(spectrum: DataFrame, n: int) -> DataFrame:
    return spectrum.select("frame", "i", "kind_a", "kind_b", *[F.round(F.get("spectrum", F.lit(k)), 5).alias(f"s{k}") for k in range(n)])


def bessel_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(en.power_spectrum(near(spark, sf_dir), en.bessel_radial(CUT)), 9)


def bessel_order_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of order four of each point and pair of kinds."""
    found = en.power_spectrum(near(spark, sf_dir), en.bessel_radial(CUT), n_max=1, l_max=4)
    return found.select("frame", "i", "kind_a", "kind_b", F.round(F.get("spectrum", F.lit(4)), 5).alias("s4"))


def soap_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(en.power_spectrum(near(spark, sf_dir), en.soap_radial(CUT, 0.5)), 9)


def spectrum_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised spectra have length 1 at each point."""
    found = en.power_spectrum(near(spark, sf_dir), en.bessel_radial(CUT), normalise=True)
    return found.groupBy("frame", "i").agg(r6(F.sum(F.aggregate("spectrum", F.lit(0.0), lambda acc, v: acc + v * v))).alias("length"))


def pair_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = en.pair_polynomials(en.pairs(near(spark, sf_dir)), 1)
    return found.select("frame", "i", "kind_j", "kind_j_2", *[r6(F.get("value", F.lit(k))).alias(f"v{k}") for k in range(4)])


def kind_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = en.inverse_spread(points(spark, sf_dir), "p").withColumnRenamed("weight", "v").join(en.inverse_spread(points(spark, sf_dir), "p", variance=False), "kind")
    return both.select("kind", F.round("v", 5).alias("by_variance"), F.round("weight", 5).alias("by_deviation"))


_LAYERS = [{0: [[1.0, 0.5], [0.0, 1.0], [-1.0, 0.25]], 1: [[0.5, -0.5], [2.0, 0.0], [0.0, 1.0]]}, {0: [[1.0, 1.0], [0.5, -1.0]], 1: [[0.25, 0.0], [0.0, 0.5]]}]


def pooled_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = en.summed_by_kind(points(spark, sf_dir), "p", _LAYERS, lambda v: F.greatest(v, F.lit(0.0)))
    return found.select("frame", "kind", *[r6(F.get("pooled", F.lit(k))).alias(f"y{k}") for k in range(2)])


def wrap_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("shift", c.wrap_shift(g.to_relative(F.col("positions"), F.col("cell")), centred=True))
    back = c.apply_wrap(F.col("shift"), F.col("positions"), F.col("cell"))
    sums = lambda m, k: F.aggregate(m, F.lit(0.0), lambda acc, p: acc + g.at(p, k))
    return f.select("vec_id", *[r6(sums(F.col("shift"), k)).alias(f"shift{k}") for k in range(3)], *[F.round(sums(back, k), 5).alias(f"x{k}") for k in range(3)])


def cell_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of the next nine dimensions, in lower triangular form."""
    own = F.array(*[F.slice("x", 3 * i + 28, 3) for i in range(3)])
    f = frames(spark, sf_dir).select("vec_id", own.alias("cell"))
    new = c.apply_rotation(c.turned(F.col("cell")), F.col("cell"))
    return f.select("vec_id", *[r6(g.at(new, i, j)).alias(f"c{i}{j}") for i in range(3) for j in range(3)])


def canonical_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a reduction by given whole numbers, a turn and shifts, applied: distances within a frame, modulo the lattice, and volumes stay."""
    f = frames(spark, sf_dir)
    reduction = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ((1, 0, 0), (-1, 1, 0), (0, 1, 1))])
    f = f.withColumn("steps", c.canonical_steps(F.col("positions"), F.col("cell"), reduction))
    new = f.withColumn("new", c.apply_canonical(F.col("steps"), F.col("positions"), F.col("cell"))).select("vec_id", "new.positions", "new.cell")
    u = F.flatten(g.to_relative(F.col("positions"), F.col("cell")))
    upper = lambda i, j: F.abs(g.at(F.col("cell"), i, j)) < 1e-9
    return new.select("vec_id", r6(g.volume(F.col("cell"))).alias("volume"), F.forall(u, lambda x: (x > -1e-9) & (x < 1 + 1e-9)).cast("int").alias("inside"), (upper(0, 1) & upper(0, 2) & upper(1, 2)).cast("int").alias("lower"))


def gram_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric functions of the eigenvalues of each cell's scalar products."""
    e = [F.get("e", F.lit(k)) for k in range(3)]
    found = frames(spark, sf_dir).select("vec_id", c.gram_eigenvalues(F.col("cell")).alias("e"))
    return found.select("vec_id", r6(e[0] + e[1] + e[2]).alias("trace"), r6(e[0] * e[0] + e[1] * e[1] + e[2] * e[2]).alias("squares"), F.round(e[0] * e[1] * e[2], 5).alias("product"), ((e[0] <= e[1]) & (e[1] <= e[2])).cast("int").alias("rising"))


def displaced_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and volumes after a random turn and move are those before."""
    moved = frames(spark, sf_dir).select("vec_id", c.displaced(F.col("positions"), F.col("cell"), 5).alias("m")).select("vec_id", "m.*")
    return moved.select("vec_id", r6(g.distance(g.at(F.col("positions"), 0), g.at(F.col("positions"), 4))).alias("d"), r6(g.volume(F.col("cell"))).alias("volume"))


def permuted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.permuted_within(points(spark, sf_dir), "frame", "kind", "i", 3)
    return found.groupBy("frame", "kind").agg(F.count_distinct("new_place").alias("n"), F.sum("new_place").alias("places"))


def drift_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = en.without_drift(heavy(spark, sf_dir), "mass", "v")
    return found.select("frame", "i", *[r6(g.at(F.col("v"), k)).alias(f"v{k}") for k in range(3)])


def inertia_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = en.inertia(heavy(spark, sf_dir), "mass", "p")
    return found.select("frame", *[r6(g.at(F.col("inertia"), i, j)).alias(f"i{i}{j}") for i in range(3) for j in range(i, 3)])


def angular_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = en.angular_momentum(heavy(spark, sf_dir), "mass", "p", "v")
    return found.select("frame", *[r6(g.at(F.col("momentum"), k)).alias(f"l{k}") for k in range(3)])


def group_coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordination of the even points by the odd ones, without a cell."""
    found = g.coordination_between(F.col("positions"), None, [0, 2, 4], [1, 3, 5], 1.0)
    return frames(spark, sf_dir).select("vec_id", F.round(found, 5).alias("cn"))


def stacked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts stacked and taken apart again."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "value")
    parts = ro.unstacked(ro.stacked([rows.where(F.col("user_id") % 3 == k) for k in range(3)]), 3)
    return ro.stacked(parts[::-1], "back").groupBy("back").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def gathered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key, as often as they are named."""
    rows = events(spark, sf_dir).select("event_id", "value")
    wanted = rows.where("value > 100").select((F.col("event_id") % 50).alias("event_id"), F.col("event_id").alias("place"))
    return ro.gathered(rows, "event_id", wanted).select("place", "event_id", r6("value").alias("value"))


def column_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "value")
    means = rows.groupBy("user_id").agg(F.avg("value").alias("value")).where("user_id % 7 > 0")
    return ro.with_column_of(rows, "user_id", means, "value").select("event_id", r6("value").alias("value"))


def folded_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and spread by group, folded over batches by the rule for joining two sets."""
    schema = "event_type string, n long, mean double, m2 double"

    def start(t: pa.Table) -> pa.Table:
        p = t.to_pandas().groupby("event_type")["value"].agg(n="count", mean="mean", m2=lambda v: ((v - v.mean()) ** 2).sum()).reset_index()
        return pa.Table.from_pandas(p, preserve_index=False)

    def merge(t: pa.Table) -> pa.Table:
        p = t.to_pandas()
        n = p["n"].sum()
        mean = (p["n"] * p["mean"]).sum() / n
        return pa.table({"event_type": p["event_type"].iloc[:1], "n": [int(n)], "mean": [float(mean)], "m2": [float(p["m2"].sum() + (p["n"] * (p["mean"] - mean) ** 2).sum())]})

    found = ro.folded(events(spark, sf_dir).select("event_type", "value"), ["event_type"], start, merge, schema)
    return found.select("event_type", "n", r6("mean").alias("mean"), F.round(F.col("m2") / F.col("n"), 4).alias("var"))


def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that hold NaN or infinities, counted; and those that don't, through the check."""
    rows = events(spark, sf_dir).select("event_id", F.array(F.lit(1.0), F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 10 == 1, float("inf")).otherwise(F.col("value"))).alias("x"))
    good = ro.finite(rows.where("event_id % 10 > 1"), ["x"]).agg(F.count("x").alias("good"))
    return ro.not_finite(rows, ["x"]).withColumnRenamed("x", "bad").crossJoin(good)  # one row each


QUERIES = {f.__name__: f for f in (neighbour_cells, neighbour_kinds, neighbour_kinds_of_both, neighbour_vectors, neighbour_pair_kinds, neighbour_pairs, neighbours_stale, neighbours_within, kinds_held, bessel_power, bessel_order_four, soap_power, spectrum_length, pair_powers, kind_spread, pooled_layers, wrap_steps, cell_turned, canonical_replayed, gram_invariants, displaced_distances, permuted_points, drift_removed, inertia_tensor, angular_momentum, group_coordination, stacked_parts, gathered_rows, column_replaced, folded_moments, finite_rows)}

_C = "c AS (SELECT vec_id f, embedding e, 2+vec_id%3*0.25 a, 1.5+vec_id%2*0.5 z3 FROM embeddings)"
_A = f"{_C}, a AS (SELECT f, i, i%2 kind, CAST(e[3*i+1] AS DOUBLE)*4 x, CAST(e[3*i+2] AS DOUBLE)*4 y, CAST(e[3*i+3] AS DOUBLE)*4 z, a, z3, CAST(e[3*i+19] AS DOUBLE) vx, CAST(e[3*i+20] AS DOUBLE) vy, CAST(e[3*i+21] AS DOUBLE) vz, i+1.0 m FROM c CROSS JOIN range(6) t(i))"
#: Points wrapped into their cells, and all images within reach.
_E = f"""{_A}, u AS (SELECT *, z/z3 w, (y+0.4*z/z3)/2 v, (x-0.5*(y+0.4*z/z3)/2-0.3*z/z3)/a u FROM a),
p AS (SELECT f, i, kind, a, z3, (u-floor(u))*a+(v-floor(v))*0.5+(w-floor(w))*0.3 x, (v-floor(v))*2-(w-floor(w))*0.4 y, (w-floor(w))*z3 z FROM u),
s AS (SELECT i1*a+i2*0.5+i3*0.3 sx, i2*2-i3*0.4 sy, i3*z3 sz, i1, i2, i3, f g FROM c CROSS JOIN range(-3,4) q(i1) CROSS JOIN range(-3,4) r(i2) CROSS JOIN range(-3,4) t(i3)),
h AS (SELECT l.f frame, l.i, o.i j, l.kind kind_i, o.kind kind_j, i1, i2, i3, o.x+sx-l.x dx, o.y+sy-l.y dy, o.z+sz-l.z dz FROM p l JOIN p o ON l.f=o.f JOIN s ON s.g=l.f),
e AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) r FROM h WHERE dx*dx+dy*dy+dz*dz < 2.56 AND NOT (i=j AND i1=0 AND i2=0 AND i3=0)),
k AS (SELECT l.frame, l.i, l.kind_j, o.kind_j kind_j_2, l.r, o.r r_2, greatest(-1,least(1,(l.dx*o.dx+l.dy*o.dy+l.dz*o.dz)/(l.r*o.r))) cosine, l.j=o.j AND l.i1=o.i1 AND l.i2=o.i2 AND l.i3=o.i3 same FROM e l JOIN e o ON l.frame=o.frame AND l.i=o.i)"""


def _bessel(n: int, order: int, r: str) -> str:
    x = f"({r}*{(n + 1) * math.pi / CUT!r})"
    return ["sin({x})/{x}", "(sin({x})/({x}*{x})-cos({x})/{x})", "((3/({x}*{x})-1)*sin({x})/{x}-3*cos({x})/({x}*{x}))"][order].format(x=x) + f"*0.5*(1+cos({math.pi / CUT!r}*{r}))"


def _bessel_four(r: str) -> str:
    x = f"({r}*{math.pi / CUT!r})"
    return f"((105/pow({x},5)-45/pow({x},3)+1/{x})*sin({x})-(105/pow({x},4)-10/pow({x},2))*cos({x}))*0.5*(1+cos({math.pi / CUT!r}*{r}))"


def _soap(n: int, order: int, r: str, sigma: float = 0.5, nodes: int = 6) -> str:
    parts = []
    for q in range(nodes):
        s = (q + 0.5) * CUT / nodes
        x, e = f"({r}*{s / sigma**2!r})", f"exp(-2*{r}*{s / sigma**2!r})"
        form = ["((1-{e})/(2*{x}))", "((({x}-1)+({x}+1)*{e})/(2*{x}*{x}))", "((({x}*{x}-3*{x}+3)-({x}*{x}+3*{x}+3)*{e})/(2*{x}*{x}*{x}))"][order].format(x=x, e=e)
        parts.append(f"{(CUT - s) ** (n + 2) * s * s * CUT / nodes!r}*exp(-({r}-{s!r})*({r}-{s!r})/{2 * sigma**2!r})*{form}")
    return f"({'+'.join(parts)})*0.5*(1+cos({math.pi / CUT!r}*{r}))"


def _spectrum(radial) -> str:  # noqa: ANN001
    """The double sum over neighbours, as it is defined."""
    legendre = ["1", "cosine", "(3*cosine*cosine-1)/2"]
    entries = [(order, n, m) for order in range(3) for n in range(2) for m in range(n, 2)]
    single = ", ".join(f"{radial(n, order, 'r')} q{n}{order}" for n in range(2) for order in range(3))
    out = ", ".join(f"round(sum(t1.q{n}{order}*t2.q{m}{order}*{legendre[order].replace('cosine', 'c')})*CASE WHEN ka=kb THEN 1 ELSE sqrt(2) END,5) AS s{x}" for x, (order, n, m) in enumerate(entries))
    out = out.replace("t1.q", "a_").replace("t2.q", "b_")
    names = ", ".join(f"l.q{n}{order} a_{n}{order}, o.q{n}{order} b_{n}{order}" for n in range(2) for order in range(3))
    return f"""WITH {_E}, w AS (SELECT *, {single} FROM e),
d AS (SELECT l.frame, l.i, l.kind_j ka, o.kind_j kb, greatest(-1,least(1,(l.dx*o.dx+l.dy*o.dy+l.dz*o.dz)/(l.r*o.r))) c, {names} FROM w l JOIN w o ON l.frame=o.frame AND l.i=o.i AND l.kind_j<=o.kind_j)
SELECT frame, i, ka AS kind_a, kb AS kind_b, {out} FROM d GROUP BY frame, i, ka, kb"""


def _layer(source: str, kind: str, layer: int, names: list[str]) -> str:
    relu = lambda k, col: "greatest(0," + "+".join(f"({_LAYERS[layer][k][r][col]!r})*{names[r]}" for r in range(len(names))) + ")"
    return ", ".join(f"CASE WHEN {kind}=0 THEN {relu(0, col)} ELSE {relu(1, col)} END h{col}" for col in range(2))


_N = "(28,29,30),(31,32,33),(34,35,36)"
SQL = {
    "neighbour_cells": f"WITH {_E} SELECT frame, i, count(*) AS n, round(sum(exp(-r)),6) AS value FROM e GROUP BY 1,2",
    "neighbour_kinds": f"WITH {_E} SELECT frame, i, kind_j, count(*) AS n, round(sum(exp(-r)),6) AS value FROM e GROUP BY 1,2,3",
    "neighbour_kinds_of_both": f"WITH {_E} SELECT frame, kind_i, kind_j, count(*) AS n, round(sum(r),6) AS value FROM e GROUP BY 1,2,3",
    "neighbour_vectors": f"WITH {_E} SELECT frame, " + ", ".join(f"round(sum(d{'xyz'[i]}*d{'xyz'[j]}),6) AS d{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM e GROUP BY 1",
    "neighbour_pair_kinds": f"WITH {_E} SELECT frame, i, kind_j, kind_j_2, count(*) AS n, round(sum(cosine*exp(-r-2*r_2)),6) AS value FROM k WHERE NOT same GROUP BY 1,2,3,4",
    "neighbour_pairs": f"WITH {_E} SELECT frame, i, count(*) AS n, round(sum(cosine),6) AS value FROM k WHERE NOT same GROUP BY 1,2",
    "neighbours_stale": f"WITH {_A} SELECT f AS frame, max((x*x+y*y+z*z)*pow(f%4*0.05,2)) > 0.01 AS stale FROM a GROUP BY 1",
    "neighbours_within": f"WITH {_E} SELECT frame, count(*) AS n, round(sum(r),6) AS value FROM e WHERE r < 1.2 GROUP BY 1",
    "kinds_held": "SELECT CAST(k AS INT) AS kind, 3 AS n, CAST(k=0 AS DOUBLE) AS is0, CAST(k=1 AS DOUBLE) AS is1, CAST(k=2 AS DOUBLE) AS is2 FROM range(2) t(k)",
    "bessel_order_four": f"WITH {_E} SELECT frame, i, kind_j AS kind_a, kind_j_2 AS kind_b, round(sum(({_bessel_four('r')})*({_bessel_four('r_2')})*(35*pow(cosine,4)-30*pow(cosine,2)+3)/8)*CASE WHEN kind_j=kind_j_2 THEN 1 ELSE sqrt(2.0) END,5) AS s4 FROM k WHERE kind_j<=kind_j_2 GROUP BY 1,2,3,4",
    "bessel_power": _spectrum(_bessel),
    "soap_power": _spectrum(_soap),
    "spectrum_length": f"WITH {_E} SELECT DISTINCT frame, i, CAST(1.0 AS DOUBLE) AS length FROM e",
    "pair_powers": f"WITH {_E} SELECT frame, i, kind_j, kind_j_2, CAST(count(*) AS DOUBLE) AS v0, round(sum(cosine),6) AS v1, round(sum(r_2),6) AS v2, round(sum(r),6) AS v3 FROM k WHERE NOT same AND kind_j<=kind_j_2 GROUP BY 1,2,3,4",
    "kind_spread": f"WITH {_A}, v AS (SELECT kind, var_pop(x) a, var_pop(y) b, var_pop(z) c FROM a GROUP BY kind) SELECT CAST(kind AS INT) AS kind, round(3/(a+b+c),5) AS by_variance, round(3/(sqrt(a)+sqrt(b)+sqrt(c)),5) AS by_deviation FROM v",
    "pooled_layers": f"WITH {_A}, o AS (SELECT f, kind, {_layer('a', 'kind', 0, ['x', 'y', 'z'])} FROM a), q AS (SELECT f, kind, {_layer('o', 'kind', 1, ['o.h0', 'o.h1'])} FROM o) SELECT f AS frame, CAST(kind AS INT) AS kind, round(sum(h0),6) AS y0, round(sum(h1),6) AS y1 FROM q GROUP BY 1,2",
    "wrap_steps": f"""WITH {_A}, u AS (SELECT *, z/z3 w, (y+0.4*z/z3)/2 v, (x-0.5*(y+0.4*z/z3)/2-0.3*z/z3)/a u FROM a), s AS (SELECT *, -floor(u+0.5) s0, -floor(v+0.5) s1, -floor(w+0.5) s2 FROM u)
SELECT f AS vec_id, sum(s0) AS shift0, sum(s1) AS shift1, sum(s2) AS shift2, round(sum(x+s0*a+s1*0.5+s2*0.3),5) AS x0, round(sum(y+s1*2-s2*0.4),5) AS x1, round(sum(z+s2*z3),5) AS x2 FROM s GROUP BY 1""",
    "cell_turned": """WITH v AS (SELECT vec_id, list_transform(embedding[28:30], lambda x: CAST(x AS DOUBLE)) a, list_transform(embedding[31:33], lambda x: CAST(x AS DOUBLE)) b, list_transform(embedding[34:36], lambda x: CAST(x AS DOUBLE)) c FROM embeddings),
l AS (SELECT *, sqrt(list_dot_product(a,a)) l0, list_dot_product(a,b)/sqrt(list_dot_product(a,a)) b0, list_dot_product(a,c)/sqrt(list_dot_product(a,a)) c0 FROM v), m AS (SELECT *, sqrt(list_dot_product(b,b)-b0*b0) b1 FROM l), n AS (SELECT *, (list_dot_product(b,c)-b0*c0)/b1 c1 FROM m)
SELECT vec_id, round(l0,6) AS c00, 0.0 AS c01, 0.0 AS c02, round(b0,6) AS c10, round(b1,6) AS c11, 0.0 AS c12, round(c0,6) AS c20, round(c1,6) AS c21, round(sqrt(greatest(0,list_dot_product(c,c)-c0*c0-c1*c1)),6) AS c22 FROM n""",
    "canonical_replayed": f"WITH {_C} SELECT f AS vec_id, round(a*2*z3,6) AS volume, 1 AS inside, 1 AS lower FROM c",
    "gram_invariants": f"""WITH {_C}, g AS (SELECT f, a*a g00, a*0.5 g01, a*0.3 g02, 4.25 g11, 0.15-0.8 g12, 0.09+0.16+z3*z3 g22, a*2*z3 d FROM c)
SELECT f AS vec_id, round(g00+g11+g22,6) AS trace, round(g00*g00+g11*g11+g22*g22+2*(g01*g01+g02*g02+g12*g12),6) AS squares, round(d*d,5) AS product, 1 AS rising FROM g""",
    "displaced_distances": f"WITH {_A} SELECT p.f AS vec_id, round(sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2)),6) AS d, round(p.a*2*p.z3,6) AS volume FROM a p JOIN a q ON p.f=q.f AND p.i=0 AND q.i=4",
    "permuted_points": f"WITH {_A} SELECT f AS frame, CAST(kind AS INT) AS kind, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM a GROUP BY 1,2",
    "drift_removed": f"WITH {_A} SELECT f AS frame, CAST(i AS INT) AS i, " + ", ".join(f"round(v{x}-sum(m*v{x}) OVER (PARTITION BY f)/sum(m) OVER (PARTITION BY f),6) AS v{k}" for k, x in enumerate("xyz")) + " FROM a",
    "inertia_tensor": f"WITH {_A} SELECT f AS frame, " + ", ".join(f"round(sum(m*({'x*x+y*y+z*z' if i == j else '0'}-{'xyz'[i]}*{'xyz'[j]})),6) AS i{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM a GROUP BY 1",
    "angular_momentum": f"WITH {_A} SELECT f AS frame, round(sum(m*(y*vz-z*vy)),6) AS l0, round(sum(m*(z*vx-x*vz)),6) AS l1, round(sum(m*(x*vy-y*vx)),6) AS l2 FROM a GROUP BY 1",
    "group_coordination": f"WITH {_A}, r AS (SELECT p.f, sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2)) r FROM a p JOIN a q ON p.f=q.f AND p.kind=0 AND q.kind=1) SELECT f AS vec_id, round(sum(1/(1+pow(r,6))),5) AS cn FROM r GROUP BY 1",
    "stacked_parts": "SELECT CAST(2-user_id%3 AS INT) AS back, count(*) AS n, round(sum(value),4) AS value FROM events GROUP BY 1",
    "gathered_rows": "SELECT w.event_id AS place, e.event_id, round(e.value,6) AS value FROM events w JOIN events e ON e.event_id=w.event_id%50 WHERE w.value>100",
    "column_replaced": "SELECT event_id, CASE WHEN user_id%7>0 THEN round(avg(value) OVER (PARTITION BY user_id),6) END AS value FROM events",
    "folded_moments": "SELECT event_type, count(*) AS n, round(avg(value),6) AS mean, round(var_pop(value),4) AS var FROM events GROUP BY 1",
    "finite_rows": "SELECT count(*) FILTER (event_id%10<2) AS bad, count(*) FILTER (event_id%10>1) AS good FROM events",
}
