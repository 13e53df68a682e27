"""Queries on the transform algebra and descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import transforms as t
from tessera.operators import moments as mo
from tessera.operators.fit import MIN_MAX, STANDARDISE
from tessera.plans.common import events, r6, table, vectors


def rounded(x):  # noqa: ANN001, ANN201
    """An array as one string-free checksum per place: places as columns p0, p1, ..."""
    return F.transform(x, lambda v: F.round(v, 6))


def places(df: DataFrame, key: str, x: str, n: int) -> DataFrame:
    return df.select(key, *[r6(F.get(x, F.lit(k))).alias(f"p{k}") for k in range(n)])


def serial_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = t.part(0, 3) * t.scale(2.0, 3.0, 4.0) * t.shift(1.0, 0.0, -1.0) * t.activation("tanh")
    return places(vectors(spark, sf_dir).withColumn("y", pipe(F.col("x"))), "vec_id", "y", 3)


def parallel_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = t.take(0, 5) + t.part(2, 2) * t.activation("relu")
    return places(vectors(spark, sf_dir).withColumn("y", pipe(F.col("x"))), "vec_id", "y", 4)


def array_combine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (t.part(0, 2) + t.part(2, 1)) * t.append(7.0)
    df = vectors(spark, sf_dir).withColumn("y", both(F.col("x")))
    return df.select("vec_id", F.size("y").alias("n"), r6(F.get(F.slice("y", 3, 1), F.lit(0))).alias("third"), r6(F.element_at("y", -1)).alias("last"))


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("x", F.array("value"))
    return rows.select("event_id", r6(F.get(MIN_MAX.fit(rows, "x", None)(F.col("x")), F.lit(0))).alias("u"))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("x", F.array("value"))
    mean = mo.array_moments(rows, "x")[1]
    centred = t.shift(*(-mean).tolist())(F.col("x"))
    return rows.select("event_id", r6(F.get(STANDARDISE.fit(rows, "x", None)(F.col("x")), F.lit(0))).alias("z"), r6(F.get(centred, F.lit(0))).alias("centred"))


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array((F.col("value") - 100) / 50)
    names = ["relu", "relu6", "leaky_relu", "elu", "selu", "sigmoid", "log_sigmoid", "tanh", "hard_tanh", "softplus", "soft_sign", "swish", "gelu", "abs", "square", "sin"]
    return events(spark, sf_dir).select("event_id", *[r6(F.get(t.ACTIVATIONS[n](x), F.lit(0))).alias(n) for n in names], r6(F.get(t.activation("tanh", 0.1)(x), F.lit(0))).alias("leaky_tanh"), r6(F.get(t.smooth_abs(0.01)(x), F.lit(0))).alias("smooth_abs"))


def monomials_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(vectors(spark, sf_dir).withColumn("y", t.monomials(2, 2)(F.col("x"))), "vec_id", "y", 6)


def tanh_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(events(spark, sf_dir).withColumn("y", t.indicators(0.0, 300.0, 3)(F.array("value"))), "event_id", "y", 3)


def matmul_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = t.part(0, 2) * t.linear([[1.0, 2.0, 0.5], [-1.0, 0.25, 3.0]], [0.1, 0.2, 0.3])
    return places(vectors(spark, sf_dir).withColumn("y", pipe(F.col("x"))), "vec_id", "y", 3)


def group_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(vectors(spark, sf_dir).withColumn("y", t.group_sort(4, 2)(F.col("x"))), "vec_id", "y", 8)


def periodic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = t.periodic_pair(1) + t.centre_periodic(1.5)
    return places(events(spark, sf_dir).withColumn("y", pipe(F.array("value"))), "event_id", "y", 3)


def stack_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(vectors(spark, sf_dir).withColumn("y", t.reduce_parts(16, 4)(F.col("x"))), "vec_id", "y", 4)


def frame_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda k: F.slice("x", 3 * k + 1, 3)
    df = vectors(spark, sf_dir).withColumn("cell", F.array(*[F.zip_with(x(k), F.array(*[F.lit(3.0 if j == k else 0.0) for j in range(3)]), lambda a, b: a + b) for k in range(3)]))
    return df.select("vec_id", r6(g.volume(F.col("cell"))).alias("volume"), r6(g.distance(x(3), x(4))).alias("distance"), F.round(g.angle(x(3), x(4), x(5)), 5).alias("angle"), F.round(g.dihedral([x(3), x(4), x(5), x(6)]), 5).alias("dihedral"))


def relative_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ([2, 0, 0], [1, 3, 0], [0, 1, 4])])
    p = F.array(F.slice("x", 1, 3))
    df = vectors(spark, sf_dir).withColumn("rel", g.to_relative(p, cell)).withColumn("back", g.to_absolute(F.col("rel"), cell)).withColumn("wrap", g.wrapped(F.col("rel")))
    return df.select("vec_id", *[r6(g.at(F.col(c), 0, k)).alias(f"{c}{k}") for c in ("rel", "back", "wrap") for k in range(3)])


def coordination_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10 + 0.05).alias("r"))
    return p.select("p_partkey", r6(g.coordination(F.col("r"), 2.0)).alias("c"))


QUERIES = {f.__name__: f for f in (serial_compose, parallel_concat, array_combine_split, minmax_scale, zscore, activations, monomials_2, tanh_steps, matmul_affine, group_sorted, periodic_features, stack_reduce, frame_geometry, relative_coordinates, coordination_number)}

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) x FROM embeddings)"


def _list(exprs: list[str]) -> str:
    return ", ".join(f"round({e},6) AS p{k}" for k, e in enumerate(exprs))


def _triple(k: int) -> list[str]:
    return [f"x[{3 * k + j + 1}]" for j in range(3)]


def _minus(a: list[str], b: list[str]) -> list[str]:
    return [f"({p}-{q})" for p, q in zip(a, b, strict=True)]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + "+".join(f"{p}*{q}" for p, q in zip(a, b, strict=True)) + ")"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[(k + 1) % 3]}*{b[(k + 2) % 3]}-{a[(k + 2) % 3]}*{b[(k + 1) % 3]})" for k in range(3)]


_P = [_triple(k) for k in range(7)]
_CELL = [[f"({v}+{3.0 if j == k else 0.0})" for j, v in enumerate(_P[k])] for k in range(3)]
_D1, _D2, _D3 = _minus(_P[4], _P[3]), _minus(_P[5], _P[4]), _minus(_P[6], _P[5])
_N, _M = _cross(_D1, _D2), _cross(_D2, _D3)
_BA, _BC = _minus(_P[3], _P[4]), _minus(_P[5], _P[4])

SQL = {
    "serial_compose": f"WITH {_V} SELECT vec_id, {_list(['tanh(x[1]*2+1)', 'tanh(x[2]*3)', 'tanh(x[3]*4-1)'])} FROM v",
    "parallel_concat": f"WITH {_V} SELECT vec_id, {_list(['x[1]', 'x[6]', 'greatest(x[3],0.0)', 'greatest(x[4],0.0)'])} FROM v",
    "array_combine_split": f"WITH {_V} SELECT vec_id, 4 AS n, round(x[3],6) AS third, 7.0 AS last FROM v",
    "minmax_scale": "SELECT event_id, round((value-(SELECT min(value) FROM events))/((SELECT max(value) FROM events)-(SELECT min(value) FROM events)),6) AS u FROM events",
    "zscore": "WITH s AS (SELECT avg(value) m, stddev_pop(value) s FROM events) SELECT event_id, round((value-m)/s,6) AS z, round(value-m,6) AS centred FROM events CROSS JOIN s",
    "activations": """WITH a AS (SELECT event_id, (value-100)/50 v FROM events) SELECT event_id, round(greatest(v,0.0),6) AS relu, round(least(greatest(v,0.0),6.0),6) AS relu6,
round(CASE WHEN v>=0 THEN v ELSE 0.01*v END,6) AS leaky_relu, round(CASE WHEN v>0 THEN v ELSE exp(v)-1 END,6) AS elu, round(1.0507009873554805*CASE WHEN v>0 THEN v ELSE 1.6732632423543772*(exp(v)-1) END,6) AS selu,
round(1/(1+exp(-v)),6) AS sigmoid, round(-ln(1+exp(-v)),6) AS log_sigmoid, round(tanh(v),6) AS tanh, round(least(greatest(v,-1.0),1.0),6) AS hard_tanh, round(ln(1+exp(v)),6) AS softplus, round(v/(1+abs(v)),6) AS soft_sign,
round(v/(1+exp(-v)),6) AS swish, round(0.5*v*(1+tanh(0.7978845608028654*(v+0.044715*v*v*v))),6) AS gelu, round(abs(v),6) AS abs, round(v*v,6) AS square, round(sin(v),6) AS sin, round(0.9*tanh(v)+0.1*v,6) AS leaky_tanh, round(sqrt(v*v+0.01),6) AS smooth_abs FROM a""",
    "monomials_2": f"WITH {_V} SELECT vec_id, {_list(['1.0', 'x[1]', 'x[2]', 'x[1]*x[1]', 'x[1]*x[2]', 'x[2]*x[2]'])} FROM v",
    "tanh_steps": f"SELECT event_id, {_list([f'(tanh((value-{50 + 100 * k}.0)/100)+1)/2' for k in range(3)])} FROM events",
    "matmul_affine": f"WITH {_V} SELECT vec_id, {_list(['x[1]-x[2]+0.1', '2*x[1]+0.25*x[2]+0.2', '0.5*x[1]+3*x[2]+0.3'])} FROM v",
    "group_sorted": f"WITH {_V} SELECT vec_id, {_list([f'list_sort(x[{1 + 4 * (k // 4)}:{4 + 4 * (k // 4)}])[{k % 4 + 1}]' for k in range(8)])} FROM v",
    "periodic_features": f"SELECT event_id, {_list(['cos(value)', 'sin(value)', '((value-1.5+3.141592653589793)/6.283185307179586-floor((value-1.5+3.141592653589793)/6.283185307179586))*6.283185307179586-3.141592653589793'])} FROM events",
    "stack_reduce": f"WITH {_V} SELECT vec_id, {_list([f'(x[{k + 1}]+x[{k + 17}]+x[{k + 33}]+x[{k + 49}])/4' for k in range(4)])} FROM v",
    "frame_geometry": f"""WITH {_V} SELECT vec_id, round(abs({_dot(_CELL[0], _cross(_CELL[1], _CELL[2]))}),6) AS volume, round(sqrt({_dot(_D1, _D1)}),6) AS distance,
round(acos({_dot(_BA, _BC)}/(sqrt({_dot(_BA, _BA)})*sqrt({_dot(_BC, _BC)}))),5) AS angle, round(atan2({_dot(_cross(_N, _M), _D2)}/sqrt({_dot(_D2, _D2)}), {_dot(_N, _M)}),5) AS dihedral FROM v""",
    "relative_coordinates": f"""WITH {_V}, r AS (SELECT vec_id, x[1] a, x[2] b, x[3] c, x[3]/4 r2, (x[2]-x[3]/4)/3 r1, (x[1]-(x[2]-x[3]/4)/3)/2 r0 FROM v)
SELECT vec_id, round(r0,6) AS rel0, round(r1,6) AS rel1, round(r2,6) AS rel2, round(a,6) AS back0, round(b,6) AS back1, round(c,6) AS back2, round(r0-floor(r0),6) AS wrap0, round(r1-floor(r1),6) AS wrap1, round(r2-floor(r2),6) AS wrap2 FROM r""",
    "coordination_number": "WITH r AS (SELECT p_partkey, (p_size/10.0+0.05)/2 x FROM part) SELECT p_partkey, round(CASE WHEN abs(x-1)<1e-3 THEN 0.5*(1-3*(x-1)) ELSE (1-pow(x,6))/(1-pow(x,12)) END,6) AS c FROM r",
}
