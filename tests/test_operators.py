"""Operators on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import transforms as t
from tessera.functions.metric import Axis, Metric, bins_per_axis
from tessera.operators import histogram as h
from tessera.operators import koopman as k
from tessera.operators import moments as mo
from tessera.operators import neighbours as nb
from tessera.operators import reweight as rw
from tessera.operators import sample as sa
from tessera.operators import series as s
from tessera.operators.connectivity import regions


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_combine_then_split_is_identity(spark):
    x = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    both = (t.part(0, 2) + t.part(2, 1))(x)
    assert value(spark, both) == [1.0, 2.0, 3.0]
    assert value(spark, t.part(2, 1)(both)) == [3.0]


def test_serial_order(spark):
    x = F.array(F.lit(2.0))
    assert value(spark, (t.shift(1.0) * t.scale(3.0))(x)) == [9.0]
    assert value(spark, (t.scale(3.0) * t.shift(1.0))(x)) == [7.0]


def test_perspective_map_takes_corners(spark):
    old, new = [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (3, 2), (0, 1)]
    f = t.affine_2d(old, new)
    for p, q in zip(old, new, strict=True):
        assert np.allclose(value(spark, f(F.array(F.lit(float(p[0])), F.lit(float(p[1]))))), q)


def test_wrap_and_unmap(spark):
    a = Axis(-math.pi, math.pi, periodic=True)
    assert value(spark, a.wrap(F.lit(math.pi + 0.5))) == pytest.approx(-math.pi + 0.5)
    assert value(spark, a.difference(F.lit(3.0), F.lit(-3.0))) == pytest.approx(2 * math.pi - 6)
    assert value(spark, a.unmap(a.map(F.lit(0.25)))) == pytest.approx(0.25)
    assert bins_per_axis(1000, 10, 2) == 10


def test_periodic_harmonic_is_invariant(spark):
    from tessera.functions import bias as b

    m = Metric((Axis(0.0, 2 * math.pi, True), Axis(-math.pi, math.pi, True)))
    values = [value(spark, b.harmonic(m, [F.lit(1.0 + 2 * math.pi * i), F.lit(2.0 - 2 * math.pi * i)], [math.pi, -math.pi], [1 / 36, 1 / 36])) for i in range(3)]
    assert np.allclose(values, values[0])


def test_rbf_passes_through_nodes(spark):
    from tessera.functions import bias as b

    x = np.linspace(0, 1, 6)[:, None]
    y = x[:, 0] ** 3 + 1
    for kernel in ("gaussian", "multiquadric"):
        c = b.rbf_fit(x, y, kernel, 2.0)
        centres = spark.createDataFrame([(float(p), float(v)) for p, v in zip(x[:, 0], c, strict=True)], "c0 double, coefficient double")
        points = spark.createDataFrame([(float(p),) for p in x[:, 0]], "x0 double")
        got = b.rbf_evaluate(points, centres, Metric((Axis(0.0, 1.0),)), 1, kernel, 2.0).orderBy("x0").toPandas()["value"]
        assert np.allclose(got, y)


def test_geometry(spark):
    rng = np.random.default_rng(0)
    cell, pos = rng.normal(size=(3, 3)), rng.normal(size=(4, 3))
    lit = lambda m: F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])
    assert value(spark, g.volume(lit(cell))) == pytest.approx(abs(np.linalg.det(cell)))
    assert np.allclose(value(spark, g.to_relative(lit(pos), lit(cell))), pos @ np.linalg.inv(cell))
    assert np.allclose(value(spark, g.to_absolute(g.to_relative(lit(pos), lit(cell)), lit(cell))), pos)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    turned = [value(spark, g.dihedral([lit(p)[i] for i in range(4)])) for p in (pos, pos @ q)]
    assert turned[0] == pytest.approx(turned[1])
    box = np.diag([10.0, 10.0, 10.0])
    a, b = F.array(*[F.lit(v) for v in (0.5, 0.5, 0.5)]), F.array(*[F.lit(v) for v in (9.5, 9.5, 0.5)])
    assert value(spark, g.min_distance(a, b, lit(box))) == pytest.approx(math.sqrt(2))


def test_bounds_are_strict_and_constant_columns_widen(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (5.0, 1.0), (10.0, 1.0)], "x double, y double")
    assert h.assign(rows, ["x"], 11).select("bin").collect()[0]["bin"] == 5
    box = h.bounds(rows, ["y"]).first()
    assert (box["lo_y"], box["hi_y"]) == (0.5, 1.5)


def test_log_sum_exp_ignores_nothing_and_is_stable(spark):
    rows = spark.createDataFrame([("a", 1000.0), ("a", 1000.0), ("a", None), ("b", float("-inf"))], "k string, v double")
    assert {r["k"]: r["lse"] for r in h.log_sum_exp(rows, ["k"], "v").collect()} == {"a": pytest.approx(1000 + math.log(2))}


def test_weights_that_sum_to_nothing_fail(spark):
    rows = spark.createDataFrame([(0.0,), (float("nan"),)], "w double")
    with pytest.raises(Exception, match="sum to 0"):
        h.normalised(rows, "w").collect()


def test_wham_recovers_a_flat_potential():
    x = np.linspace(-1, 1, 21)
    u = np.array([5 * (x - c) ** 2 for c in (-0.5, 0.5)])
    p = np.exp(-u)
    n = 1e6 * p / p.sum(axis=1, keepdims=True)
    found, f = rw.wham(n, u)
    assert np.allclose(found, 1 / 21, atol=1e-6)
    assert f[0] == pytest.approx(f[1], abs=1e-6)
    assert (rw.wham_errors(n, u, found, f) < 0.05).all()


def test_dham_recovers_a_chain():
    t = np.array([[0.9, 0.1, 0], [0.2, 0.7, 0.1], [0, 0.3, 0.7]])
    w = k.stationary(t)
    got, stat = rw.dham(1e6 * (w[:, None] * t)[None], np.zeros((1, 3)))
    assert np.allclose(got, t)
    assert np.allclose(stat, w, atol=1e-6)


def test_markov_chain_timescales():
    t = np.array([[0.9, 0.1], [0.2, 0.8]])
    assert k.implied_timescales(t)[0] == pytest.approx(-1 / math.log(0.7))
    assert np.allclose(k.stationary(t), [2 / 3, 1 / 3])


def test_koopman_finds_the_rate_of_an_ar1_series(spark):
    rng, a = np.random.default_rng(1), 0.8
    x = [0.0]
    for _ in range(4000):
        x.append(a * x[-1] + rng.normal())
    rows = spark.createDataFrame([(1, i, [float(v)]) for i, v in enumerate(x)], "traj int, i int, x array<double>")
    cov = mo.Covariances.of(s.lag_pairs(rows, "traj", ["i"], ["x"], 1), "x", "x_t")
    assert k.Koopman.fit(cov).values[0] == pytest.approx(a, abs=0.03)
    half = [mo.Covariances.of(s.lag_pairs(rows, "traj", ["i"], ["x"], 1).where(c), "x", "x_t") for c in ("i < 1500", "i >= 1500")]
    both = half[0] + half[1]
    assert np.allclose(both.c01, cov.c01)
    assert np.allclose(both.c00, cov.c00)


def test_periodic_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 6, size=(60, 2))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "k int, x double, y double")
    d = p[:, None] - p[None]
    d -= 6 * np.round(d / 6)
    r = np.sqrt((d**2).sum(-1))
    expected = {(i, j) for i in range(60) for j in range(60) if i != j and r[i, j] < 1.1}
    assert {(e["i"], e["j"]) for e in nb.edges(rows, "k", ["x", "y"], 1.1, box=[6.0, 6.0]).collect()} == expected
    tight = {(e["i"], e["j"]) for e in nb.edges(rows, "k", ["x", "y"], 2.9, box=[6.0, 6.0]).collect()}
    assert tight == {(i, j) for i in range(60) for j in range(60) if i != j and r[i, j] < 2.9}


def test_systematic_sample_follows_weights(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0), (4, None)], "k int, w double")
    got = [r["k"] for r in sa.systematic(rows, "k", "w", 8).orderBy("m").collect()]
    assert got == [1, 1, 2, 2, 2, 2, 2, 2]


def test_regions_join_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a int, b int")
    got = {r["node"]: r["region"] for r in regions(links).collect()}
    assert got == {**{i: 0 for i in range(10)}, 20: 20, 21: 20}


def test_rescaled_lag_interpolates(spark):
    rows = spark.createDataFrame([(1, i, float(i * i)) for i in range(6)], "traj int, i int, x double")
    got = {r["i"]: r["x_t"] for r in s.rescaled_lag(rows, "traj", ["i"], "x", F.lit(2.0), 3.0).collect()}
    assert got == {0: 2.5, 1: 6.5, 2: 12.5, 3: 20.5}


def test_store_round_trip(spark, tmp_path):
    from tessera.sources.store import Store, fraction_finished

    store = Store(spark, str(tmp_path))
    for r in (0, 1, 2):
        store.add_round({"cv_round": 0, "round": r, "timestep": 1.0})
        rows = spark.createDataFrame([(0, r, traj, i, [1.0 * i, 2.0], 5) for traj in (0, 1) for i in range(3)], "cv_round int, round int, traj int, row_id long, cv array<double>, unknown int")
        store.append(rows)
    assert "unknown" not in store.frames().columns
    assert store.scan(num=2).count() == 12
    store.set_flag("invalid", True, F.col("traj") == 1)
    assert store.scan(num=2).count() == 6
    assert store.scan(num=2, ignore_invalid=True).count() == 12
    store.set_flag("finished", False, (F.col("traj") == 0) & (F.col("round") == 2))
    assert store.scan(num=2).count() == 3
    assert {x["round"]: x["fraction"] for x in fraction_finished(store.trajectories(), ["round"]).collect()} == {0: 1.0, 1: 1.0, 2: 0.0}
    assert store.rounds().first()["bias_scale"] == 1.0


def test_stream_windows(spark, tmp_path):
    from tessera.streaming.windows import read_events, windowed

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(1).write.parquet(str(tmp_path / "in"))
    q = windowed(read_events(spark, str(tmp_path / "in")), "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("w_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) n from w_test").first()["n"] == 1000


def test_known_lattice_and_scrambled_cells():
    from tessera.functions import frames as fr

    reduced, op = fr.minkowski_reduce(np.array([[2.0, 0, 0], [6, 1, 0], [8, 9, 1]]))
    assert np.allclose(np.sort(np.abs(reduced), axis=0), np.sort(np.array([[0, 1, 0], [0, 0, 1], [2, 0, 0]]), axis=0))
    rng = np.random.default_rng(5)
    cell = np.diag([2.0, 3.0, 4.0]) + rng.normal(size=(3, 3)) * 0.1
    for _ in range(10):
        mixed = cell.copy()
        for _ in range(6):
            i, j = rng.choice(3, 2, replace=False)
            mixed[i] += rng.integers(-2, 3) * mixed[j]
        got, op = fr.minkowski_reduce(mixed)
        assert np.allclose(op @ mixed, got)
        assert np.allclose(np.linalg.norm(got, axis=1), np.sort(np.linalg.norm(cell, axis=1)), atol=1e-6)


def test_descriptors_do_not_turn_with_the_frame():
    from tessera.functions import frames as fr

    rng = np.random.default_rng(6)
    x = rng.uniform(0, 3, size=(7, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    a, b = fr.bessel_spectrum(x), fr.bessel_spectrum(x @ q + rng.normal(size=3))
    assert np.allclose(a, b)
    assert fr.sinkhorn(a, b[rng.permutation(7)], 1e-3) < 1e-2
    assert fr.sinkhorn(a, fr.bessel_spectrum(rng.uniform(0, 3, size=(7, 3))), 1e-3) > 1e-2
    z = np.array([0.0, 0.5, 3.0, 10.0])
    j = fr.spherical_jn(2, z)
    assert np.allclose(j[2][1:], (3 / z[1:] ** 2 - 1) * np.sin(z[1:]) / z[1:] - 3 * np.cos(z[1:]) / z[1:] ** 2)


def test_inefficiency_of_an_ar1_series():
    from tessera.functions.frames import inefficiency

    rng, a, x = np.random.default_rng(7), 0.7, [0.0]
    for _ in range(60000):
        x.append(a * x[-1] + rng.normal())
    assert inefficiency(np.array(x)) == pytest.approx((1 + a) / (1 - a), rel=0.15)


def test_estimators_compose(spark):
    from tessera.operators.fit import MIN_MAX, STANDARDISE, whitened

    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(v) for v in (a, a + b, 3.0)]) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "i int, x array<double>")
    f = (MIN_MAX * STANDARDISE * whitened()).fit(rows, "x", None)
    y = np.array(rows.select(f(F.col("x")).alias("y")).toPandas()["y"].tolist())
    assert np.allclose(np.cov(y.T, bias=True), np.eye(2), atol=1e-8)


def test_loaded_free_energy_is_flat_for_even_windows(spark):
    from tessera.plans.loader import free_energy, load

    rng = np.random.default_rng(9)
    rows, k = [], 0
    for w, c in enumerate((0.35, 0.65)):  # even density under two harmonic windows
        x = rng.uniform(0, 1, 40000)
        x = x[rng.uniform(size=len(x)) < np.exp(-8 * (x - c) ** 2)]
        rows += [(w, k + i, float(v)) for i, v in enumerate(x)]
        k += len(x)
    df = spark.createDataFrame(rows, "traj int, row_id long, x double")
    weighed = load(df, "traj", ["row_id"], "x", "traj", lambda w, x: 8 * (x - (0.35, 0.65)[w]) ** 2, edges=11)
    assert free_energy(weighed).toPandas()["f"].max() < 0.4  # kJ/mol: noise of a few percent
    assert load(df, "traj", ["row_id"], "x", "traj", None, edges=11, size=50).count() == 50


def test_posted_points_are_not_broadcast(spark, tmp_path):
    """Explode makes many rows of a small table; neither the join on cells nor that with the points broadcasts them."""
    from tessera import catalogue

    spark.range(3000).selectExpr("id as p_partkey", "concat('b', id % 5) as p_brand", "cast(id % 50 as int) as p_size", "id % 600 * 1.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("neighbour_counts", "neighbour_by_class", "neighbour_periodic", "neighbour_triples", "neighbour_nearest"):
        plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, name
