"""Queries that SQL can't express, against plain numpy over the same tables; and operators without a query."""

import math
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import bias as b
from tessera.functions import transforms as t
from tessera.functions.metric import Axis, Metric
from tessera.operators import environments as en
from tessera.operators import histogram as h
from tessera.operators import koopman as ko
from tessera.operators import moments as mo
from tessera.operators import rows as ro

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events():
    return pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def vectors():
    p = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return p["vec_id"].to_numpy(), np.stack(p["embedding"]).astype(float), p["label"].to_numpy()


def run(spark, name):
    return catalogue.queries()[name](spark, SF).toPandas()


def bins_of(values, n=30):
    lo, hi = values.min(), values.max()
    out = np.floor((values - lo) / ((hi - lo) / (n - 1))).astype(int)
    return np.where((values > lo) & (values < hi), np.minimum(out, n - 2), -1)


def ratios(x, label):
    """Falling ratios of scatter between classes to that within."""
    mean = x.mean(0)
    between = sum((label == k).mean() * np.outer(x[label == k].mean(0) - mean, x[label == k].mean(0) - mean) for k in set(label))
    within = np.cov(x.T, bias=True) - between
    return np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1]


def test_lda_directions(spark, vectors):
    got = run(spark, "lda_directions").sort_values("mode")["ratio"].to_numpy()
    assert np.allclose(got, ratios(vectors[1], vectors[2])[:2], rtol=1e-6)


def test_fitted_pipeline(spark, vectors):
    ids, x, label = vectors
    got = run(spark, "fitted_pipeline").sort_values("vec_id")
    y = np.stack(got["y"])
    assert (got["vec_id"].to_numpy() == ids).all()
    assert np.allclose(ratios(y, label), ratios(x, label)[:2], rtol=1e-6)  # scaling changes no ratio


def windows(events):
    k, i = bins_of(events["value"].to_numpy()), (events["user_id"] % 3).to_numpy()
    there = sorted(set(k[k >= 0]))
    n = np.array([[((k == x) & (i == w)).sum() for x in there] for w in range(3)], float)
    u = np.array([[0.5 * 0.02 * (x - 6.0 * w) ** 2 for x in there] for w in range(3)])
    return k, i, there, n, u


def plain_wham(n, u, steps=20_000):
    p = n.sum(0) / n.sum()
    for _ in range(steps):
        f = 1 / (p * np.exp(-u)).sum(1)
        p = n.sum(0) / (n.sum(1)[:, None] * f[:, None] * np.exp(-u)).sum(0)
        p /= p.sum()
    return p


def test_wham_weights(spark, events):
    k, _, there, n, u = windows(events)
    share = dict(zip(there, plain_wham(n, u) / n.sum(0), strict=True))
    expected = {e: share[x] for e, x in zip(events["event_id"], k, strict=True) if x >= 0}
    got = run(spark, "wham_weights")
    assert set(got["event_id"]) == set(expected)
    assert np.allclose(got["w"], [expected[e] for e in got["event_id"]], rtol=1e-6)


def test_dham_weights(spark, events):
    k, i, there, _, u = windows(events)
    c = np.zeros((3, len(there), len(there)))
    for _, rows in events.assign(k=k, i=i)[k >= 0].groupby("user_id"):
        for s, d, w in zip(rows["k"], rows["k"].iloc[1:], rows["i"], strict=False):
            c[w, there.index(s), there.index(d)] += 1
    m = np.zeros(c.shape[1:])
    for s in range(len(there)):
        for d in range(len(there)):
            below = sum(c[w, s].sum() * math.exp(-(u[w, d] - u[w, s]) / 2) for w in range(3))
            m[s, d] = c[:, s, d].sum() / below if below else 0
    rows = m.sum(1, keepdims=True)
    m = np.where(rows > 0, m / np.where(rows > 0, rows, 1), np.eye(len(m)))
    got = run(spark, "dham_weights").sort_values("bin")["w"].to_numpy()
    assert got.sum() == pytest.approx(1)
    assert np.allclose(got @ m, got, atol=1e-10)


def lagged(events, x, lag):
    a, z = [], []
    for _, g in events.groupby("user_id").indices.items():
        a.append(x[g][:-lag])
        z.append(x[g][lag:])
    return np.concatenate(a), np.concatenate(z)


def test_koopman_modes(spark, events):
    x = np.stack([events["value"] / 100, events.groupby("user_id")["value"].cumsum() / 1000], axis=1)
    a, z = lagged(events, x, 1)
    root = lambda c: np.linalg.inv(np.linalg.cholesky(c))
    c = ((a - a.mean(0)).T @ (z - z.mean(0))) / len(a)
    s = np.linalg.svd(root(np.cov(a.T, bias=True)) @ c @ root(np.cov(z.T, bias=True)).T, compute_uv=False)
    got = run(spark, "koopman_modes").sort_values("mode")
    assert np.allclose(got["s"], s, atol=1e-6)
    decays = s < 1 - 1e-9  # a running sum's trend doesn't decay
    assert np.allclose(got["tau"].to_numpy()[decays], -1 / np.log(s[decays]), rtol=1e-4)


def test_stationary_weights(spark, events):
    k = bins_of(events["value"].to_numpy(), 6)
    m = np.zeros((5, 5))
    for _, rows in events.assign(k=k)[k >= 0].groupby("user_id"):
        for s, d in zip(rows["k"], rows["k"].iloc[1:], strict=False):
            m[s, d] += 1
    m /= m.sum(1, keepdims=True)
    got = run(spark, "stationary_weights").sort_values("bin")["p"].to_numpy()
    assert np.allclose(got, np.linalg.matrix_power(m, 200)[0], atol=1e-8)


def test_loaded_fes(spark, events):
    rows = events.assign(i=events["user_id"] % 3)
    rows = pd.concat([g.iloc[5:-1] for _, g in rows.groupby("user_id") if len(g) > 6])
    value = rows["value"].to_numpy()
    k, lo, hi = bins_of(value), value.min(), value.max()
    there = sorted(set(k[k >= 0]))
    middle = lo + (np.array(there) + 0.5) * (hi - lo) / 29
    n = np.array([[((k == x) & (rows["i"] == w)).sum() for x in there] for w in range(3)], float)
    p = plain_wham(n, np.array([1e-5 * (middle - 100.0 * w) ** 2 for w in range(3)]))
    f = -h.BOLTZMANN * 300 * np.log(p / p.max())
    got = run(spark, "loaded_fes").sort_values("bin")
    assert got["bin"].tolist() == there
    assert got["n"].tolist() == [(k == x).sum() for x in there]
    assert np.allclose(got["f"], f, atol=1e-6)


def test_lattice_reduced(spark, vectors):
    got = run(spark, "lattice_reduced").sort_values("vec_id")
    trials = np.array([c for c in product(range(-5, 6), repeat=3) if any(c)])
    for x, reduced in zip(vectors[1], got["reduced"], strict=True):
        cell, new = x[:9].reshape(3, 3), np.stack(reduced)
        op = np.linalg.solve(cell.T, new.T).T
        assert np.allclose(op, np.round(op), atol=1e-6)  # the same lattice
        assert abs(np.linalg.det(op)) == pytest.approx(1)
        assert np.linalg.norm(new, axis=1).min() <= np.linalg.norm(trials @ new, axis=1).min() + 1e-9


def test_descriptor_spectrum(spark, vectors):
    j = [lambda z: math.sin(z) / z, lambda z: math.sin(z) / z**2 - math.cos(z) / z, lambda z: (3 / z**2 - 1) * math.sin(z) / z - 3 * math.cos(z) / z**2]
    legendre = [lambda c: 1.0, lambda c: c, lambda c: (3 * c * c - 1) / 2]
    got = run(spark, "descriptor_spectrum").sort_values("vec_id")
    for x, spectrum in list(zip(vectors[1], got["spectrum"], strict=True))[:10]:
        p = x[:24].reshape(8, 3)
        for i in range(8):
            d = [p[k] - p[i] for k in range(8) if k != i]
            r = [math.sqrt(v @ v) for v in d]
            radial = {(n, order): [j[order]((n + 1) * math.pi * q / 3) * 0.5 * (1 + math.cos(math.pi * q / 3)) if q < 3 else 0.0 for q in r] for n in range(3) for order in range(3)}
            cosine = [[(v @ w) / (a * c) for w, c in zip(d, r, strict=True)] for v, a in zip(d, r, strict=True)]
            expected = [sum(radial[n, o][u] * radial[m, o][v] * legendre[o](cosine[u][v]) for u in range(7) for v in range(7)) for n in range(3) for m in range(n, 3) for o in range(3)]
            assert np.allclose(spectrum[i], expected, atol=1e-6)


def test_polynomial_tails_and_scores():
    metric = Metric((Axis(-2.0, 2.0), Axis(0.0, 2 * math.pi, periodic=True)))
    rng = np.random.default_rng(1)
    x = np.stack([rng.uniform(-2, 2, 60), rng.uniform(0, 2 * math.pi, 60)], axis=1)
    plane = 3 + 2 * (x[:, 0] + 2) / 4 - np.cos(x[:, 1])  # a polynomial in the unrolled dimensions
    fitted = b.interpolant(metric, x, plane, "cubic", degree=1)
    assert np.abs(fitted[0]).max() < 1e-8
    assert np.allclose(b.interpolated(metric, x[:7] + [0, 2 * math.pi], x, fitted, "cubic", 1.0), plane[:7])
    assert b.monomial_powers(2, 2) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
    assert len(b.monomial_powers(2, 1, [False, True])) == 4
    # Leaving a point out without fitting anew is what fitting anew gives.
    y = np.sin(2 * x[:, 0]) + np.cos(x[:, 1])
    z, ones = b.unrolled(metric, x), np.ones((60, 1))
    k = b.kernel_matrix(z, z, "gaussian", 2.0) + 0.01 * np.eye(60)
    errors = []
    for i in range(60):
        keep = np.arange(60) != i
        whole = np.block([[k[np.ix_(keep, keep)], ones[keep]], [ones[keep].T, np.zeros((1, 1))]])
        c = np.linalg.solve(whole, np.append(y[keep], 0))
        errors.append((y[i] - k[i, keep] @ c[:-1] - c[-1]) ** 2)
    assert b.leave_one_out(k, ones, y) == pytest.approx(np.mean(errors), rel=1e-5)
    noisy = y + rng.normal(size=60) * 0.3
    choices = [1e-6, 1e-3, 0.1]
    assert b.best_smoothing(metric, x, noisy, "gaussian", 2.0, 0, choices) == 0.1
    assert b.best_smoothing(metric, x, noisy, "gaussian", 2.0, 0, choices, b.generalised_likelihood) >= 1e-3
    assert b.half_cell_in(0.0, 10.0, 5) == (1.0, 9.0)
    with pytest.raises(ValueError, match="missing"):
        b.added({"energy": F.lit(1.0), "virial": None}, {"energy": F.lit(1.0), "virial": F.array()})


def test_modes_of_angles_and_of_weighed_rows(spark):
    rng = np.random.default_rng(2)
    steps = rng.normal(size=(4000, 2)) * [0.1, 1.0]
    angle = np.cumsum(steps[:, 0])
    slow = np.zeros(4000)
    for k in range(1, 4000):
        slow[k] = 0.9 * slow[k - 1] + steps[k, 1]
    x = np.stack([np.mod(angle, 2 * math.pi), slow], axis=1)
    rows = spark.createDataFrame([(r.tolist(), s.tolist()) for r, s in zip(x[:-1], x[1:], strict=True)], "x array<double>, x_t array<double>")
    model = ko.PeriodicKoopman.fit(rows, "x", "x_t", [0], 2)
    times = model.timescales()
    assert (np.diff(times) <= 0).all()
    assert min(abs(times + 1 / math.log(0.9))) < 3  # the slow dimension's
    assert max(times) > 50  # the angle's
    assert rows.select(F.size(model.f()(F.col("x"))).alias("n")).distinct().collect()[0]["n"] == 3
    again = model.refitted(rows, "x", "x_t")
    assert np.allclose(again.timescales(), times)
    weighed, out = ko.reweighted(rows, "x", "x_t")
    assert out.agg(F.avg("w")).first()[0] == pytest.approx(1, abs=1e-6)
    assert len(weighed.values) == 2
    plain = ko.Koopman.fit(mo.Covariances.of(rows, "x", "x_t"))
    one = ko.Koopman(plain.mean0, plain.mean1, plain.left, plain.right, np.array([1.0, 0.9]))
    assert one.constants() == 1
    assert one.without_constants().values.tolist() == [0.9]
    assert len(ko.Koopman(plain.mean0, plain.mean1, plain.left, plain.right, np.array([0.99, 0.5])).cut(0.1).values) == 1


def test_shrinking_by_the_number_of_rows(spark):
    rng = np.random.default_rng(3)
    few, many = (mo.Covariances(float(n), *(np.zeros(5),) * 2, *(np.cov(rng.normal(size=(n, 5)).T),) * 3) for n in (10, 10_000))
    spread = mo.Covariances(1e6, np.zeros(2), np.zeros(2), *(np.diag([1.0, 100.0]),) * 3)
    assert few.intensity() > 0.3
    assert spread.intensity() < 1e-3
    assert np.allclose(many.shrunk(1.0, "one").c00, np.eye(5) * np.trace(many.c00) / 5)
    empty = spark.createDataFrame([], "x array<double>")
    assert mo.array_moments(empty, "x")[0] == 0


def test_layers_and_types(spark):
    m = np.array(t.orthogonal([[0.0, 1.0, 2.0], [0.5, 0.0, 1.0], [0.0, 0.0, 0.0]]))
    assert np.allclose(m @ m.T, np.eye(3))
    assert np.linalg.norm(t.spectral([[3.0, 0.0], [0.0, 1.0]], 50), 2) == pytest.approx(1, abs=1e-6)
    assert t.first_weights(4, 3, 1) == t.first_weights(4, 3, 1)
    scaled, first = t.learnable_scale(3, 1)
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert rows.select(scaled(first)(F.col("x")).alias("y")).first()["y"] == pytest.approx([first[0], 2 * first[1], 3 * first[2]])
    assert (t.take(0) + t.constant(5.0)).type_of(rows, "x") == "array<double>"
    with pytest.raises(ValueError, match="undone"):
        t.take(0).inverse()


def test_row_structure(spark):
    one, two = spark.createDataFrame([(1, 2.0)], "a int, v double"), spark.createDataFrame([(1, 2)], "a int, v int")
    with pytest.raises(ValueError, match="other columns"):
        ro.stacked([one, two])
    assert ro.single(one).first()["a"] == 1
    with pytest.raises(ValueError, match="not one row"):
        ro.single(ro.stacked([one, one]))
    bad = spark.createDataFrame([([1.0, float("nan")],)], "x array<double>")
    with pytest.raises(Exception, match="finite"):
        ro.finite(bad, ["x"]).collect()


def test_draws_follow_their_chances(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 300).alias("g"), (F.floor(F.col("id") / 300) % 2).cast("double").alias("e"))
    got = Counter(r["e"] for r in h.draw_near(rows, F.col("e"), 1.0, "id", ["g"], seed=4).collect())
    assert sum(got.values()) == 300
    assert got[0.0] / 300 == pytest.approx(1 / (1 + math.exp(-1)), abs=0.08)


def test_thermal_velocities(spark):
    points = spark.range(20_000).select(F.col("id").alias("frame"), F.lit(0).alias("i"), F.lit(2.0).alias("mass"))
    v = np.stack(en.thermal_velocities(points, "mass", 3.0, 1).toPandas()["velocity"])
    assert np.abs(v.mean(0)).max() < 0.03
    assert np.allclose(v.var(0), 1.5, rtol=0.05)


def test_store_keeps_sizes_flags_and_parameters(spark, tmp_path):
    from tessera.sources.store import Store, in_angstrom, load_parameters, save_parameters

    store = Store(spark, f"file://{tmp_path}/store")
    frames = spark.range(5).select(F.lit(0).alias("cv_round"), F.lit(0).alias("round"), (F.col("id") % 2).cast("int").alias("traj"), F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("cv"))
    store.add_round({"cv_round": 0, "round": 0})
    store.append(frames)
    store.set_flag("invalid", True, F.col("traj") == 1)
    store.append(frames.where("traj = 1").withColumn("row_id", F.col("row_id") + 10))
    found = {r["traj"]: (r["size"], r["finished"], r["invalid"]) for r in store.trajectories().collect()}
    assert found == {0: (3, True, False), 1: (4, True, True)}
    assert store.frames().count() == 7
    assert store.counts().first()["rows"] == 7
    assert store.ids(0, 0) == [0, 1]
    assert store.last_row(0, 0, 1).first()["row_id"] == 13
    assert store.add_cv("first", {"a": 1}) == 0
    assert store.add_cv("second", {"a": 2}) == 1
    assert store.cv_parameters(1) == {"a": 2}
    assert store.permanent_bias() is None
    store.add_permanent_bias({"k": 3})
    assert store.permanent_bias() == {"k": 3}
    store.copy_round(1, F.transform("cv", lambda v: v * 2))
    new = store.frames().where("cv_round = 1").orderBy("row_id").collect()
    assert [(r["cv"], r["cv_orig"]) for r in new] == [([2.0 * k], [float(k)]) for k in (0, 2, 4)]
    store.set_round(0, 0, True)
    assert store.rounds().where("round = 0").first()["invalid"]
    store.set_round(0, 0, False)
    assert not store.rounds().where("round = 0").first()["invalid"]
    save_parameters(spark, f"file://{tmp_path}/p", {"x": 1, "y": 2})
    assert load_parameters(spark, f"file://{tmp_path}/p", y=5) == {"x": 1, "y": 5}
    one = spark.createDataFrame([([[1.0, 2.0, 3.0]], [[1.0, 0.0, 0.0]])], "positions array<array<double>>, cell array<array<double>>")
    assert in_angstrom(one, 2.0).first()["positions"] == [[2.0, 4.0, 6.0]]


def test_correlation_times(spark, events):
    from tessera.functions import frames as fr

    got = run(spark, "correlation_times").set_index("user_id")
    for user, rows in list(events.groupby("user_id"))[:5]:
        assert got.loc[user, "by_envelope"] == pytest.approx(fr.envelope_inefficiency(rows["value"].to_numpy()))
        assert got.loc[user, "by_blocks"] == pytest.approx(fr.block_inefficiency(rows["value"].to_numpy()))
    rng = np.random.default_rng(5)
    for a in (0.5, 0.8):  # (1 + a) / (1 - a) for a first-order series
        x = [0.0]
        for _ in range(20_000):
            x.append(a * x[-1] + rng.normal())
        for rule in (fr.inefficiency, fr.envelope_inefficiency, fr.block_inefficiency):
            assert rule(np.array(x)) == pytest.approx((1 + a) / (1 - a), rel=0.25)
    shifted = np.concatenate([np.linspace(50, 0, 2000), rng.normal(size=8000)])
    assert 1000 <= fr.best_start(shifted) <= 4000


def test_correlation_times_read_each_series_once(spark):
    """One grouping for both rules, and block means from a running sum: a size costs n / size, not n."""
    from tessera.functions import frames as fr

    plan = catalogue.queries()["correlation_times"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsIn") == 1
    rng = np.random.default_rng(8)
    for n in (20, 33, 400, 1501):
        x = np.cumsum(rng.normal(size=n)) / 10 + rng.normal(size=n)
        sizes, trials = np.arange(1, max(2, n // 10)), np.geomspace(1, max(2.0, n / 2), 400)
        seen = np.array([b * x[: n // b * b].reshape(-1, b).mean(axis=1).var() / x.var() for b in sizes])
        plain = trials[int(np.argmin([((sizes * g / (sizes + g - 1) - seen) ** 2).sum() for g in trials]))]
        assert fr.block_inefficiency(x) == pytest.approx(plain)


def test_transport_costs(spark, vectors):
    kinds = np.arange(8) % 2
    got = run(spark, "transport_costs").sort_values("vec_id")
    for x, costs in list(zip(vectors[1], got["costs"], strict=True))[:10]:
        p = x[:24].reshape(8, 3)
        for k in range(2):
            q = np.stack([np.cos(np.arange(8) + k), np.sin(np.arange(8) * (k + 1)), np.zeros(8)], axis=1) / 5
            total = 0.0
            for kind in (0, 1):
                c = ((p[kinds == kind][:, None] - q[kinds == kind][None]) ** 2).sum(-1)
                m, u, v = np.exp(-c / 0.1), np.ones(4), np.ones(4)
                for _ in range(5000):
                    u = 0.25 / (m @ v)
                    v = 0.25 / (m.T @ u)
                total += (u[:, None] * m * v * c).sum()
            assert costs[k] == pytest.approx(total, rel=1e-5)


def test_bessel_functions_of_whole_order():
    from tessera.functions.frames import bessel_j

    z, angle = np.array([0.0, 0.3, 2.0, 7.5, 40.0]), (np.arange(20_000) + 0.5) * math.pi / 20_000
    for order in range(5):
        expected = [np.cos(order * angle - x * np.sin(angle)).mean() for x in z]
        assert np.allclose(bessel_j(order, z), expected, atol=1e-9)


def test_study(spark, tmp_path):
    from tessera.operators.fit import whitened
    from tessera.plans.study import Study
    from tessera.sources.store import Store

    store, rng = Store(spark, f"file://{tmp_path}/study"), np.random.default_rng(6)

    def add(k):
        store.add_round({"cv_round": 0, "round": k})
        x = rng.normal(size=(1500, 2))
        store.append(spark.createDataFrame([(0, k, i % 3, i, [float(v) for v in r]) for i, r in enumerate(x)], "cv_round int, round int, traj int, row_id long, cv array<double>"))

    add(0)
    study = Study(store, Metric((Axis(-5.0, 5.0),)), edges=15)
    surface = study.free_energy()
    found = surface.orderBy("bin").toPandas()
    middle = study.midpoints()[found["bin"]]
    plain = h.BOLTZMANN * 300 * middle**2 / 2
    good = np.abs(middle) < 1.5
    assert np.allclose((found["f"] - plain)[good] - np.mean((found["f"] - plain)[good]), 0, atol=0.7)
    bias = study.flattening(surface)
    assert np.corrcoef(bias(middle[good]), -found["f"][good])[0, 1] > 0.95
    seen = study.until_agreed(lambda k, f: add(k + 1), most=3, agreed=5.0)
    assert len(seen) == 1
    assert study.start_frames(None, 1.0, ["traj"]).count() == 3
    study.update_features(whitened(), 1, "white")
    new = np.stack(store.frames().where("cv_round = 1").toPandas()["cv"])
    assert np.allclose(np.cov(new.T), np.eye(2), atol=0.1)
    assert store.cv_parameters(1) == {"lag": 1}


def test_many_centres_are_summed_by_blocks(spark, monkeypatch):
    points = spark.range(50).select("id", (F.col("id") * 9.0).alias("x0"))
    centres = spark.range(40).select((F.col("id") * 12.0).alias("c0"), (F.col("id") % 3 + 1.0).alias("height"))
    metric = Metric((Axis(0.0, 500.0, periodic=True),))

    def found():
        return {r["id"]: r["bias"] for r in b.hills(points, centres, metric, 1, [40.0]).collect()}

    whole = found()
    monkeypatch.setattr(b, "CENTRES", 7)
    assert found() == pytest.approx(whole)


def test_text_files(spark, tmp_path):
    from tessera.sources.store import timescales_in_logs, write_xyz

    frames = spark.createDataFrame([(0, [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]), (1, [[1.0, 1.0, 1.0], [2.0, 2.0, 2.0]])], "row_id long, positions array<array<double>>").coalesce(1)
    write_xyz(frames, f"file://{tmp_path}/xyz", ["C", "H"])
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/xyz").collect()]
    assert lines == ["2", "row 0", "C 0.00000000 1.00000000 2.00000000", "H 3.00000000 4.00000000 5.00000000", "2", "row 1", "C 1.00000000 1.00000000 1.00000000", "H 2.00000000 2.00000000 2.00000000"]
    (tmp_path / "log.txt").write_text("start\ntimescales: [1.5 2e2 3] ns\nend\n")
    assert [r["timescales"] for r in timescales_in_logs(spark, f"file://{tmp_path}/log.txt").collect()] == [[1.5, 200.0, 3.0]]


def test_every_step_of_a_stream_goes_to_the_sink(spark, tmp_path):
    from tessera.streaming.windows import read_events, save_every

    spark.range(20).withColumnRenamed("id", "row_id").write.parquet(f"file://{tmp_path}/in")
    taken = []
    query = save_every(read_events(spark, f"file://{tmp_path}/in"), 5, "row_id", lambda df, epoch: taken.extend(r["row_id"] for r in df.collect()), f"file://{tmp_path}/at")
    query.processAllAvailable()
    query.stop()
    assert sorted(taken) == [0, 5, 10, 15]
