"""Long trajectories, tall tables and many centres against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.functions.metric import Axis, Metric
from tessera.operators import correlation, hills
from tessera.operators import moments as mo


def slow(n, rho, seed):
    x, noise = np.zeros(n), np.random.default_rng(seed).normal(0, 1, n)
    for k in range(1, n):
        x[k] = rho * x[k - 1] + noise[k]
    return x


def test_inefficiency_by_blocks_equals_whole_series(spark):
    series = {1: slow(5000, 0.99, 1), 2: slow(300, 0.5, 2), 3: np.arange(700.0), 4: np.full(50, 0.1), 5: np.array([1.0, 2.0]), 6: np.cos(np.arange(2000) / 300), 7: np.array([3.0])}
    rows = [(t, k, float(v)) for t, x in series.items() for k, v in enumerate(x)]
    rows += [(1, 9999, None), (None, 1, 2.0), (8, 1, None)]
    df = spark.createDataFrame([rows[k] for k in np.random.default_rng(0).permutation(len(rows))], "traj int, t int, x double")
    got = correlation.inefficiency(df, "traj", ["t"], "x", 64).toPandas().set_index("traj")
    assert set(got.index) == set(series)
    for t, x in series.items():
        expected = 1.0 if t == 4 else fr.inefficiency(x)
        assert got.loc[t, "n"] == len(x)
        assert abs(got.loc[t, "g"] - expected) < 1e-6 * expected, t
    assert correlation.inefficiency(df.limit(0), "traj", ["t"], "x").count() == 0


def test_rows_are_numbered_in_trajectories(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"traj": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.1, 0.1]), "t": rng.permutation(3000)})
    got = correlation.numbered(spark.createDataFrame(p).repartition(7), "traj", ["t"]).toPandas()
    expected = p.assign(row_no=p.groupby("traj")["t"].rank().astype(int) - 1)
    pd.testing.assert_frame_equal(got.sort_values("t").reset_index(drop=True)[["traj", "t", "row_no"]], expected.sort_values("t").reset_index(drop=True), check_dtype=False)


def test_no_task_holds_a_trajectory(spark):
    """The plan has no grouped Python function, and the sums meet by trajectory and block."""
    df = spark.createDataFrame([(1, k, float(k % 7)) for k in range(500)], "traj int, t int, x double")
    _, chunks = correlation.blocks(df, "traj", ["t"], "x", 64)
    assert chunks.count() == 8
    plan = correlation.lag_sums(chunks, 64, 0, 1)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Window" not in plan


def test_small_singular_values_keep_their_digits(spark):
    rng = np.random.default_rng(7)
    n, d = 3000, 6
    u, _ = np.linalg.qr(rng.normal(size=(n, d)))
    v, _ = np.linalg.qr(rng.normal(size=(d, d)))
    s = np.array([1.0, 1e-2, 1e-4, 1e-6, 1e-8, 1e-10])
    x = u * s @ v.T
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "x array<double>").repartition(40)
    got, directions = mo.singular_values(df, "x")
    assert np.allclose(got, s, rtol=1e-5)
    assert np.allclose(np.abs(np.sum(directions * v, axis=0)), 1, atol=1e-6)
    assert mo.triangular(df, "x")[0] == n
    assert mo.singular_values(df.limit(0), "x")[0].shape == (0,)
    flat = spark.createDataFrame([([float(k), 2.0 * k, 0.0],) for k in range(100)], "x array<double>")
    assert mo.truncated_svd(flat, "x").shape == (3, 1)


def test_hills_of_many_centres(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.uniform(0, 10, (2000, 2)), rng.normal(5, 0.05, (3000, 2)), [[0.0, 0.0], [9.999, -3.0], [10.0, 25.0]]])
    centres = np.concatenate([rng.uniform(0, 10, (4000, 2)), rng.normal(5, 0.05, (6000, 2))])
    height = rng.uniform(0, 2, len(centres))
    p = pd.DataFrame(points, columns=["x0", "x1"]).assign(key=range(len(points)))
    c = pd.DataFrame(centres, columns=["c0", "c1"]).assign(height=height)
    bad = spark.createDataFrame([(None, 1.0, -1), (float("nan"), 1.0, -2)], "x0 double, x1 double, key long")
    axes = Metric((Axis(0.0, 10.0, periodic=True), Axis(0.0, 10.0)))
    at = spark.createDataFrame(p).repartition(16).unionByName(bad)
    of = spark.createDataFrame(c).unionByName(spark.createDataFrame([(None, 0.0, 1.0)], "c0 double, c1 double, height double")).repartition(3)
    got = hills.near_sums(at, "key", of, axes, [0.1, 0.2])
    found = {r["key"]: r["bias"] for r in got.collect()}
    assert len(found) == len(points) + 2 and found[-1] is None and found[-2] is None
    d = points[:, None] - centres[None]
    d[..., 0] -= 10 * np.round(d[..., 0] / 10)
    expected = np.exp(-(d[..., 0] ** 2) / 0.02 - d[..., 1] ** 2 / 0.08) @ height
    assert np.allclose([found[k] for k in range(len(points))], expected, rtol=1e-9, atol=1e-9)
    assert hills.near_sums(at, "key", of.limit(0), axes, [0.1, 0.2]).agg({"bias": "max"}).first()[0] == 0.0
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_chunks_of_hills_are_full_however_rows_lie(spark):
    """Rows of a cell are brought together before they are packed: a chunk a task and cell made pairs without end."""
    rows = spark.range(8000).selectExpr("id % 4 as cell", "id * 1.0D as x0").repartition(50)
    packed = hills.chunked(rows, ["cell"], ["x0"]).selectExpr("cell", "size(x0) n", "explode(x0) x0")
    assert packed.count() == 8000 and packed.where("cast(x0 as long) % 4 <> cell").isEmpty()
    assert packed.agg({"n": "max"}).first()[0] == hills.CHUNK
    assert hills.chunked(rows, ["cell"], ["x0"]).count() <= 4 * -(-2000 // hills.CHUNK) + 4


def test_study_in_two_dimensions(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.operators import histogram as h
    from tessera.plans.study import Study
    from tessera.sources.store import Store

    store, rng, centres = Store(spark, f"file://{tmp_path}/study"), np.random.default_rng(6), {0: -1.0, 1: 1.0}
    kept = []

    def add(k):
        """Frames under a well at a centre of the first feature, over a harmonic surface in both."""
        store.add_round({"cv_round": 0, "round": k})
        x = np.stack([rng.normal(centres[k % 2] / 2, np.sqrt(0.5), 6000), np.mod(rng.normal(0, 1, 6000), 6.0)], axis=1)
        kept.append(x)
        store.append(spark.createDataFrame([(0, k, i % 3, i, [float(v) for v in r]) for i, r in enumerate(x)], "cv_round int, round int, traj int, row_id long, cv array<double>"))

    add(0)
    add(1)
    windows = spark.createDataFrame([(k, centres[k % 2]) for k in range(4)], "win int, centre double")
    well = lambda w, x: 0.5 * (x[0] - w["centre"]) ** 2
    study = Study(store, Metric((Axis(-4.0, 4.0), Axis(0.0, 6.0, periodic=True))), 2, 17, [(-4.0, 4.0), (0.0, 6.0)], windows, {"well": well})
    surface = study.free_energy()
    found = surface.toPandas()
    assert len(found) < 16 * 16 and set(found["bin"]) == set(found["i0"] * 16 + found["i1"])
    x0, x1 = study.midpoints()[found["i0"]], study.midpoints(1)[found["i1"]]
    x1 = np.where(x1 > 3, x1 - 6, x1)
    good = (np.abs(x0) < 1.4) & (np.abs(x1) < 1.4)
    off = (found["f"] - h.BOLTZMANN * 300 * (x0**2 + x1**2) / 2)[good]
    assert good.sum() > 20 and np.abs(off - off.mean()).max() < 0.9
    bias = study.flattening(surface)
    assert np.corrcoef(bias(np.stack([x0, x1], axis=1)[good]), -found["f"][good])[0, 1] > 0.95

    points = spark.createDataFrame([(k, float(a), float(c)) for k, (a, c) in enumerate(zip(x0, np.mod(x1, 6), strict=True))] + [(-1, None, 1.0), (-2, 99.0, 3.0), (-3, 0.25, 6.0 + 0.1875)], "k int, x0 double, x1 double")
    energy = {r["k"]: r["energy"] for r in study.energies(points, surface, 12.0).collect()}
    assert np.allclose([energy[k] for k in range(len(found))], np.maximum(-found["f"], -12.0))
    assert energy[-1] is None and energy[-2] == -12.0
    at = found.set_index(["i0", "i1"])["f"]
    assert np.isclose(energy[-3], -at[(8, 0)])
    assert len(study.until_agreed(lambda k, f: add(k + 2), most=2, agreed=5.0)) == 1
    assert study.rows().select(F.max("x1")).first()[0] < 6


def test_padded_blocks_equal_single_frames(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frames = [rng.uniform(-1.5, 1.5, (n, 3)) for n in (1, 2, 3, 5, 8, 8, 13, 4, 7)]
    rows = [(k, x.tolist(), "kept") for k, x in enumerate(frames)] + [(-1, None, None), (-2, [], "kept"), (-3, [[1.0, None, 2.0]], "kept")]
    df = spark.createDataFrame(rows, "id int, atoms array<array<double>>, spectrum string").coalesce(1)
    for block in (1 << 20, 300):
        monkeypatch.setattr(fr, "BLOCK", block)
        got = {r["id"]: r["spectrum"] for r in fr.per_block(df, "atoms", fr.bessel_spectra, "spectrum", 3).collect()}
        assert got[-1] is None and got[-3] is None and got[-2] == []
        for k, x in enumerate(frames):
            assert np.allclose(got[k], fr.bessel_spectrum(x), atol=1e-10)


def test_a_later_version_counts_whatever_the_clock_says(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/clocks")
    store.add_round({"cv_round": 0, "round": 0, "temperature": 300.0})
    path = f"{store.root}/rounds"
    ahead = spark.read.parquet(path).withColumn("temperature", F.lit(310.0)).withColumn("version", F.col("version") + F.expr("interval 1 day"))  # by a driver whose clock is ahead
    ahead.write.mode("append").parquet(path)
    assert store.rounds().first()["temperature"] == 310.0
    store.set_round(0, 0, True)
    assert store.rounds().first()["invalid"]
    store.set_round(0, 0, False)
    assert not store.rounds().first()["invalid"] and store.rounds().first()["temperature"] == 310.0
    store.add_permanent_bias({"k": 1})
    store.add_permanent_bias({"k": 2})
    assert store.permanent_bias() == {"k": 2}
    assert spark.read.parquet(path).select("version").distinct().count() == 4


def planted(seed=4, p=8, n=6000):
    rng = np.random.default_rng(seed)
    q = np.eye(p)
    for i in range(p - 1):
        q[i, i + 1] = q[i + 1, i] = -0.4
    return rng.multivariate_normal(np.zeros(p), np.linalg.inv(q), n) * 10.0 ** rng.integers(-3, 4, p)


def test_scaled_precision_reaches_the_least_objective():
    """At the end no slope of the objective is left: of scales, of links, and within the penalty where there is no link."""
    from tessera.operators.precision import objective, scaled_precision

    c = np.corrcoef(planted().T)
    for penalty, alpha in ((0.05, 0.0), (0.2, 0.1), (0.0, 0.0), (5.0, 0.0)):
        r, d = scaled_precision(c, penalty, alpha)
        assert np.allclose(np.diag(r), 1) and np.linalg.eigvalsh(r).min() > 0
        assert np.allclose(d * ((r * c) @ d), 1 - alpha, atol=1e-7)
        slope = 2 * (c * np.outer(d, d) - np.linalg.inv(r))
        off = ~np.eye(len(c), dtype=bool)
        there = off & (r != 0)
        assert np.allclose(slope[there] + 2 * penalty * np.sign(r[there]), 0, atol=1e-6)
        assert (np.abs(slope[off & (r == 0)]) <= 2 * penalty + 1e-6).all()
        best, rng = objective(r, d, c, penalty, alpha), np.random.default_rng(0)
        for _ in range(200):
            near = rng.normal(0, 1e-3, r.shape)
            near = r + np.where(off, near + near.T, 0)
            assert objective(near, d * np.exp(rng.normal(0, 1e-3, len(d))), c, penalty, alpha) > best - 1e-9
    assert np.allclose(scaled_precision(c, 0.0)[0] * np.outer(*[scaled_precision(c, 0.0)[1]] * 2), np.linalg.inv(c), atol=1e-6)
    assert np.allclose(scaled_precision(c, 5.0)[0], np.eye(8))


def test_partial_links_by_group(spark):
    from tessera.operators.precision import partial_links

    x = planted()
    names = [f"v{k}" for k in range(8)]
    rows = pd.DataFrame(x, columns=names).assign(g=["a", None] * 3000, w=1.0)
    rows.loc[len(rows)] = [*[np.nan] * 8, "c", 1.0]
    rows["v7"] = np.where(rows["g"] == "a", rows["v7"], 3.0)
    df = spark.createDataFrame(rows).withColumn("v0", F.nanvl("v0", F.lit(None).cast("double")))
    got = partial_links(df, names, ["g"], penalty=0.1).toPandas()
    assert len(got) == 2 * 28 and set(got["n"]) == {3000}
    one = got[got["g"] == "a"]
    chain = one["j"] == one["i"] + 1
    assert (one[chain]["partial"] > 0.25).all() and (one[~chain]["partial"].abs() < 0.02).all()
    other = got[(got["g"] != "a") & (got["j"] == 7)]
    assert (other["partial"] == 0).all() and other["precision"].isna().all()
    weighted = partial_links(df.where("g = 'a'"), names, weight="w", penalty=0.1).toPandas()
    assert np.allclose(weighted["partial"], one["partial"], atol=1e-6) and list(weighted.columns) == ["n", "i", "j", "c", "partial", "precision"]
    assert partial_links(df.limit(0), names).count() == 0
    assert partial_links(df.where("g = 'a'"), ["v0"]).count() == 0  # no pairs


def test_soft_steps_set_planted_groups_apart(spark):
    from tessera.operators.fit import soft_steps, steps_apart

    rng = np.random.default_rng(8)
    centres = np.array([[0.0, 0.0, 0.0], [3.0, 0.0, 2.8], [0.0, 3.0, -2.8]])
    label = rng.integers(0, 3, 3000)
    x = centres[label] + rng.normal(0, 0.35, (3000, 3))
    x[:, 2] = (x[:, 2] + np.pi) % (2 * np.pi) - np.pi
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "label": label}))
    f = soft_steps(5, 2, "label", [False, False, True]).fit(df, "x", None)
    got = np.array(df.select(f(F.col("x")).alias("y")).toPandas()["y"].tolist())
    assert np.allclose(np.cov(got.T), np.eye(2), atol=1e-2)
    middle = np.array([got[label == k].mean(0) for k in range(3)])
    nearest = np.linalg.norm(got[:, None] - middle, axis=2).argmin(1)
    assert (nearest == label).mean() > 0.995
    # one input: the score is the largest ratio of all combinations; more inputs: no move lowers it
    a, b = rng.normal(size=(200, 6)), rng.normal(size=(20, 6))
    total, between = a.T @ a / 200, b.T @ b / 60
    most = np.linalg.eigvals(np.linalg.solve(total, between)).real.max()
    assert abs(steps_apart(between, total, 6, 1)[2][-1] - most) < 1e-8
    _, _, scores = steps_apart(between, total, 2, 2)
    assert len(scores) > 2 and (np.diff(scores) >= 0).all()
    # a slow flip between two sides, and lagged partners instead of labels
    side = np.cumsum(rng.random(4000) < 0.01) % 2 * 4.0
    series = np.stack([rng.normal(0, 2, 4000), side + rng.normal(0, 0.3, 4000)], axis=1)
    lagged = spark.createDataFrame(pd.DataFrame({"x": series[:-1].tolist(), "y": series[1:].tolist()}))
    slow_f = soft_steps(4, 1).fit(lagged, "x", "y")
    got = np.array(lagged.select(slow_f(F.col("x")).alias("y")).toPandas()["y"].tolist())[:, 0]
    assert abs(np.corrcoef(got, side[:-1])[0, 1]) > 0.98


def test_transforms_are_written_down(spark):
    from tessera.functions import transforms as t

    df = spark.createDataFrame([([0.3, -1.2, 2.0],), ([5.0, 0.1, -0.7],)], "x array<double>")
    f = t.min_max([0.0, -2.0, np.float64(-1.0)], [5.0, 1.0, 3.0]) * (t.take(np.int64(1), 0) + t.activation("tanh", alpha=0.1) * t.part(2, 1)) * t.linear([[1.0, 2.0], [0.5, 1.0], [3.0, -1.0]], [0.1, 0.2]) * t.leak(t.clip(-1.0, 1.0), 0.2)
    again = t.from_json(f.to_json())
    assert again.to_json() == f.to_json()
    got = df.select(f(F.col("x")).alias("a"), again(F.col("x")).alias("b")).collect()
    assert all(r["a"] == r["b"] and len(r["a"]) == 2 for r in got)
    g = t.from_json((t.shift(1.0, 2.0, 3.0) * t.scale(2.0, 4.0, 8.0)).inverse().to_json())
    assert df.select(g(F.col("x")).alias("y")).first()["y"] == [0.3 / 2 - 1, -1.2 / 4 - 2, 2.0 / 8 - 3]
    free = t.of_function(lambda x: x)
    assert (free * t.shift(1.0)).spec is None and t.leak(free, 0.1).spec is None
    with pytest.raises(ValueError):
        free.to_json()
    with pytest.raises(KeyError):
        t.from_json('["eval", ["1"], {}]')


def test_fitted_features_outlive_a_session(spark, tmp_path):
    from tessera.operators.fit import whitened
    from tessera.plans.study import Study
    from tessera.sources.store import Store

    store, rng = Store(spark, f"file://{tmp_path}/kept"), np.random.default_rng(2)
    store.add_round({"cv_round": 0, "round": 0})
    store.append(spark.createDataFrame([(0, 0, i % 3, i, rng.normal(size=2).tolist()) for i in range(300)], "cv_round int, round int, traj int, row_id long, cv array<double>"))
    with pytest.raises(KeyError):
        store.features(1)
    Study(store, Metric((Axis(-5.0, 5.0),))).update_features(whitened(), 1, "white")
    f = Store(spark, f"file://{tmp_path}/kept").features(1)
    kept = store.frames().where("cv_round = 1").select("cv", f(F.col("cv_orig")).alias("again")).toPandas()
    assert len(kept) == 300 and np.allclose(np.stack(kept["cv"]), np.stack(kept["again"]))
