"""Operators that keep state in tables, against numpy and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import reweight as rw
from tessera.operators import sparse
from tessera.sources.shared import cut
from tests.test_models import SF


def windows(k=50, n=20_000, seed=3):
    rng = np.random.default_rng(seed)
    u = np.array([0.5 * 0.01 * (np.arange(k) - c) ** 2 for c in (8, 25, 42)])
    f = 2 * np.sin(np.arange(k) / 6)
    shares = np.exp(-f - u)
    return np.array([rng.multinomial(n, s / s.sum()) for s in shares]), u, f


def test_sparse_histograms_equal_the_dense_solver(spark):
    n, u, f = windows()
    there = [(i, k) for i, k in np.ndindex(n.shape) if n[i, k]]
    seen = spark.createDataFrame([(i, k, float(-u[i, k])) for i, k in there], "i int, k int, log_u double")
    counts = spark.createDataFrame([(i, k, int(n[i, k])) for i, k in there], "i int, k int, n long")
    found = sparse.solve(sparse.pairs(seen, counts), tol=1e-10)
    want, _ = rw.wham(n.astype(float), np.where(n > 0, u, np.inf))
    got = found.bins().toPandas().set_index("k")
    assert found.converged and found.steps < 100
    assert np.abs(got["p"] / want[got.index] - 1).max() < 1e-8
    shape = got["f"] - f[got.index]
    assert (shape - shape.median()).abs()[got["p"] > 0.005].max() < 0.1
    w = found.weights().toPandas()
    assert np.allclose(np.exp(w["log_w"]), got["p"][w["k"]].to_numpy() * np.exp(u[w["i"], w["k"]]))


def test_dham_likelihood(spark):
    """A chain under three biases: the unbiased shares come back, and moves beyond the kept neighbours don't count."""
    rng = np.random.default_rng(5)
    rows, base = [], np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    u = np.array([np.zeros(5), 0.5 * np.arange(5), 0.4 * np.arange(5)[::-1]])
    for i in range(3):
        p = base * np.exp(-u[i])
        for src, c in enumerate(rng.multinomial(200_000, p / p.sum())):
            t = np.array([0.1, 0.8, 0.1])
            for d, m in zip((-1, 0, 1), rng.multinomial(c, t), strict=True):
                rows.append((i, src, (src + d) % 5, int(m)))
    moves = spark.createDataFrame(rows, "i int, src int, dst int, c long")
    seen = spark.createDataFrame([(i, k, float(-u[i, k])) for i in range(3) for k in range(5)], "i int, k int, log_u double")
    found = sparse.dynamic(moves, seen, tol=1e-10)
    p = found.solution.bins().orderBy("k").toPandas()["p"].to_numpy()
    assert np.abs(p - base).max() < 0.005
    c = np.zeros((5, 5))
    for _, a, b, m in rows:
        c[a, b] += m
    t = found.moves.toPandas()
    assert np.allclose(np.exp(t["log_t"]), (c / c.sum(1, keepdims=True))[t["src"], t["dst"]])
    one = sparse.dynamic(moves, seen, neighbours=1).moves.toPandas()
    assert (one["src"] == one["dst"]).all() and np.allclose(one["log_t"], 0)

    from tessera.catalogue import queries

    out = queries()["dham_likelihood"](spark, SF).toPandas()
    assert abs(out["p"].sum() - 1) < 1e-9 and (out["neighbours"].dropna() <= 20).all() and np.allclose(out["chance"].dropna(), 1) and out["f"].min() == 0


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(2)
    rows = []
    for traj in range(12):
        x = np.cumsum(rng.normal(size=(60, 2)), axis=0)
        rows += [(traj * 100 + k, traj, k, traj % 2, float(a), float(b), 900.0 if (traj, k) == (3, 40) else 300.0, float(k)) for k, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, traj int, t int, win int, a double, b double, heat double, act double")


def test_loader_keeps_what_belongs_together(spark, frames):
    from tessera.plans.loader import Loader

    known = spark.createDataFrame([(0, 0.0), (1, 2.0)], "win int, at double")
    loader = Loader("traj", ["t"], "id", ["a", "b"], "win", known, {"pull": lambda w, x: 0.01 * (x[0] - w["at"]) * (x[0] - w["at"])}, edges=7, skip=5, lag=3, least=2, temperature="heat", hottest=500.0, action="act")
    source = frames.toPandas().set_index("id")
    out = loader.load(frames).toPandas()
    assert 3 not in set(out["traj"]) and (out["t"] >= 5).all() and (out["t"] <= 56).all()
    assert np.allclose(out["a_t"], source["a"][out["id"] + 3]) and np.allclose(out["b_t"], source["b"][out["id"] + 3])
    assert np.allclose(out["bias_pull"], 0.01 * (out["a"] - 2.0 * out["win"]) ** 2) and np.allclose(out["bias"], out["bias_pull"])
    assert abs(out["w"].sum() - 1) < 0.2 and (out.groupby("bin")["w"].nunique() == 1).all() and (out.groupby("bin").size() >= 2).all()
    assert np.allclose(out["w_dyn"], np.exp(3.0))
    p = out.groupby("bin").agg(p=("w", "sum"), f=("f", "first"))
    assert np.allclose(p["f"], np.log(p["p"].max()) - np.log(p["p"]))
    drawn = loader.load(frames, 4000, select="bins").toPandas()
    assert list(drawn.sort_values("m")["m"]) == list(range(1, 4001))
    per_bin = drawn.groupby("bin").size()
    assert per_bin.max() - per_bin.min() <= out.groupby("bin").size().max() + 1
    # draws with their weights stand for all frames
    assert abs((drawn["w"] * drawn["rho"]).sum() - out["w"].sum()) < 0.03
    assert abs((drawn["w"] * drawn["rho"] * drawn["a"]).sum() - (out["w"] * out["a"]).sum()) < 0.2
    low = Loader(**{**loader.__dict__, "most": 1.0, "wall": F.when(F.col("a") > 0, 50.0).otherwise(0.0)}).load(frames, 300).toPandas()
    assert (low["f"] < 1.0).all() and (low["a"] <= 0).all()


def crowd(spark, frames, n=5, seed=1, move=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        cell = [[2.0, 0.0, 0.0], [0.4, 1.9, 0.0], [0.2, -0.3, 2.1]]
        rows += [(f, cell, i, i % 2, [float(v) for v in p]) for i, p in enumerate(rng.uniform(-1, 4, size=(n, 3)))]
    shift = np.random.default_rng(seed + 1)
    return spark.createDataFrame([(f, c, i, k, [v + (move * float(shift.normal()) if f % 3 == 0 else 0.01) for v in p]) for f, c, i, k, p in rows], "frame int, cell array<array<double>>, i int, kind int, p array<double>")


def plain_edges(rows, r):
    """By points as given: shifts, vectors and lengths of all pairs closer than r."""
    from itertools import product

    out = {}
    for a in rows:
        for b in rows:
            if a["frame"] == b["frame"]:
                cell = np.array(a["cell"])
                low = np.round((np.array(a["p"]) - np.array(b["p"])) @ np.linalg.inv(cell)).astype(int)
                for s in product(range(-2, 3), repeat=3):
                    shift = low + s
                    d = np.array(b["p"]) + shift @ cell - np.array(a["p"])
                    if np.linalg.norm(d) < r and (a["i"] != b["i"] or shift.any()):
                        out[a["frame"], a["i"], b["i"], tuple(shift.tolist())] = d
    return out


def test_kept_edges_follow_motion(spark, tmp_path):
    """Only frames that moved far are made again; untouched parts keep their files; edges equal those from scratch."""
    from tessera.sources.edges import EdgeTable

    table = EdgeTable(spark, f"file://{tmp_path}/kept", 1.2, 0.3, 8)
    old, new = crowd(spark, 12), crowd(spark, 12, move=0.5)
    table.build(old)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("part-*")}
    stale = {(r["frame"], r["part"]) for r in table.stale(new).collect()}
    assert {f for f, _ in stale} == {0, 3, 6, 9}
    assert table.update(old) == 0 and table.update(new) == 4
    gone = {p for p in stamps if not p.exists()}
    assert gone and {int(p.parent.name.split("=")[1]) for p in gone} == {k for _, k in stale}
    got = {(r["frame"], r["i"], r["j"], tuple(r["image"])): r["d"] for r in table.edges(new).collect()}
    want = plain_edges(new.collect(), 1.2)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    more = crowd(spark, 14, move=0.5)  # two frames that were not there
    assert table.update(more) == 2 and table.stale(more).count() == 0


def test_motifs_are_found_once(spark, monkeypatch):
    from tessera.operators import environments as en
    from tessera.operators import motifs

    rows = crowd(spark, 2)
    edge = cut(en.edges(rows, 1.3))
    key = {(r["frame"], r["i"], r["j"], tuple(r["image"])) for r in edge.collect()}
    assert len(key) == len(plain_edges(rows.collect(), 1.3))
    at = {}
    for f, i, j, s in key:
        at.setdefault((f, i), []).append((j, s))
    want = {(f, i, *sorted([x, y])[0], *sorted([x, y])[1]) for (f, i), near in at.items() for x in near for y in near if x != y}
    for block in (64, 2):  # neighbours in one block, and in many
        monkeypatch.setattr(motifs, "BLOCK", block)
        got = [(r["frame"], r["i"], r["a"], tuple(r["image_a"]), r["b"], tuple(r["image_b"])) for r in motifs.triples(edge).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        quads = motifs.quads(edge).collect()
        plus = lambda s, t: tuple(x + y for x, y in zip(s, t, strict=True))
        chains = 0
        for (f, b), near in at.items():
            for c, sc in near:
                chains += sum((a, sa) != (c, sc) and (d, plus(sc, sd)) != (b, (0, 0, 0)) and (a, sa) != (d, plus(sc, sd)) for a, sa in near for d, sd in at[f, c])
        assert len(quads) == chains // 2 == len({(r["frame"], r["a"], r["b"], r["c"], r["d"], *map(tuple, (r["image_a"], r["image_c"], r["image_d"]))) for r in quads})
    rings = motifs.rings(edge).collect()
    closed = sum((c, tuple(y - x for x, y in zip(s, t, strict=True))) in at[f, b] for (f, a), near in at.items() for b, s in near for c, t in near if (b, s) != (c, t))
    assert len(rings) == closed // 6
    assert motifs.of_kinds(edge, lambda k: k == 0).where("kind_i + kind_j > 0").count() == 0


def test_spectra_of_high_order(spark):
    """Sums over neighbour pairs with Legendre polynomials, orders 0 to 6; and the functions near 0."""
    from tessera.operators import environments as en

    edge = cut(en.edges(crowd(spark, 1), 1.4))
    got = {(r["i"], r["kind_a"], r["kind_b"]): r["spectrum"] for r in en.power_spectrum(edge, en.bessel_radial(1.4), 2, 6).collect()}
    near = edge.toPandas()
    for (i, ka, kb), values in got.items():
        a, b = (near[(near["i"] == i) & (near["kind_j"] == k)] for k in (ka, kb))
        da, db = (np.stack(x["d"].to_numpy()) for x in (a, b))
        cosine = da @ db.T / np.outer(a["r"], b["r"])
        want = []
        for order in range(7):
            legendre = np.polynomial.legendre.legval(cosine, [0] * order + [1])
            r = {n: (en.bessel_radial(1.4)(a["r"].to_numpy(), n, order), en.bessel_radial(1.4)(b["r"].to_numpy(), n, order)) for n in range(2)}
            want += [(r[n][0][:, None] * r[m][1][None, :] * legendre).sum() * (1 if ka == kb else 2**0.5) for n in range(2) for m in range(n, 2)]
        assert np.allclose(values, want, atol=1e-10)
    x = np.array([1e-8, 0.1, 1.9, 2.1, 7.0])
    for modified in (False, True):
        low, mid, high = (en.spherical(x, n, modified) for n in (3, 4, 5))
        assert np.allclose(low - high if modified else low + high, 9 / x * mid, rtol=1e-8, atol=1e-12)
