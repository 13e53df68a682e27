"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, topk


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(250, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.15
    chain = [rng.normal(size=16)]
    for _ in range(20):
        chain.append(chain[-1] + rng.normal(size=16) * 0.2)
    return np.concatenate([base, near, np.array(chain), base[:40], 3 * base[40:60]])


def frame(spark, x, more=()):
    rows = [(i, [float(v) for v in row], 1, 2, 3.0) for i, row in enumerate(x)] + [(i, v, 1, 2, 3.0) for i, v in more]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int, x int, tile double")


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16), (None, [1.0] * 16), (9006, [])]


@pytest.mark.parametrize("block", [2048, 50])
def test_links_equal_brute_force(spark, planted, block):
    got = embeddings.near_duplicates(frame(spark, planted, ODD), 0.95, block).toPandas()
    u = planted / np.linalg.norm(planted, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(u))
    while True:
        new = np.array([min(label[i], label[hit[i]].min(initial=len(u))) for i in range(len(u))])
        if (new == label).all():
            break
        label = new
    mine = got[got.vec_id < len(u)].sort_values("vec_id")
    assert hit.sum() > 100
    assert (mine.n_links.to_numpy() == hit.sum(axis=1)).all()
    assert (mine.component_id.to_numpy() == label).all()
    rest = got[~(got.vec_id < len(u))]
    assert len(rest) == len(ODD)
    assert (rest.n_links == 0).all()
    assert rest.kept.all()


def test_links_of_nothing(spark):
    assert embeddings.near_duplicates(frame(spark, [])).count() == 0
    assert embeddings.near_duplicates(frame(spark, [], ODD)).count() == len(ODD)


def test_top_k_equals_brute_force(spark, planted):
    x = np.concatenate([planted, planted[:5]])
    got = topk.search(frame(spark, x, ODD), F.col("vec_id") % 20 == 0).toPandas()
    q = np.floor(1024 * x)
    expected = []
    for i in range(0, len(x), 20):
        s = q @ q[i]
        others = np.delete(np.arange(len(x)), i)
        for r, j in enumerate(others[np.lexsort((others, -s[others]))][:10]):
            expected.append((i, r + 1, j, int(s[j])))
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == sorted(expected)


def test_top_k_of_few_and_of_large_values(spark):
    few = frame(spark, [[1e6, 1.0], [2e6, -1.0], [3.0, 4.0], [1e12, 5.0]])
    got = topk.search(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 2**63 - 1), (1, 1024**2 * (2 * 10**12 - 1)), (2, 1024**2 * (3 * 10**6 + 4))]
    assert topk.search(frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0


def test_bounds_prune_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 10
    rows = np.floor(1024 * (np.repeat(centres, 64, axis=0) + rng.normal(size=(2560, 16)) * 0.1))
    blocks = topk.Blocks(np.arange(2560), rows)
    for k in range(20):
        ids, scores = blocks.best(k, rows[k], 10)
        s = rows @ rows[k]
        others = np.delete(np.arange(2560), k)
        assert ids.tolist() == others[np.lexsort((others, -s[others]))][:10].tolist()
    assert blocks.scored < 20 * 40 / 2
