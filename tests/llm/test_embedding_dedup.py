import math

import numpy as np
import pytest

from offerweave.llm import embedding_dedup as ed


def vectors(n, rng, dim=64):
    centres = rng.standard_normal((n // 3 + 1, dim))
    return (centres[rng.integers(0, len(centres), n)] + rng.choice([0.0, 0.1, 0.2, 0.24], (n, 1)) * rng.standard_normal((n, dim))).astype(np.float32)


def brute(rows, least=0.95):
    ok = [v is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least_id = {}
    for i, (x, _) in enumerate(rows):
        least_id[find(i)] = x if x is None else min(least_id.get(find(i), x), x)
    return [(x, links[i], least_id[find(i)], x is not None and x == least_id[find(i)]) for i, (x, _) in enumerate(rows)]


@pytest.mark.parametrize("leaf", [1_000, 40])
def test_against_brute_force(spark, leaf):
    rng = np.random.default_rng(2)
    v = [x.tolist() for x in vectors(420, rng)]
    rows = list(enumerate(v)) + [(1000 + i, v[i]) for i in range(30)] + [(2000, v[5]), (2000, v[5])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] + [1.0] * 63), (3004, [None] + [1.0] * 63), (3005, [float("inf")] * 64), (None, v[0])]
    rows += [(4000, [1.0, 2.0]), (4001, [1.0, 2.0001]), (4002, [-1.0, 2.0]), (4003, [1e-30, 2e-30]), (4004, [-0.0, 1.0]), (4005, [0.0, 1.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted(map(tuple, ed.embedding_dedup(df, leaf=leaf).collect()), key=str)
    rows = [(i, x and [y if y is None else float(np.float32(y)) for y in x]) for i, x in rows]
    assert got == sorted(brute(rows), key=str)


def test_recall_of_deep_trees():
    """Links near the threshold, with leaves far smaller than in production."""
    rng = np.random.default_rng(3)
    x = ed.unit(vectors(12_000, rng))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    f = ed.Forest(64, len(x), 0.95, leaf=10)
    assert f.depth >= 10 and len(f.trees) >= 6
    found = np.zeros(len(a), bool)
    for t in f.trees:
        nodes, cuts = t.fit(t.projections(x), 0, 0, f.depth)
        t.threshold[nodes] = cuts
        row, leaf = t.route(x)
        held = np.zeros((len(x), 1 << t.depth), bool)
        held[row, leaf] = True
        found |= (held[a] & held[b]).any(1)
    assert len(a) > 3_000 and found.mean() > 0.999


def test_lower_levels_fitted_by_node(spark, monkeypatch):
    """A sample that reaches half of the levels, partitions of many buckets, two lengths."""
    monkeypatch.setattr(ed.packed, "MOST_PARTS", 7)
    rng = np.random.default_rng(4)
    x, y = vectors(2_500, rng), vectors(600, rng, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v.tolist()) for i, v in enumerate(y)]
    f = ed.Forest(64, len(x), 0.95, leaf=5, sample=256)
    assert 0 < f.top < f.depth - 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: r.n_links for r in ed.embedding_dedup(df, leaf=5, sample=256).collect()}
    want = {}
    for first, v in ((0, x), (10_000, y)):
        u = ed.unit(v)
        same = (u[:, None] * u[None]).sum(2) >= 0.95 if len(u) < 700 else u @ u.T >= 0.95
        want |= {first + i: int(n) - 1 for i, n in enumerate(same.sum(1))}
    assert got.keys() == want.keys() and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values()) > 2_000


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.embedding_dedup(df).count() == 0
    assert ed.embedding_dedup(spark.createDataFrame([(1, None)], df.schema)).collect() == [(1, 0, 1, True)]
