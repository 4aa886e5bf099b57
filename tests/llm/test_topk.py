import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import topk as M


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in ok if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=16).round(1)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(100)]
    rows += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2050, []), (2051, [1.0, 2.0]), (None, [1.0] * 16), (2100, [0.0] * 16)]
    data = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = [tuple(r) for r in M.top_k(data, F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_few_rows_and_empty_table(spark):
    data = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in M.top_k(data, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert M.top_k(data.limit(0), F.col("vec_id") == 0).collect() == []


def test_components_of_any_size_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(200 + i, [float(x) for x in rng.normal(size=8) * 10.0 ** rng.integers(0, 14)]) for i in range(60)]
    rows += [(300, [2e6] * 8), (301, [2e6] * 7 + [2e6 + 1 / 256]), (350, [-3e9, 1.0] + [0.0] * 6), (400, [0.5] * 8)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in M.top_k(data, F.col("vec_id") % 50 == 0).collect()]
    want = brute(rows)
    assert any(abs(s) > 1 << 60 for *_, s in want) and set(got) == want


def clustered(rng, n, clusters=40, d=64):
    base = rng.normal(size=(clusters, d)).cumsum(axis=1)
    return np.floor(20 * (base[rng.integers(0, clusters, n)] + 0.1 * rng.normal(size=(n, d))))


def test_bounds_discard_most_pairs_of_clusters():
    c = clustered(np.random.default_rng(1), 20_000)
    exact = c[:20] @ c.T
    np.fill_diagonal(exact, -np.inf)
    want = np.sort(exact, axis=1)[:, -5:]
    held = M.Candidates(np.arange(20_000), c)
    i, ids, score, cold = M.best(np.arange(20), c[:20], held, 5)
    assert (np.sort(score.reshape(20, 5), axis=1) == want).all() and (exact[i, ids] == score).all()
    i, _, score, warm = M.best(np.arange(20), c[:20], held, 5, np.sort(exact[:, :4096], axis=1)[:, -5])
    assert (np.sort(score.reshape(20, 5), axis=1) == want).all()
    assert warm <= cold < 0.2 * 20 * 20_000


def test_unclustered_vectors_and_small_tiles(spark):
    rng = np.random.default_rng(5)
    before, M.TILE, M.HELD = (M.TILE, M.HELD), 64, 200
    try:
        for c in (rng.integers(-50, 50, (700, 5)).astype(float), clustered(rng, 700, 6, 24)):
            exact = c[:30] @ c.T
            np.fill_diagonal(exact, -np.inf)
            i, ids, score, _ = M.best(np.arange(30), c[:30], M.Candidates(np.arange(700), c), 5)
            for q in range(30):
                want = sorted(zip(-exact[q], range(700), strict=True))[:5]
                assert [(-s, j) for j, s in zip(ids[i == q].tolist(), score[i == q].tolist(), strict=True)] == want
    finally:
        M.TILE, M.HELD = before
