"""Similar vectors: bounds between partitions, and pairs at the limit."""

from __future__ import annotations

import numpy as np

from telemill.llm import similar_vectors


def _clustered(spark, n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 2, dim))
    x = np.concatenate([base, base + 0.01 * rng.normal(size=base.shape)]).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")


def test_bounds_between_partitions_hide_nothing(spark):
    """One curve: the lists are the same however many partitions it is cut into."""
    _, df = _clustered(spark, 4000)
    one = lambda rows: sorted((r["id"], r["neighbour"]) for r in similar_vectors.nearest(df, "id", "v", dim=16, dims=3, curves=1, block=64, reach=2, rows_per_partition=rows).where("rank = 1").collect())
    whole, cut = set(one(10**9)), set(one(500))
    assert len(whole & cut) >= 0.98 * len(whole)


def test_pairs_at_the_limit_are_decided_exactly(spark):
    dim = 128
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for i in range(40):
        a = rng.normal(size=dim)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dim)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9 + (i - 20) * 1e-5
        x, y = a.astype(np.float32), (c * a + np.sqrt(1 - c * c) * b).astype(np.float32)
        rows += [(2 * i, x.tolist()), (2 * i + 1, y.tolist())]
        x, y = x.astype(np.float64), y.astype(np.float64)
        if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
            want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = similar_vectors.close_pairs(similar_vectors.nearest(df, "id", "v"), 0.9, df, "id", "v")
    assert {tuple(r) for r in got.collect()} == want and 0 < len(want) < 40


def test_codes_keep_cosines(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 128))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    v = similar_vectors._decoded(similar_vectors._codes(u)).astype(np.float64)
    assert np.abs(u @ u.T - v @ v.T).max() < similar_vectors.code_error(128)
