"""Centroid clustering against plain Python that computes every distance."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from votemill.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, own string"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in hashed[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((d(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    by = {}
    for _, j, x in found:
        by[j] = by.get(j, 0) + x
    return sorted(((i, j, x, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, x in found), key=str)


def check(spark, rows, k=4, rounds=3, dims=3):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    got = centroids.clustered(df, k=k, rounds=rounds, dims=dims).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, k, rounds, dims)


def test_clusters_with_ties_and_copies(spark):
    rng = random.Random(1)
    grid = [(i, [rng.randint(-3, 3) / 2 for _ in range(3)]) for i in range(300)]  # many equal distances and equal vectors
    check(spark, grid + [(5, [0.5, 0.5, 0.5])] * 7 + [(i, [1.0, 1.0, 1.0]) for i in range(1000, 1300)], k=9, rounds=4)


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [0.0, -inf, 0.0])]
    good = [(None, [1.0, 2.0, 3.0]), (9, [0.0, 0.0, 0.0]), (9, [-0.001, 0.0, 0.0]), (9, [9.0, 9.0, 9.0]), (10, [400000.0, -400000.0, 1.0])]
    check(spark, odd + good)
    check(spark, good[:2], k=40)
    check(spark, odd)
    check(spark, [])


def test_vector_out_of_reach_has_null_figures(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in centroids.clustered(df, k=2, dims=2).collect()}
    assert set(got) == {1, 2, 3}
    assert list(got[1])[1:] == [None] * 5
    assert got[2]["distance"] == got[3]["distance"] == got[2]["inertia"] == 0
    assert all(r["cluster"] is None for r in centroids.clustered(df.filter("vec_id = 1"), k=2, dims=2).collect())


def test_bounds_skip_distances_and_stay_true():
    rng = np.random.default_rng(2)
    middle = rng.integers(-900, 900, (12, 16))
    v = middle[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 16))
    own, upper, lower = np.zeros(3000, np.int32), np.full(3000, np.inf), np.zeros((3000, 12))
    at, before, computed = v[:12].copy(), None, []
    for _ in range(6):
        computed.append(centroids.Centroids(at, before).assign(v, own, upper, lower).sum())
        exact = np.array([centroids.squares(v, c) for c in at]).T
        assert (own == exact.argmin(1)).all()
        root = np.sqrt(exact.astype(float))
        assert (lower <= root).all() and (upper >= root[np.arange(3000), own]).all()
        before = at
        at = np.array([v[own == j].sum(0) // max((own == j).sum(), 1) if (own == j).any() else at[j] for j in range(12)])
    assert computed[-1] < 0.25 * 3000 * 12


def test_written_rounds_are_discarded(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(200)], "vec_id long, embedding array<float>")
    found, _ = centroids.clusters(df, k=5, dims=2)
    assert found.agg(F.sum("n_distances")).first()[0] < 200 * 5 * 6
    assert {f.rsplit("/", 2)[1].split("-")[0] for f in found.inputFiles()} == {"round5"}


@pytest.mark.parametrize("n", [1, 40])
def test_one_vector_many_times(spark, n):
    check(spark, [(i, [0.25, 0.5, -0.25]) for i in range(n)], k=3)
