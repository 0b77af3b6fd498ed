"""Centroid clustering against exact integers: ties, close centroids, large components, odd rows."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import centroids


def brute(rows, width=64, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]]
    def of(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [of(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = [(i, *of(v)[::-1]) for i, v in kept]
    return sorted(got), {j: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for j, x in enumerate(c)}


def test_equals_exact_integers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 64).astype(np.float32)]) for i in range(120)]
    rows += [(1000 + i, [float(x) for x in rng.integers(-2, 3, 64) / 1024]) for i in range(40)]  # many ties
    rows += [(2000, [0.5] * 63), (2001, None), (2002, [None] + [0.0] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    got = centroids.clusters(df).collect()
    want, shas = brute(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
    assert {r.cluster: r.centroid_sha256 for r in got} == {j: s for j, s in shas.items() if j in {r.cluster for r in got}}
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)


def test_screening_is_rigorous():
    """Centroids that differ by less than float32 can tell, at every size of the components."""
    rng = np.random.default_rng(3)
    for most in (4, 1000, 1 << 20, 1 << 26):
        base = rng.integers(-most, most + 1, 64)
        c = np.clip(np.stack([base, base, *[base + rng.integers(-1, 2, 64) for _ in range(6)]]), -most, most)
        x = np.clip(base + rng.integers(-2, 3, (500, 64)), -most, most)
        best, distance, several = centroids.nearest(x, c)
        exact = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all() and several > 0
    far = rng.integers(-1000, 1001, (8, 64))
    x = far[rng.integers(0, 8, 500)] + rng.integers(-3, 4, (500, 64))
    assert centroids.nearest(x, far)[2] == 0


def test_few_repeated_and_large(spark):
    same = [(1, [0.25] * 64), (1, [0.25] * 64), (None, [0.5] * 64), (2, [3e38] * 64), (3, [-3e38] * 64)]
    got = centroids.clusters(spark.createDataFrame(same, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 5 and all(r.distance == 0 for r in got)
    assert {(r.vec_id, r.centroid[0]) for r in got} == {(1, 256), (None, 512), (2, centroids.MOST), (3, -centroids.MOST)}
    assert len({r.cluster for r in got if r.vec_id == 1}) == 1
    none = centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.collect() == [] and "inertia" in none.columns


def test_an_empty_cluster_stays(spark):
    x = spark.createDataFrame([(1, [0, 0]), (2, [10, 0])], "vec_id long, v array<int>")
    c = np.array([[0, 0], [0, 0], [9, 1]])
    assert centroids.moved(x, c).tolist() == [[0, 0], [0, 0], [10, 0]]
    down = spark.createDataFrame([(1, [-1, 3]), (2, [-2, 4])], "vec_id long, v array<int>")
    assert centroids.moved(down, np.array([[0, 0]])).tolist() == [[-2, 3]]
