"""The M-tree search computes few distances where vectors have clusters, and is exact on copies, ties, repeats and empty tables."""

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, v string, tree int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v], "v", 1) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)], SCHEMA)


def brute(z, ids, queries, k=5):
    out = {}
    for q in queries:
        s = z @ z[q]
        out[ids[q]] = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return out


def results(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_few_distances_where_vectors_have_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 64))
    v = (centres[rng.integers(0, 30, 3_000)] + 0.05 * rng.normal(size=(3_000, 64))).astype("f4")
    q, trees = mtree.index(frame(spark, v), tree=100, page=16)
    asked = q.where("vec_id % 50 = 0")
    z = np.floor(256 * v.astype("f8")).astype("i8")
    assert results(mtree.top_k(asked, trees, 5)) == brute(z, np.arange(3_000), range(0, 3_000, 50))
    per_query = mtree.searched(asked, trees, 5, 16).where("vec_id is null").groupBy("query_id").agg(F.sum("looked").alias("n")).collect()
    assert len(per_query) == 60 and np.mean([r.n for r in per_query]) < 0.3 * 3_000
    every = spark.read.schema(trees.schema).parquet(*trees.inputFiles()).first()
    assert len(mtree.loaded(every.directory)[0]) > 20  # trees of small balls, most of them skipped


def test_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 4)).astype("f4")
    v[::3] = v[0]
    ids = np.arange(400)
    ids[350:] = 7  # one id for many rows
    q, trees = mtree.index(frame(spark, v, ids), tree=32, page=8)
    z = np.floor(256 * v.astype("f8")).astype("i8")
    got = results(mtree.top_k(q.where("vec_id % 50 = 0"), trees, 5, block=3))
    assert got == brute(z, ids, range(0, 350, 50))


def test_nothing_to_search(spark):
    q, trees = mtree.index(frame(spark, np.zeros((0, 3))))
    assert mtree.top_k(q, trees).count() == 0
    q, trees = mtree.index(frame(spark, np.ones((3, 3)), [50, 51, 52]))
    assert results(mtree.top_k(q.where("vec_id = 50"), trees)) == {50: [(51, 3 * 256 * 256), (52, 3 * 256 * 256)]}
    assert mtree.top_k(q.where("vec_id = 4"), trees).count() == 0
