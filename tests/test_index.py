"""Approximate searches against brute force: recall on whole tables, exactness where every code is probed, crowded codes, odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import index, retrieval
from codeloom.plans import registry

registry.load()
DATA = "/root/testdata/sf0.1"
KIND = "id long, kind string, vector array<double>, score string"
ASKED = "query_id long, query_vector array<double>, rank int"


def brute(chunks, queries, k=5, threshold=0.1):
    out = {}
    for q, v in queries:
        s = sorted(((-float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), i) for i, x in chunks if i != q))
        out[q] = [i for d, i in s if -d > threshold][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["ivf_search", "hash_search"])
def test_recall(spark, name):
    """At least 0.9 of the five nearest of every id divisible by 20, on vectors without any clusters."""
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    got, hit, n = found(registry.QUERIES[name](spark, DATA)), 0, 0
    for i in ids[ids % 20 == 0].tolist():
        s = x @ x[ids == i][0]
        s[ids == i] = -2
        best = ids[np.lexsort((ids, -s))[:5]].tolist()
        hit += len(set(best) & set(got.get(i, [])))
        n += 5
    print(name, "recall", hit / n)
    assert hit >= 0.9 * n


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    return [(i, rng.normal(size=8)) for i in range(700)]


def frames(spark, vectors, kinds=("code",)):
    chunks = spark.createDataFrame([(i, kinds[i % len(kinds)], v.tolist(), "x") for i, v in vectors], KIND)
    return chunks, spark.createDataFrame([(i, v.tolist(), 1) for i, v in vectors if i % 20 == 0], ASKED)


def test_small_sub_indexes_are_exact(spark, vectors):
    chunks, queries = frames(spark, vectors, ("code", "doc", "config"))
    want = brute(vectors, [v for v in vectors if v[0] % 20 == 0])
    assert found(index.ivf_search(chunks, queries, width=8)) == want
    docs = [v for v in vectors if v[0] % 3 == 1]
    assert found(index.ivf_search(chunks, queries, width=8, kinds=["doc"])) == brute(docs, [v for v in vectors if v[0] % 20 == 0])


def test_all_buckets_are_exact(spark, vectors):
    chunks, queries = frames(spark, vectors)
    want = brute(vectors, [v for v in vectors if v[0] % 20 == 0])
    assert found(index.hash_search(chunks, queries, width=8, tables=1, bits=3, probes=8)) == want


def test_a_crowded_code_is_split(spark, vectors):
    """The same answers when groups hold few rows of either side."""
    chunks, queries = frames(spark, vectors)
    placed = chunks.select(F.lit(0).cast("long").alias("slot_"), F.lit(0).cast("long").alias("code_"), "id", "vector").collect()
    norm = lambda v: (np.array(v) / np.linalg.norm(v)).tolist()
    placed = spark.createDataFrame([(0, 0, r.id, norm(r.vector)) for r in placed], "slot_ long, code_ long, id long, vector array<double>")
    asked = spark.createDataFrame([(0, [0, 3], r.query_id, norm(r.query_vector)) for r in queries.collect()], "slot_ long, codes_ array<long>, query_id long, query_vector array<double>")
    want = brute(vectors, [v for v in vectors if v[0] % 20 == 0])
    assert found(index.probe(placed, asked, 5, 0.1, rows=50, queries=7)) == want


def test_odd_rows(spark):
    rows = [(1, "code", [1.0, 0.0], "a"), (1, "code", [1.0, 0.0], "a"), (2, None, [1.0, 0.1], "b"), (3, "doc", [0.0, 0.0], None), (4, "doc", None, None), (5, "doc", [1.0], None), (6, "doc", [float("nan"), 1.0], None), (7, "doc", [None, 1.0], None)]
    chunks = spark.createDataFrame(rows, KIND)
    queries = spark.createDataFrame([(1, [2.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, None, 0), (11, [0.0, 0.0], 0), (12, [-1.0, 0.0], 0)], ASKED)
    for search in (index.ivf_search, index.hash_search):
        assert found(search(chunks, queries, width=2, **({} if search is index.ivf_search else {"bits": 2, "probes": 4}))) == {1: [2], 9: [1, 2]}
        assert search(chunks.limit(0), queries, width=2).collect() == [] == search(chunks, queries.limit(0), width=2).collect()


def test_cells_and_probes():
    rng = np.random.default_rng(0)
    centres = np.eye(6)
    sample = retrieval.unit(list(centres[rng.integers(0, 6, 400)] + rng.normal(0, 0.02, (400, 6))), 6)
    got = index.learned_cells(sample, 12)
    assert (got @ centres.T).max(0).min() > 0.99
    masks = index.flips(4)
    assert len(masks) == 1 + 4 + 6 + 4 and len(np.unique(masks, axis=0)) == len(masks)


def test_blocks_of_queries_come_from_files(spark, vectors):
    chunks, queries = frames(spark, vectors)
    want = brute(vectors, [v for v in vectors if v[0] % 20 == 0])
    for rows in (5, 4096):
        got = retrieval.in_blocks(chunks.select("id", "vector"), queries, lambda ids, s, batch: __import__("pandas").DataFrame({"query_id": ids, "n": (s > 2).sum(1)}), "query_id long, n long", rows)
        assert {r.query_id for r in got.collect()} == set(want)
    assert found(retrieval.nearest(chunks, queries)) == want


@pytest.mark.parametrize("name", ["ivf_search", "hash_search"])
def test_floats_are_sent_as_floats(spark, vectors, monkeypatch, name):
    """What is dealt to groups is as wide as the input's vectors; scaled doubles took twice the room."""
    chunks, queries = frames(spark, vectors)
    want = found(getattr(index, name)(chunks, queries, width=8))
    kinds, sent = [], index.probe
    monkeypatch.setattr(index, "probe", lambda placed, asked, *x: kinds.append((placed.schema["vector"].dataType.simpleString(), asked.schema["query_vector"].dataType.simpleString())) or sent(placed, asked, *x))
    got = found(getattr(index, name)(chunks.withColumn("vector", F.col("vector").cast("array<float>")), queries.withColumn("query_vector", F.col("query_vector").cast("array<float>")), width=8))
    assert kinds == [("array<float>", "array<float>")]
    assert sum(got[q] == want[q] for q in want) >= 0.9 * len(want)
