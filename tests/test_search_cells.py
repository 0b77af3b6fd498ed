import numpy as np
import pandas as pd

from codeloom.operators import retrieval


def vectors(spark, n, name):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.integers(-2, 3, size=(n, 4)))]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>")


def test_a_task_holds_a_bounded_number_of_cosines(spark):
    chunks, queries = vectors(spark, 3_000, "id").coalesce(1), vectors(spark, 1_000, "query_id").withColumnRenamed("vector", "query_vector")
    sizes = retrieval.in_blocks(chunks, queries, lambda ids, s, batch: pd.DataFrame({"n_queries": [len(ids)], "n": [s.size]}), "n_queries long, n long").collect()
    assert sum(r.n for r in sizes) == 3_000 * 1_000 and max(r.n for r in sizes) <= retrieval.CELLS


def test_the_best_scores_among_many_ties(spark):
    chunks, queries = vectors(spark, 500, "id"), vectors(spark, 40, "query_id").withColumnRenamed("vector", "query_vector")
    x = retrieval.unit([r.vector for r in chunks.orderBy("id").collect()], 4)
    want = set()
    for q in range(40):
        s = np.round(x @ x[q], 9)
        best = sorted((k for k in range(500) if k != q and s[k] > 0.1), key=lambda k: (-s[k], k))[:5]
        want |= {(q, round(float(s[k]), 6)) for k in best}
    got = retrieval.nearest(chunks, queries, 5).collect()
    assert {(r.query_id, round(r.score, 6)) for r in got} == want
