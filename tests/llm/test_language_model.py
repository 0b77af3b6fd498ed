"""Language-model scores do not depend on memory limits or partitions, and follow a brute-force smoothed probability."""

import numpy as np
import pytest
from tests.llm.test_operators import brute_scores, docs

from codeloom.llm import language_model


def corpus(n=400):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 15) % 300)) for i in range(n)]
    return [*rows, (9_007_199_254_740_993, "w1 w2 unseen"), (None, "w1 w2"), (5, ""), (6, None), (7, "w3 " * 30_000)]


def scores(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


def test_scores_are_the_same_whatever_the_limits(spark):
    rows = corpus()
    want = scores(language_model.score_documents(docs(spark, rows)))
    assert any(r[0] == "9007199254740993" for r in want)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for max_bytes, partitions in ((8, "4"), (4096, "64"), (language_model.MAX_BYTES, "211")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert scores(language_model.score_documents(docs(spark, rows).repartition(3), max_bytes=max_bytes)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    brute = brute_scores(rows, language_model.BUCKETS)
    assert sorted(s for *_, s in want) == pytest.approx(sorted(brute), abs=1e-5)


@pytest.mark.parametrize("buckets", [4, 256])
def test_unseen_text_scores_below_seen_text(spark, buckets):
    rows = [(i, "the cat sat on the mat" if i % 2 else "a dog ran over the hill") for i in range(60)] + [(2_000, "the cat sat on the mat"), (2_001, "zq yq xq wq vq uq")]
    for max_bytes in (8, language_model.MAX_BYTES):  # filters apart, and whole at every worker
        got = {r.doc_id: r.score for r in language_model.score_documents(docs(spark, rows), buckets=buckets, max_bytes=max_bytes).collect()}
        assert got[2_001] < got[2_000] < 0 and got[2_001] < -6


def test_buckets_follow_the_bytes_of_texts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_TEXT", 1_000)
    assert language_model.buckets_for(docs(spark, [(1, None), (2, "")])) == 8
    assert language_model.buckets_for(docs(spark, [(1, "x" * 33_000)])) == 64


def test_no_documents_and_none_to_learn_from(spark):
    assert language_model.score_documents(docs(spark, []), max_bytes=0).count() == 0
    got = language_model.score_documents(docs(spark, [(3, "only held out")]), max_bytes=0).collect()  # crc32 of '3' leaves 1
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in got] in ([(3, 4, 0, 0, True)], [(3, 4, 4, 4, False)])


def test_filters_of_files_equal_those_of_bytes(monkeypatch):
    lm = language_model
    keys = np.unique(np.random.default_rng(2).integers(0, 2 ** 63, 900, dtype=np.uint64) * np.uint64(2))
    at, q = lm.Filters(8, {}).bucket(keys), np.arange(len(keys)) % 9 + 1
    parts = {int(b): lm.bloom(keys[at == b], q[at == b]).tobytes() for b in set(at) if b != 3}
    monkeypatch.setattr(lm, "read", lambda name: parts[int(name)])
    files = lm.Filters(8, {b: (len(x), str(b)) for b, x in parts.items()})
    assert (files.levels(keys) == lm.Filters(8, parts).levels(keys)).all() and (files.levels(keys)[at != 3] >= q[at != 3]).all() and (files.levels(keys)[at == 3] == 0).all()
