"""Every stage of the pipeline on its own input against a brute-force version, over the smallest tables."""

import os
import zlib

import numpy as np
import pytest
from tests.llm.test_decontaminate import brute
from tests.llm.test_learned import naive_matches
from tests.llm.test_operators import brute_components

import corpus_pipeline
from codeloom.llm import language, packing, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def naive_toxicity(lexicon, text):
    folded = toxicity.fold(text or "")
    total = sum(w for *_, w in naive_matches(lexicon, folded))
    c, a, b = lexicon.curve
    return 1 / (1 + np.exp(-(c + a * np.log1p(total) + b * np.log1p(100 * total / (1 + folded.count(" ") + folded.count("\n"))))))


def test_stages(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "1 2 3", None, None, None), (None, "no id here", "en", "s", 1)]
    docs = documents.unionByName(spark.createDataFrame(extra, documents.schema)).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)

    kept = stages["toxicity"](spark, docs, DATA)
    assert kept.columns == docs.columns
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert rows(kept) == sorted(((i, t) for i, t in rows(docs) if naive_toxicity(lexicon, t) < toxicity.THRESHOLD), key=str)

    kept = stages["language"](spark, docs, DATA)
    assert kept.columns == docs.columns
    assert rows(kept) == sorted(((i, t) for i, t in rows(docs) if t and any(map(str.isalpha, t))), key=str)
    assert stages["language"](spark, docs.limit(0), DATA).count() == 0

    kept = stages["near_duplicates"](spark, docs, DATA)
    assert kept.columns == docs.columns
    named = [(i, t) for i, t in rows(docs) if i is not None]
    root = brute_components(named, 5, 80)
    assert rows(kept) == sorted([(i, t) for i, t in named if root[i][1] == i] + [(None, "no id here")], key=str)

    kept = stages["decontamination"](spark, docs, DATA)
    assert kept.columns == docs.columns
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    judged = {(i, t): brute(t, items) for i, t in rows(docs)}
    assert rows(kept) == sorted((k for k, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)), key=str)

    packed = stages["packing"](spark, docs, DATA).collect()
    encoder = packing.WordEncoder(packing.vocabulary())
    want = []
    for i, t in rows(docs):
        ids = encoder.encode(t or "") + np.array([1], "<u4").tobytes()
        want += [(i, k, at // 4, min(len(ids) - at, 4 * 4096) // 4, zlib.crc32(ids[at:at + 4 * 4096])) for k, at in enumerate(range(0, len(ids), 4 * 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == sorted(want, key=str)
    assert language.fit(docs).members  # the stage above learned something
