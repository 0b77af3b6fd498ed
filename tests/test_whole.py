"""Queries that do the whole job where the SQL of their namesakes holds a part of the rows, against brute force on small fixtures."""

import numpy as np
import pytest

from codeloom.plans import registry

registry.load()


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables into a folder and gives its path."""

    def write(**made):
        for name, (rows, schema) in made.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_searches_ask_every_twentieth_row(spark, tables):
    v = np.random.default_rng(3).normal(size=(130, 8))
    label = [f"l{i % 3}" for i in range(130)]
    at = tables(embeddings=([(i, label[i], v[i].tolist()) for i in range(130)], "vec_id long, label string, embedding array<double>"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    best, labels, modes = {}, {}, {}
    for q in range(0, 130, 20):
        others = [int(i) for i in np.argsort(-s[q]) if i != q]
        best |= {(q, k + 1): (i, pytest.approx(s[q, i], abs=2e-6)) for k, i in enumerate([i for i in others if s[q, i] > 0.1][:5])}
        labels |= {(q, x): next(i for i in others if label[i] == x) for x in set(label)}
        modes[q] = (sum(s[q, i] > 0.3 for i in others), sum(s[q, i] >= 0.3 for i in others), pytest.approx(s[q, others[0]], abs=2e-6))
    run = lambda name: registry.QUERIES[name](spark, at).collect()
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in run("topk_similar")} == best
    assert {(r.query_id, r.label): r.id for r in run("topk_per_label")} == labels
    assert {r.query_id: (r.strict, r.inclusive, r.best) for r in run("hit_filter_modes")} == modes


def test_graphs_of_whole_orders(spark, tables):
    # 30 > 2001 > 7004 and 30 > 41 > 81 > 30; 40 > 80 > 40; 3 is beside them; every id would be cut or folded by the old filters
    edges = [(30, 2001), (2001, 7004), (30, 41), (41, 81), (81, 30), (40, 80), (80, 40), (3, 5000), (3, 5000)]
    at = tables(orders=(edges, "o_custkey long, o_orderkey long"), customer=([(7004, "MACHINERY"), (3, "MACHINERY"), (30, "BUILDING")], "c_custkey long, c_mktsegment string"))
    run = lambda name: registry.QUERIES[name](spark, at).collect()
    assert sorted((r.node, r.depth) for r in run("recursive_reach")) == [(30, 0), (41, 1), (81, 2), (2001, 1), (7004, 2)]
    assert sorted(r.cycle for r in run("order_cycles")) == ["30 > 41 > 81 > 30", "40 > 80 > 40"]
    assert sorted((r.source, r.target) for r in run("incident_edges")) == [(3, 5000), (2001, 7004)]


def test_words_and_references_of_whole_texts(spark, tables):
    texts = ["Of libraries: the Libraries of a house", "first words, then `lib/a.py` and file:docs/b.md\nat the end src/c/d.ts, `lib/a.py` again", "nothing", None]
    at = tables(documents=([(i, x, f"s{i % 2}") for i, x in enumerate(texts)], "doc_id long, text string, source string"))
    run = lambda name: registry.QUERIES[name](spark, at).collect()
    words = {r.lib: (r.usage_count, r.n_files, r.n_specifiers, r.is_dev) for r in run("library_rollup")}
    assert words["libraries"] == (2, 1, 1, False) and words["nothing"] == (1, 1, 1, False) and words["the"] == (2, 2, 2, True) and words["house"] == (1, 1, 1, False)
    assert sorted((r.doc_id, r.file_path) for r in run("document_file_refs")) == [(1, "docs/b.md"), (1, "lib/a.py"), (1, "src/c/d.ts")]


def test_project_queries_read_whole_tables(spark, tables):
    docs = [(1, "plain words", "a"), (2, "port is process.env.PORT here", "a"), (3, "eval(x) and process.env.KEY", "b"), (4, None, "b")]
    at = tables(documents=(docs, "doc_id long, text string, source string"), pages=([(i, f"<html><body><main id='m{i}'>x</main></body></html>") for i in range(5)], "page_id long, html string"))
    run = lambda name: registry.QUERIES[name](spark, at).collect()
    assert {(r.project_id, r.name) for r in run("environment_variables")} == {("a", "PORT"), ("b", "KEY")}
    assert {r.file_path for r in run("file_packs")} == {f"documents/{i}.md" for i in range(1, 5)}
    assert {r.file_path for r in run("code_chunks")} >= {f"documents/{i}.md" for i in range(1, 4)}
    assert {r.file_path for r in run("security_findings")} == {"documents/3.md"}
    assert {r.file_path for r in run("parse_structure") if r.project_id == "pages"} == {f"pages/{i}.html" for i in range(5)}
