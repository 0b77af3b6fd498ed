"""Sums, packs, components and cycles that need no group of a whole key, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import chat, chunking, graph, prefixes


def packs(sizes, most):
    out, k, size = [], 0, 0
    for n in sizes:
        if size and size + n > most:
            k, size = k + 1, 0
        out.append(k)
        size += n
    return out


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0, 1, 5, 10**10])) for i in range(500)]
    got = prefixes.prefix_sums(spark.createDataFrame(rows, "k string, i long, v long"), "k", "i", {"before": F.col("v"), "n": F.lit(1)}).collect()
    want = {(k, i): (sum(v or 0 for k2, j, v in rows if k2 == k and j < i), sum(k2 == k and j < i for k2, j, _ in rows)) for k, i, _ in rows}
    assert {(r.k, r.i): (r.before, r.n) for r in got} == want


@pytest.mark.parametrize("most", [1, 7, 60, 10_000])
def test_packs_equal_the_walk(spark, most):
    rng = random.Random(most)
    rows = [(k, i, rng.choice([0, 0, 1, 2, 3, 9, 30, 100])) for k in ("x", "y", "z") for i in range(1 if k == "z" else 150)]
    got = {}
    for r in sorted(prefixes.pack_numbers(spark.createDataFrame(rows, "k string, i long, size long"), "k", "i", "size", most).collect(), key=lambda r: (r.k, r.i)):
        got.setdefault(r.k, []).append(r.pack_no)
    assert got == {k: packs([n for k2, _, n in rows if k2 == k], most) for k in "xyz"}


def test_large_and_small_projects_pack_alike(spark):
    rng = random.Random(3)
    rows = [(p, f"f{i:03d}", "x" * rng.choice([0, 3, 40, 400])) for p in (1, 2, None) for i in range(60 if p == 1 else 25)] + [(2, "g", None)]
    files = spark.createDataFrame(rows, "project_id long, file_path string, content string")
    by = lambda n: {(r.project_id, r.file_path): r.pack_no for r in chunking.pack_files(files, "project_id", 100, group_rows=n).collect()}
    assert by(10) == by(30) == by(1_000) and len(by(10)) == len(rows)
    assert chunking.pack_files(files.limit(0), "project_id", 100).collect() == []


def test_budget_keeps_the_first_that_does_not_fit(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([0, 1, 5, 20])) for k in ("a", "b") for i in range(80)]
    got = {(r.k, r.i): (r.running, r.truncated, r.tokens_used) for r in chat.pack_chunks(spark.createDataFrame(rows, "k string, i long, n long"), "k", "i", "n", 50).collect()}
    want = {}
    for k in ("a", "b"):
        used = 0
        for _, i, n in (r for r in rows if r[0] == k):
            want[k, i] = (used + n, used + n > 50, 50 - used if used + n > 50 else n)
            used += n
            if used > 50:
                break
    assert got == want


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        stack = [b for a, b in edges if a == n]
        while stack:
            x = stack.pop()
            if x not in reach[n]:
                reach[n].add(x)
                stack += [b for a, b in edges if a == x]
    own = {n: {m for m in reach[n] if n in reach[m]} for n in nodes if n in reach[n]}
    return {n: (min(m | {n}), len(m | {n})) for n, m in own.items()}


@pytest.mark.parametrize(("seed", "walked"), [(1, 0), (2, 0), (1, 20), (2, 10_000), (3, 10_000)])
def test_strong_components(spark, seed, walked):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(100, 101), (101, 102), (102, 100), (102, 103), (200, 200)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None), (100, 101)], "source long, target long")
    assert {r.node: (r.component, r.size) for r in graph.strong_components(df, walked=walked).collect()} == brute_components(edges)


def test_no_cycles_and_loops(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "source long, target long")
    assert graph.strong_components(chain).collect() == [] == graph.strong_components(chain.limit(0)).collect()
    loop = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("c", "c")], "source string, target string")
    assert {r.node: (r.component, r.size) for r in graph.strong_components(loop).collect()} == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}
    assert sorted(tuple(r.cycle) for r in graph.cycles_of_components(loop).collect()) == [("a", "a"), ("a", "b", "a"), ("c", "c")]
