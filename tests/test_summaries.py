"""Summaries over packs as a tree, weak signals, conflicts."""

import math

import pytest

from codeloom.operators import detect, parsers, reports
from codeloom.operators.rules import Rule


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_codebase_summary_against_a_walk(spark, fan):
    rows = [("p", f"f{k:03}", "x" * (k * 37 % 61)) for k in range(97)] + [("q", "only", None), (None, "a", "y" * 40), ("r", "big", "z" * 5000), ("r", "tie1", "z" * 70), ("r", "tie2", "z" * 70)]
    files = spark.createDataFrame(rows, "project_id string, file_path string, content string").withColumnRenamed("x", "y")
    want = {}
    for p in {r[0] for r in rows}:
        own, packs, size = sorted((f, math.ceil(len(c or "") / 3.5)) for q, f, c in rows if q == p), 1, 0
        for _, n in own:
            if size and size + n > 30:
                packs, size = packs + 1, 0
            size += n
        top = sorted(own, key=lambda x: (-x[1], x[0]))[:5]
        want[p] = (packs, len(own), sum(n for _, n in own), f"{len(own)} files, {sum(n for _, n in own)} tokens; largest: " + ", ".join(f"{f} ({n})" for f, n in top))
    got = reports.codebase_summary(files, most=30, fan=fan).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_codebase_summary_of_nothing(spark):
    assert reports.codebase_summary(spark.createDataFrame([], "project_id string, file_path string, content string")).count() == 0


def test_weak_signals_and_conflicts(spark):
    rules = (Rule("A", "build", (("pattern", "alpha", 0.4, None, True),)), Rule("B", "build", (("pattern", "beta", 0.8, None, True),)), Rule("C", "build", (("pattern", "gamma", 0.9, None, True),)))
    files = spark.createDataFrame([("p", "a.js", "JavaScript", "alpha beta gamma")], "project_id string, file_path string, language string, content string")
    of = lambda **more: detect.technologies(files, parsers.configs(files), parsers.imports(parsers.parse_files(files)), rules, **more)
    assert {r.name: r.confidence for r in of().collect()} == {"A": 1.0, "B": 1.0, "C": 1.0}
    weak = of(weak_factor=0.7)
    assert {r.name: r.confidence for r in weak.collect()} == {"A": 0.7, "B": 1.0, "C": 1.0}
    assert [tuple(r) for r in detect.near_ties(weak).collect()] == [("p", "build", "B", "C", 0.0)]
    assert [r.other for r in detect.near_ties(weak, exclusive={("C", "B"), ("A", "B")}).collect()] == ["C"]
    assert detect.near_ties(weak, exclusive=set()).count() == 0


def test_near_ties_take_the_band_in_hundredths(spark):
    tech = spark.createDataFrame([("p", "x", "a", 0.5), ("p", "x", "b", 0.6), ("p", "x", "c", 0.61), ("p", "y", "d", 0.5), (None, "x", "e", 0.5), ("p", None, "f", 0.5), ("p", "x", "g", None)], "project_id string, category string, name string, confidence double")
    assert {(r.name, r.other, r.gap) for r in detect.near_ties(tech).collect()} == {("a", "b", 0.1), ("b", "c", 0.01)}
    assert detect.near_ties(tech.limit(0)).count() == 0
