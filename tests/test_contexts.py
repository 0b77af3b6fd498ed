"""Report contexts against a walk: caps, priorities, one budget."""

import math

import pytest

from codeloom.operators import contexts

PLAN = {"a": (("x", "X", 2, 2), ("y", "Y", 5, 1)), "b": (("y", "Y", 1, 1), ("z", "Z", 3, 2), ("x", "X", 9, 3))}
ROWS = [("p", "x", f"{k:02}", f"- x{k}") for k in range(7)] + [("p", "y", "1", "- tie"), ("p", "y", "1", "- tie"), ("p", "y", "0", "- first"), (None, "x", "1", "- of none"), ("q", "z", "1", "z" * 90), ("q", "x", "1", "- small"), ("q", "w", "1", "in no context")]


def walked(budget):
    out = {}
    for p in {r[0] for r in ROWS}:
        for name, plan in PLAN.items():
            bodies = []
            for k, (s, title, most, priority) in enumerate(plan):
                own = sorted((place, line) for q, t, place, line in ROWS if q == p and t == s)
                if own:
                    more = f"\n  +{len(own) - most} more" if len(own) > most else ""
                    bodies.append((priority, k, f"## {title}\n" + "\n".join(line for _, line in own[:most]) + more))
            kept, total, full = [], 0, False
            for _, k, body in sorted(bodies):
                t = math.ceil(len(body) / 3.5)
                full = full or total + t > budget
                if not full:
                    kept.append((k, body))
                    total += t
            if bodies:
                out[p, name] = (len(kept), len(bodies) - len(kept), total, "\n\n".join(b for _, b in sorted(kept)))
    return out


@pytest.mark.parametrize("budget", [0, 8, 12, 20, 10_000])
def test_contexts_against_a_walk(spark, budget):
    lines = spark.createDataFrame([(p, s, [place], line) for p, s, place, line in ROWS], "project_id string, section string, place array<string>, line string")
    got = contexts.report_contexts(lines, budget, PLAN).collect()
    assert {(r.project_id, r.context): tuple(r)[2:] for r in got} == walked(budget) and len(got) == len(walked(budget))


def test_contexts_of_nothing(spark):
    assert contexts.report_contexts(spark.createDataFrame([], "project_id string, section string, place array<string>, line string")).count() == 0


def test_sections_leave_out_null_lines(spark):
    rows = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, None)], "project_id string, n int, name string")
    assert [(r.section, r.place, r.line) for r in contexts.section(rows, "s", rows["name"], "n").orderBy("place").collect()] == [("s", ["1"], "a"), ("s", ["2"], "b")]
