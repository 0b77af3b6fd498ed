"""Decontamination: rows judged by their own text, clashing columns, hits that overlap, and work in proportion to a text's length."""

import time

from pyspark.sql import functions as F
from tests.llm.test_operators import docs

from codeloom.llm import decontaminate

ITEM = " ".join(f"w{i}" for i in range(20))


def bench(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_clean_judges_rows_by_their_text(spark):
    rows = [(6, ITEM), (6, "a clean text"), (6, "a clean text"), (None, ITEM), (None, "another"), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, t1_ long, n_hit int, hit1_ string")
    kept = decontaminate.clean(df, bench(spark, ITEM))
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("6", "a clean text"), ("6", "a clean text"), ("7", "None"), ("8", ""), ("None", "another")]


def test_a_twentieth_decides(spark):
    rows = [(n_hit, n_words, bool(n_hit and 20 * n_hit >= n_words)) for n_hit, n_words in ((20, 400), (20, 401), (0, 0), (1, 20), (1, 21))]
    df = spark.createDataFrame(rows, "a long, b long, want boolean").select(decontaminate.is_bad(F.col("a"), F.col("b"), 20).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def brute(text, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for k, item in enumerate(items):
        x = words(item)
        n = min(13, len(x))
        for a in range(len(x) - n + 1) if x else ():
            for b in range(len(w) - n + 1):
                if w[b:b + n] == x[a:a + n]:
                    hit |= set(range(b, b + n))
                    found.add(k)
    return len(w), len(hit), len(found)


def test_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    draw = lambda n, of: " ".join(f"t{int(x)}" for x in rng.integers(0, of, n))
    items = [draw(30, 3), draw(14, 50), draw(13, 50), draw(5, 4), draw(2, 4), "solo", draw(200, 40)]
    texts = [draw(60, 3), draw(40, 4), "Solo! " + items[1], items[6] + " " + items[6][5:], "x " + items[2].upper() + " y", None, "", "t1 t2", items[3]]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs(spark, list(enumerate(texts))), bench(spark, *items)).collect()}
    assert got == {k: brute(t, items) for k, t in enumerate(texts)}


def test_positions_carry_no_words(spark):
    plan = decontaminate.positions(docs(spark, [(1, ITEM)]), [3])._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate posexplode" in line)
    assert "[t1_" in generate and ", w#" not in generate.split("),")[-1]


def test_time_follows_the_length_of_a_text(spark):
    """Four times the words take at most about four times as long, start-up taken off."""
    def took(n):
        df = docs(spark, [(1, " ".join(f"v{i % 900}" for i in range(n)) + " " + ITEM)]).cache()
        df.count()
        begun = time.perf_counter()
        assert decontaminate.positions(df, [3]).selectExpr("count(*) n", "bit_xor(h + n_ + pos_)").first().n == n + 20
        return time.perf_counter() - begun

    start = min(took(1_000) for _ in range(3))
    short, long = took(80_000) - start, took(320_000) - start
    assert long < 6 * max(short, 0.5)


def test_long_text(spark):
    df = docs(spark, [(1, " ".join(f"v{i % 900}" for i in range(200_000)) + " " + ITEM)])
    assert decontaminate.decontaminate(df, bench(spark, ITEM)).first().n_hit == 20
