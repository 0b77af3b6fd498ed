"""Spelling variants against brute force: random words over few letters, chains of forms, crowded keys, odd rows."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import regex
from tests.llm.test_operators import docs

from codeloom.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [form, n, len(around), counts[form] if form else None]
    for w, r in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        r.append(root)
    return out


def found(df):
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in df.collect()}


@pytest.mark.parametrize("hot", [64, 1])
def test_equals_brute_force(spark, hot):
    rng = np.random.default_rng(hot)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(6, 9)))) for _ in range(400)}
    words |= {"a" * n for n in range(6, 12)} | {"ab" * n for n in range(3, 6)} | {"ba" * n + "b" for n in range(3, 6)}
    counts = {w: int(5 ** rng.uniform(1, 5)) for w in sorted(words)}
    assert found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), hot=hot)) == brute(counts)


def test_a_crowded_start(spark):
    """Hundreds of words whose rarest bigram is their start."""
    counts = {"qx" + "".join(t): 5 + i for i, t in enumerate(product("abcd", repeat=4))} | {"qxaaaab": 9_000, "zqxaaaa": 2}
    assert found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_chains(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 130, "abcihg": 700, "zzzzzz": 5, "zzzzzy": 24}
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and got["abcdef"][4] == "abcihg" and got["zzzzzz"] == [None, 5, 1, None, "zzzzzz"]


def test_vocabulary(spark):
    rng = np.random.default_rng(1)
    pool = ["".join(rng.choice(list("abcÀÿÉ×"), int(rng.integers(5, 9)))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(pool, 300)) + "1Straße,") for i in range(40)] + [(3, "Straße " * 6), (None, "Straße"), (7, None), (8, "")]
    want = Counter()
    for i, t in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    got = {r.word: r.n for r in spelling.vocabulary(docs(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} and any(len(w) == 6 for w in got)


def test_nothing_and_long_runs(spark):
    assert spelling.variants(spelling.vocabulary(docs(spark, []))).collect() == []
    long = "x" * 3_000
    got = found(spelling.variants(spelling.vocabulary(docs(spark, [(i, f"{long} {long}y") for i in range(400)]))))
    assert got[long + "y"][0] is None and got[long][2] >= 1
