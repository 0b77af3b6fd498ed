"""Language identification in two levels: family first, then one-versus-one linear SVMs inside the family.

A text is its counts of byte trigrams, hashed into ``WIDTH`` cells, square-rooted and scaled to length 1. A linear SVM
per family (one against the rest) decides the family; within it, one linear SVM per pair of languages votes. Families are
known by language code; a language of no listed family is a family of its own. Training takes about ``ROWS`` documents of
each language, fewer where there are many languages so that about ``SAMPLE`` are taken together, but at least one of every language: none
is left out. Their features, not their texts, come to the driver. Scoring reads every whole text in one pass without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0; with no training row every text is ``und``;
rows that repeat a doc_id are predicted each; a null doc_id is not held out; columns beside doc_id, text, lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import crc_mod, table, with_split

MOD, HELD = 4, 2
#: Cells of a text; training documents of a language, and of all (those with the smallest id hash).
WIDTH, ROWS, SAMPLE = 4_096, 400, 16_384
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "uralic": "fi et hu", "turkic": "tr az kk ky uz tt", "indo-aryan": "hi bn ur mr ne gu pa si", "semitic": "ar he am mt", "cjk": "zh ja ko",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def features(text: str, width: int = WIDTH) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    f = np.sqrt(np.bincount(h & np.uint32(width - 1), minlength=width)).astype(np.float32)
    return f / max(float(np.linalg.norm(f)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, steps: int = 100) -> np.ndarray:
    """Linear SVM (squared hinge, classes weighted alike) by accelerated gradient descent; weights with the constant last."""
    n = len(y)
    y = y.astype(np.float32)
    share = (np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * n).astype(np.float32)
    z = np.hstack([x, np.ones((n, 1), dtype=np.float32)])
    w = v = np.zeros(z.shape[1], dtype=np.float32)
    rate = 1.0 / (1.0 + 4.0 * c * float(share.max()))
    for k in range(steps):
        gap = np.maximum(np.float32(0), np.float32(1) - y * (z @ v))
        grad = v - np.float32(2.0 * c / n) * (z.T @ (share * y * gap))
        new = v - np.float32(rate) * grad
        v = new + np.float32(k / (k + 3.0)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str]
    family_w: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        f = np.append(features(text), np.float32(1))
        margin = self.family_w @ f
        k = int(margin.argmax())
        sure = 1.0 / (1.0 + np.exp(-4.0 * float(margin[k]))) if len(margin) > 1 else 1.0
        names = self.members[self.families[k]]
        if len(names) == 1:
            return names[0], float(sure)
        votes, odds = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            m = float(self.pairs[a, b] @ f)
            votes[a if m > 0 else b] += 1
            odds[a] += m
            odds[b] -= m
        best = max(names, key=lambda x: (votes[x], odds[x], x))
        return best, float(sure / (1.0 + np.exp(-4.0 * odds[best] / (len(names) - 1))))


def train(x: np.ndarray, langs: list[str]) -> Model:
    """x: features of a text in every row."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, WIDTH + 1)), {}, {})
    y = np.array(langs)
    kin = np.array([FAMILY.get(n, n) for n in langs])
    families = sorted(set(kin))
    members = {f: [n for n in names if FAMILY.get(n, n) == f] for f in families}
    w = np.stack([svm(x, np.where(kin == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.ones((1, WIDTH + 1))
    pairs = {(a, b): svm(x[pick], np.where(y[pick] == a, 1.0, -1.0)) for f in families for a, b in combinations(members[f], 2) if len(pick := np.flatnonzero((y == a) | (y == b)))}
    return Model(families, w, members, pairs)


def fit(docs: DataFrame, rows: int = ROWS, sample: int = SAMPLE) -> Model:
    """Learns from about ``rows`` documents of each language, never from held-out ones; rows that repeat a doc_id and language count once."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = own.where("lang is not null and text is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), MOD) != HELD)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first")).toArrow().to_pandas()
    if not len(counts):
        return Model([], np.zeros((0, WIDTH + 1)), {}, {})
    each = max(1, min(rows, sample // len(counts)))
    ends = [(lang, max(int(min(1.0, each / n) * (1 << 40)), first + 1)) for lang, n, first in zip(counts.lang, counts.n.tolist(), counts["first"].tolist(), strict=True)]
    limits = docs.sparkSession.createDataFrame(ends, "lang string, end_ long")  # a row a language
    picked = usable.join(F.broadcast(limits), "lang").where(place < F.col("end_")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t) for t in batch.text]
            cells = [np.flatnonzero(f) for f in made]
            yield pd.DataFrame({"doc_id": batch.doc_id, "lang": batch.lang, "cells": [c.astype("<u2").tobytes() for c in cells], "values": [f[c].astype("<f4").tobytes() for f, c in zip(made, cells, strict=True)]})

    got = picked.mapInPandas(encode, "doc_id long, lang string, cells binary, values binary").toArrow().to_pandas().sort_values(["doc_id", "lang"])
    x = np.zeros((len(got), WIDTH), dtype=np.float32)
    for k, (c, v) in enumerate(zip(got.cells, got["values"], strict=True)):
        x[k, np.frombuffer(c, "<u2")] = np.frombuffer(v, "<f4")
    return train(x, got.lang.tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: WIDTH cells for each family and pair

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            found = [own.predict(x) for x in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "held_out": batch.held_out, "lang_pred": [x for x, _ in found], "score": np.array([s for _, s in found], dtype=np.float64)})

    return (with_split(docs, MOD, HELD).mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that have a language: those that are not ``und``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.predict(x)[0] != "und" for x in texts], dtype=bool)

    return docs.where(F.pandas_udf(passes, "boolean")(docs["text"].cast("string")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
