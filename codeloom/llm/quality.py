"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

Every passage (``PASSAGE`` bytes of the whole text, cut at any place) becomes the share of each pair of character classes in
it, plus its size and its repetition; a dense layer encodes it, gated attention (tanh and sigmoid branches) gives it a weight
among the document's passages, and the weighted sum of encodings is scored by a logistic unit. All weights are learned from
document labels, of at most ``SAMPLE`` training documents (those with the smallest id hash) of at most ``SAMPLE_BYTES`` (common.py)
together, with Adam in numpy on the driver, which so holds about two bytes of features for one of text, a few times over. Scoring reads every whole text in one pass without a shuffle.

Defined results: null and empty texts are one empty passage; without training labels of both kinds every score is 0.5 and
every prediction 1; rows that repeat a doc_id are scored each; a null doc_id is not held out; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import labelled, table, with_split

MOD, HELD, THRESHOLD, SAMPLE = 3, 1, 0.5, 4_000
PASSAGE = 512
CLASSES = 16


def _classes() -> np.ndarray:
    """Byte to class: vowel, consonant, capital, digit, space, line end, beyond ASCII, and signs that text uses apart."""
    lut = np.full(256, 15, dtype=np.uint8)
    for k, chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"*#", b"$%&", b"<>{}[]()/\\", b"'\"-_@=+~^`")):
        lut[list(chars)] = k
    lut[128:] = 14
    return lut


LUT = _classes()
FEATURES = CLASSES * CLASSES + 3


def encode(text: str | None) -> np.ndarray:
    """(passages, FEATURES) of a whole text."""
    b = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = max(1, -(-len(b) // PASSAGE))
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(b):
        return out
    c = LUT[b].astype(np.int64)
    at = np.arange(len(b), dtype=np.int64) // PASSAGE
    size = np.bincount(at, minlength=n).astype(np.float32)
    if len(b) > 1:
        pairs = np.bincount(at[1:] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:], minlength=n * CLASSES * CLASSES).reshape(n, -1)
        out[:, :-3] = np.sqrt(pairs / np.maximum(size, 1)[:, None])
    out[:, -3] = np.log1p(size) / 6
    out[:, -2] = np.log1p(len(b)) / 10
    lines = [x for x in (text or "").split("\n") if x]
    out[:, -1] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights: mean and spread of features; encoder w, b; attention v, u, a; head c, c0."""

    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        att = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "att": att, "z": z, "out": sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Of the logistic loss of all bags, weighted by share, by every weight."""
        p, f = self.p, self.forward(x, starts, bag)
        d = share * (f["out"] - y)  # of the loss by the logit
        dz = d[:, None] * p["c"]
        dh = f["att"][:, None] * dz[bag]
        datt = (f["h"] * dz[bag]).sum(1)
        de = f["att"] * (datt - np.add.reduceat(f["att"] * datt, starts)[bag])
        dt, dg = de[:, None] * p["a"] * f["g"], de[:, None] * p["a"] * f["t"]
        dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh += dt @ p["v"].T + dg @ p["u"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"w": x.T @ dpre, "b": dpre.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        if not self.p:
            return np.full(len(bags), 0.5)
        sizes = np.array([len(x) for x in bags])
        x = (np.vstack(bags) - self.mean) / self.spread
        return self.forward(x, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes))["out"].astype(np.float64)


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 250, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Model:
    """Adam over all bags at once; both labels weigh alike."""
    if not bags or len(set(y.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {})
    rng, y = np.random.default_rng(seed), y.astype(np.float32)
    sizes = np.array([len(x) for x in bags])
    starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
    x = np.vstack(bags)
    mean, spread = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / spread
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"w": init(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "v": init(hidden, gate), "u": init(hidden, gate), "a": init(gate), "c": init(hidden), "c0": np.zeros(1, np.float32)}
    model, m, s = Model(mean, spread, p), {k: 0.0 for k in p}, {k: 0.0 for k in p}
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    for step in range(1, steps + 1):
        grads = model.gradients(x, starts, bag, y, share)
        for k in p:
            grad = grads[k] + decay * p[k] * (k not in ("b", "c0"))
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad * grad
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def calibrated(model: Model, bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Moves the constant so that the threshold of one half makes the fewest errors on the training bags."""
    if model.p:
        s = model.score(bags)
        logit = np.log(np.clip(s, 1e-9, 1) / np.clip(1 - s, 1e-9, 1))
        order = np.argsort(logit)
        wrong = np.concatenate([[(y == 0).sum()], (y == 0).sum() + np.cumsum(np.where(y[order] == 1, 1, -1))])
        k = int(wrong.argmin())
        edges = np.concatenate([[logit[order[0]] - 1], logit[order], [logit[order[-1]] + 1]])
        model.p["c0"] = model.p["c0"] - np.float32((edges[k] + edges[k + 1]) / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    got = labelled(docs, labels, "quality", MOD, HELD, rows)
    bags, y = [encode(t) for t in got.text], got.label_.to_numpy()
    return calibrated(train(bags, y), bags, y)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            parts, bags, held = [], [], 0
            for text in batch.text:
                bags.append(encode(text))
                held += len(bags[-1])
                if held > 4_000:
                    parts.append(own.score(bags))
                    bags, held = [], 0
            scores = np.concatenate([*parts, own.score(bags)])
            yield pd.DataFrame({"doc_id": batch.doc_id, "held_out": batch.held_out, "score": scores, "predicted": (scores >= threshold).astype("i4")})

    return (with_split(docs, MOD, HELD).mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
