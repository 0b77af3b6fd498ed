"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, turns homoglyphs (Cyrillic, Greek, full-width, accented Latin) and digit or sign substitutions
into plain letters, one character for one. Terms are whole words or word beginnings with a weight, the smoothed log odds
of label 1 among training documents that have the term; a match counts at word boundaries only and not inside an exception phrase.
The sum of weights, as it is and per words of the text, goes through a logistic curve fitted on the same documents.

The lexicon is learned from at most ``SAMPLE`` labelled training documents (those with the smallest id hash) of at most
``SAMPLE_BYTES`` (common.py) together; scoring reads every whole text in one pass without a shuffle, in time proportional to its length.
Memory of a task is the lexicon and one Arrow batch.

Defined results: null and empty texts have no match and the score of such a text; without any training label of either
kind the base lexicon alone decides; rows that repeat a doc_id are scored each; a null doc_id is not held out; columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import labelled, table, with_split

#: Labelled documents that a lexicon is learned from, at most.
SAMPLE = 4_000
MOD, HELD, THRESHOLD = 4, 2, 0.3
#: Weight of terms that are toxic without any evidence from labels.
BASE_WEIGHT = 4.0
BASE = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "asshole", "bastard", "bitch", "retard")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "stupid question", "idiot proof", "sore loser rule")
_LOOKS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


def folding() -> dict[int, str]:
    """Character to its plain lower-case look; every character stays one character."""
    made = {ord(x): y for x, y in _LOOKS.items()} | {ord(x.upper()): y for x, y in _LOOKS.items() if len(x.upper()) == 1}
    made |= {c: chr(c + 32) for c in range(65, 91)}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(c))[0].lower()
        made.setdefault(c, made.get(ord(plain), plain))
    return made


FOLD = folding()
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """Terms with weights; ``whole`` terms must end at a word's end."""

    terms: dict[str, tuple[float, bool]]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.5)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for term, (weight, whole) in self.terms.items():
                made.add_word(term, (len(term), weight, whole))
            for phrase in self.exceptions:
                if fold(phrase) not in self.terms:
                    made.add_word(fold(phrase), (len(phrase), 0.0, True))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of terms at word boundaries, outside exception phrases, the longest at each start."""
        if not folded or not len(found := self.automaton()):
            return []
        n, hits, spared = len(folded), {}, []
        for end, (size, weight, whole) in found.iter(folded):
            start = end - size + 1
            if (start and folded[start - 1].isalpha()) or (whole and end + 1 < n and folded[end + 1].isalpha()):
                continue
            if weight == 0.0:
                spared.append((start, end + 1))
            elif start not in hits or hits[start][0] < end + 1:
                hits[start] = (end + 1, weight)
        # in order of start, the farthest end of the phrases begun so far tells whether one holds the match
        out, far, k = [], 0, 0
        spared.sort()
        for s in sorted(hits):
            while k < len(spared) and spared[k][0] <= s:
                far = max(far, spared[k][1])
                k += 1
            if hits[s][0] > far:
                out.append((s, *hits[s]))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + weights, log of 1 + weights per 100 words)."""
        folded = fold(text or "")
        total = sum(w for _, _, w in self.matches(folded))
        return float(np.log1p(total)), float(np.log1p(100.0 * total / (1 + folded.count(" ") + folded.count("\n"))))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        c, x, y = self.curve
        return float(1.0 / (1.0 + np.exp(-np.clip(c + x * a + y * b, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first coefficient is the constant."""
    z, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(texts: list[str], labels: np.ndarray, shortest: int = 4, longest: int = 8, least: int = 3, share: float = 0.02, odds: float = 3.0) -> Lexicon:
    """Lexicon from labelled texts: words and word beginnings of at least ``least`` toxic texts, and of a ``share`` of them, whose smoothed log
    odds reach ``odds``."""
    base = {x: (BASE_WEIGHT, True) for x in map(fold, BASE)}
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return Lexicon(base)

    def terms(words: set[str]) -> set[str]:
        """Whole words (with a mark at their end) and word beginnings."""
        return {x + "$" for x in words if len(x) >= shortest} | {x[:k] for x in words for k in range(shortest, min(longest, len(x) - 1) + 1)}

    # copies of a text are no further evidence; one text's terms are held at a time
    seen: set[int] = set()
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for kind, counter in ((1, toxic), (0, clean)):
        for text, label in zip(texts, labels, strict=True):
            if label == kind:
                words = set(WORD.findall(fold(text)))
                if (key := hash(frozenset(words))) not in seen:
                    seen.add(key)
                    counter.update(terms(words) if kind == 1 else terms(words) & toxic.keys())
        if kind == 1:
            toxic = Counter({t: n for t, n in toxic.items() if n >= max(least, share * n1)})
    weight = {t: float(np.log((n + 0.5) / (n1 + 1)) - np.log((clean[t] + 0.5) / (n0 + 1))) for t, n in toxic.items()}
    sure = {t: w for t, w in weight.items() if w >= odds}
    found: dict[str, tuple[float, bool]] = {}
    for term in sorted(sure, key=lambda x: (len(x.rstrip("$")), x)):
        if any(term[:k] in found and not found[term[:k]][1] for k in range(shortest, len(term) + 1)):
            continue
        # the longest term that nearly all of these texts have says more: a whole word rather than its beginning
        best = max((t for t in sure if t.startswith(term) and toxic[t] >= 0.9 * toxic[term]), key=lambda t: (len(t), t))
        found[best.rstrip("$")] = (sure[best], best.endswith("$"))
    lexicon = Lexicon(base | found)
    x = np.array([lexicon.features(t) for t in texts])
    lexicon.curve = tuple(float(v) for v in logistic(x, (labels == 1).astype(float)))
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Lexicon:
    got = labelled(docs, labels, "toxic", MOD, HELD, rows)
    return learn(got.text.tolist(), got.label_.to_numpy())


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the terms of the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            scores = np.array([own.score(x) for x in batch.text], dtype=np.float64)
            yield pd.DataFrame({"doc_id": batch.doc_id, "held_out": batch.held_out, "score": scores, "predicted": (scores >= threshold).astype("i4")})

    return (with_split(docs, MOD, HELD).mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(x) < threshold for x in texts], dtype=bool)

    return docs.where(F.pandas_udf(passes, "boolean")(docs["text"].cast("string")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
