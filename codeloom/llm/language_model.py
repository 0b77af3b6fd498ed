"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting: tasks fingerprint the words of whole training texts, sum counts of words and word pairs in memory and send them, packed
and split by fingerprint, to the task of their bucket, which merges them. Buckets are equal ranges of fingerprints, one for about
``BUCKET_TEXT`` bytes of the corpus, so a bucket stays small however large the corpus is, and neither partitions nor memory limits
change a score. A count c becomes level 1 + floor(log_b c), and an n-gram of level q enters its bucket's Bloom filter q times, as
(n-gram, 1) to (n-gram, q). A filter is a file in the shared folder with ``BITS`` bits an entry; none passes through the driver.

Probing: a level is found by probing (n-gram, 1), (n-gram, 2), ... until one is missing; a bucket without entries is level 0. Filters
of at most ``MAX_BYTES`` together go whole to every worker, which reads them from the shared folder. Beyond that bound the distinct
n-grams of a chunk of documents go to the tasks of their buckets instead, each of which holds one filter, and their levels
come back to the chunk: a number of bytes in proportion to the corpus, at any size. Both ways give a document the same levels,
one byte a token for its word and one for its pair, which are written once; weights and scores are then computed from them alone.

Scoring: the probability of a token after another is w_q * c(pair)/c(first) + (1 - w_q) * (c(token) + 0.5)/(N + 0.5 (V + 1)), with counts
restored from levels and a weight for each level q of the first word, fitted by expectation maximisation over all training documents,
each token left out of its own counts. What a token adds to the fit follows from three levels (first word, pair, token), so one pass
counts the tokens of every triple of levels, at most ``LEVELS`` ** 3 numbers whatever the corpus, and the maximisation runs over those.

The base score needs exact counts: the ``HEAD`` most frequent words are broadcast, all other tokens join the count table
by fingerprint, summed within their document before.

Defined results: a null or empty text is its end token alone; without training documents N = V = 0; rows that repeat
a doc_id are scored each; a null doc_id is trained on and not held out; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh_path, opened, saved, small_batches, table, with_split
from codeloom.llm.hashing import chained, mix, word_hashes

MOD, HELD = 5, 1
#: Quantisation base, bits of an entry, hash functions.
BASE, BITS, PROBES = 1.5, 8, 3
#: Bytes of text behind a bucket of counts (at most about as many in packed n-grams); buckets at least.
BUCKET_TEXT, BUCKETS = 16 << 20, 8
#: Bytes of filters that every worker holds; words with broadcast counts.
MAX_BYTES, HEAD = 256 << 20, 1 << 18
#: Tokens counted or scored together.
TOGETHER = 250_000
END = np.uint64(0x5851F42D4C957F2D)
LEVELS = 64
WORD, PAIR = 1, 2


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9), LEVELS - 1).astype(np.int64)


#: Mean of the counts of each level, 0 for level 0.
RESTORED = np.array([0.0] + [float(np.mean([max(1.0, np.ceil(BASE ** (q - 1) - 1e-9)), max(1.0, np.ceil(BASE ** q - 1e-9) - 1)])) for q in range(1, LEVELS)])


def tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes(text), END)


def pairs(t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, pair fingerprints) of concatenated documents; a document's first word follows an end."""
    before = np.concatenate([[END], t[:-1]])
    before[starts] = END
    return before, chained(before, t)


def starts_of(held: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(x) for x in held])
    return np.cumsum(size) - size


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def step_of(buckets: int) -> int:
    """Width of a bucket's range of fingerprints."""
    return min((1 << 64) // buckets, (1 << 64) - 1)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from bucket to bucket."""
    return np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * np.uint64(step_of(buckets)))


def buckets_for(docs: DataFrame) -> int:
    """A power of two that follows the bytes of the texts alone."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(BUCKETS, 1 << max(0, int(np.ceil(np.log2(max(size, 1) / BUCKET_TEXT)))))


def count_ngrams(docs: DataFrame, buckets: int) -> DataFrame:
    """kind, bucket, n_keys, total, keys, counts (of words), name and bytes of the filter: one row for each kind and bucket, saved."""
    folder = fresh_path(docs.sparkSession, "filters")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            t, rows = np.concatenate(held), []
            for kind, values in ((WORD, t), (PAIR, pairs(t, starts_of(held))[1])):
                keys, counts = np.unique(values, return_counts=True)
                edge = cuts(keys, buckets)
                rows += [(kind, k, a.tobytes(), c.astype("<u4").tobytes()) for k, (a, c) in enumerate(zip(np.split(keys, edge), np.split(counts, edge), strict=True)) if len(a)]
            return pd.DataFrame(rows, columns=["kind", "bucket", "keys", "counts"])

        for batch in batches:
            for text in batch.text:
                held.append(tokens(text))
                size += len(held[-1])
                if size >= 4 * TOGETHER:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come ordered by kind and bucket: one bucket is held at a time."""
        last, parts = None, []

        def out() -> pd.DataFrame:
            (kind, bucket), sent = last, last[0] == WORD
            keys, counts = merged(np.concatenate([a for a, _ in parts]), np.concatenate([c for _, c in parts]))
            filt, name = bloom(keys, level(counts)), f"{folder}/{uuid.uuid4().hex}"
            with opened(name, "w") as file:
                file.write(filt.tobytes())
            return pd.DataFrame([(kind, bucket, len(keys), int(counts.sum()), keys.view("<i8") if sent else None, counts if sent else None, name, len(filt))],
                                columns=["kind", "bucket", "n_keys", "total", "keys", "counts", "name", "bytes"])

        for batch in batches:
            for kind, bucket, keys, counts in zip(batch.kind, batch.bucket, batch["keys"], batch["counts"], strict=True):
                if parts and last != (kind, bucket):
                    yield out()
                    parts = []
                last = (kind, bucket)
                parts.append((np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64)))
        if parts:
            yield out()

    packed = docs.where(~F.col("held_out")).select("text").mapInPandas(gather, "kind int, bucket int, keys binary, counts binary")
    with small_batches(docs.sparkSession):
        return saved(packed.repartition(2 * buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInPandas(
            merge, "kind int, bucket int, n_keys long, total long, keys array<long>, counts array<long>, name string, bytes long"), "ngrams")


def places(keys: np.ndarray, q: np.ndarray | int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit of each of the PROBES hash functions for entries (key, q) in filters of ``size`` bits."""
    a = mix(keys + np.uint64(0xA0761D6478BD642F) * np.asarray(q, dtype=np.uint64))
    b = (a >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (((a + np.uint64(k) * b) & np.uint64(0xFFFFFFFF)) * np.asarray(size, dtype=np.uint64)) >> np.uint64(32)


def bloom(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Filter with (key, 1) to (key, level) of each key, as packed bytes."""
    size = max(64, int(-(-BITS * int(levels.sum()) // 8)) * 8)
    bits = np.zeros(size, dtype=bool)
    left, q = np.arange(len(keys)), 1
    while len(left):
        for p in places(keys[left], q, size):
            bits[p] = True
        q += 1
        left = left[levels[left] >= q]
    return np.packbits(bits, bitorder="little")


class Filters:
    """Bloom filters of some buckets, side by side; a bucket without one has no entry.

    parts: of a bucket its bytes, or their number and the name of their file. Files are read one after another into their place, so that
    memory is that of all filters and one file.
    """

    def __init__(self, buckets: int, parts: dict[int, bytes | tuple[int, str]]):
        self.step = np.uint64(step_of(buckets))
        self.sizes = np.zeros(buckets, dtype=np.uint64)
        self.at = np.zeros(buckets, dtype=np.uint64)
        size = {k: x[0] if isinstance(x, tuple) else len(x) for k, x in parts.items()}
        self.bits = np.empty(sum(size.values()), dtype=np.uint8)
        at = 0
        for k in sorted(parts):
            own = read(parts[k][1]) if isinstance(parts[k], tuple) else parts[k]
            self.sizes[k], self.at[k] = 8 * size[k], 8 * at
            self.bits[at:at + size[k]] = np.frombuffer(own, dtype=np.uint8)
            at += size[k]

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(keys // self.step, np.uint64(len(self.sizes) - 1)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        k = self.bucket(keys)
        size, at = self.sizes[k], self.at[k]
        found, left, q = np.zeros(len(keys), dtype=np.int64), np.flatnonzero(size > 0), 1
        while len(left) and q < LEVELS:
            alive = np.ones(len(left), dtype=bool)
            for p in places(keys[left], q, size[left]):
                bit = p + at[left]
                alive &= (self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[alive]
            found[left] = q
            q += 1
        return found


def read(name: str) -> bytes:
    with opened(name, "r") as file:
        return file.read()


#: The filters that this worker holds, by their first name: one set at a time.
_held: dict[str, dict[int, Filters]] = {}


def worker_filters(names: list[tuple[int, int, str, int]], buckets: int) -> dict[int, Filters]:
    key = names[0][2] if names else ""
    if key not in _held:
        _held.clear()
        _held[key] = {kind: Filters(buckets, {b: (size, name) for k, b, name, size in names if k == kind}) for kind in (WORD, PAIR)}
    return _held[key]


def chunked(batches: Iterator[pd.DataFrame], most: int = TOGETHER) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Consecutive rows with their tokens, together until they have ``most`` of them."""
    for batch in batches:
        begin, held, size = 0, [], 0
        for k, text in enumerate(batch.text):
            held.append(tokens(text))
            size += len(held[-1])
            if size >= most:
                yield batch.iloc[begin:k + 1], held
                begin, held, size = k + 1, [], 0
        if held:
            yield batch.iloc[begin:], held


def distinct(held: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each kind the distinct n-grams, ascending, and which of them every token is."""
    t = np.concatenate(held)
    return {kind: np.unique(x, return_inverse=True) for kind, x in ((WORD, t), (PAIR, pairs(t, starts_of(held))[1]))}


LEVEL_ROWS = "row_ long, doc_id string, held_out boolean, n_tokens long, words binary, pairs binary, head_known long, head_sum double, tail array<long>"


def level_rows(rows: pd.DataFrame, held: list[np.ndarray], word: np.ndarray, pair: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    """LEVEL_ROWS of documents from the levels of their tokens, with what the base score needs."""
    (keys, logs), t, starts = head, np.concatenate(held), starts_of(held)
    edges = starts[1:]
    split = lambda x: [a.tobytes() for a in np.split(x.astype(np.uint8), edges)]
    at = np.minimum(np.searchsorted(keys, t), max(len(keys) - 1, 0))
    known = keys[at] == t if len(keys) else np.zeros(len(t), dtype=bool)
    rest = np.flatnonzero(~known)
    return pd.DataFrame({
        "row_": rows.row_.to_numpy(), "doc_id": rows.doc_id.array, "held_out": rows.held_out.to_numpy(), "n_tokens": [len(x) for x in held], "words": split(word), "pairs": split(pair),
        "head_known": np.add.reduceat(known.astype(np.int64), starts), "head_sum": np.add.reduceat(np.where(known, logs[at], 0.0), starts) if len(keys) else np.zeros(len(held)),
        "tail": [x.view(np.int64) for x in np.split(t[rest], np.searchsorted(rest, edges))]})


def levels_by_worker(docs: DataFrame, names: list[tuple[int, int, str, int]], buckets: int, head) -> DataFrame:
    """LEVEL_ROWS where every worker holds all filters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = worker_filters(names, buckets)
        for rows, held in chunked(batches):
            found = distinct(held)
            word, pair = (filters[kind].levels(found[kind][0])[found[kind][1]] for kind in (WORD, PAIR))
            yield level_rows(rows, held, word, pair, head.value)

    return docs.mapInPandas(run, LEVEL_ROWS)


def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ordered by bucket, a bucket's filter before the n-grams that ask it, which are probed together: with many buckets a chunk asks few of each."""
    at, filt = None, None

    def answered(asked: list[tuple]) -> list[tuple]:
        keys = [np.frombuffer(x[3], "<u8") for x in asked]
        every = np.concatenate(keys)
        own = (filt.levels(every) if at == asked[0][1:3] else np.zeros(len(every))).astype(np.uint8)
        return [(*x[:3], part.tobytes()) for x, part in zip(asked, np.split(own, np.cumsum([len(k) for k in keys])[:-1]), strict=True)]

    for batch in batches:
        found, asked, size = [], [], 0
        for chunk, kind, bucket, keys, name in zip(batch["chunk"], batch["kind"], batch["bucket"], batch["keys"], batch["name"], strict=True):
            if asked and (asked[0][1:3] != (kind, bucket) or size >= TOGETHER):
                found += answered(asked)
                asked, size = [], 0
            if isinstance(name, str):
                at, filt = (kind, bucket), Filters(1, {0: read(name)})
            else:
                asked.append((chunk, kind, bucket, keys))
                size += len(keys) // 8
        if asked:
            found += answered(asked)
        yield pd.DataFrame(found, columns=["chunk", "kind", "bucket", "levels"])


def levels_by_bucket(docs: DataFrame, names: DataFrame, buckets: int, head) -> DataFrame:
    """LEVEL_ROWS where filters stay apart: n-grams go to the task of their bucket and levels come back to their chunk."""
    spark = docs.sparkSession
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, held in chunked(batches):
            chunk, asked = int(rows.row_.iloc[0]), []
            for kind, (keys, _) in distinct(held).items():
                asked += [(chunk, kind, k, x.tobytes()) for k, x in enumerate(np.split(keys, cuts(keys, buckets))) if len(x)]
            yield pd.concat([rows.assign(chunk=chunk, kind=0, bucket=-1, keys=None), pd.DataFrame(asked, columns=["chunk", "kind", "bucket", "keys"]).assign(row_=-1, doc_id=None, held_out=False, text=None)])[
                ["chunk", "kind", "bucket", "keys", "row_", "doc_id", "held_out", "text"]]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ordered by chunk, its documents before the levels of its n-grams."""
        last, rows, got = None, [], {WORD: [], PAIR: []}

        def out() -> pd.DataFrame:
            own = pd.DataFrame(rows, columns=["row_", "doc_id", "held_out", "text"])
            held = [tokens(x) for x in own.text]
            word, pair = (np.frombuffer(b"".join(got[kind]), np.uint8)[back] for kind, (_, back) in distinct(held).items())
            return level_rows(own, held, word, pair, head.value)

        for batch in batches:
            for chunk, kind, row, doc_id, flag, text, levels in zip(batch["chunk"], batch["kind"], batch["row_"], batch["doc_id"], batch["held_out"], batch["text"], batch["levels"], strict=True):
                if rows and chunk != last:
                    yield out()
                    rows, got = [], {WORD: [], PAIR: []}
                last = chunk
                if kind == 0:
                    rows.append((row, doc_id, flag, text))
                else:
                    got[kind].append(levels)
        if rows:
            yield out()

    none = F.lit(None)
    asked = saved(docs.mapInPandas(ask, "chunk long, kind int, bucket int, keys binary, row_ long, doc_id string, held_out boolean, text string"), "asked")
    sent = names.select(F.lit(-1).cast("long").alias("chunk"), "kind", "bucket", none.cast("binary").alias("keys"), "name")
    probed = (asked.where("kind > 0").select("chunk", "kind", "bucket", "keys", none.cast("string").alias("name")).unionByName(sent)
              .repartition(2 * buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("name").isNull()).mapInPandas(probe, "chunk long, kind int, bucket int, levels binary"))
    back = (asked.where("kind = 0").select("chunk", "kind", "bucket", "row_", "doc_id", "held_out", "text", none.cast("binary").alias("levels"))
            .unionByName(probed.select("chunk", "kind", "bucket", F.lit(-1).cast("long").alias("row_"), none.cast("string").alias("doc_id"), F.lit(False).alias("held_out"), none.cast("string").alias("text"), "levels")))
    return back.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket", "row_").mapInPandas(answer, LEVEL_ROWS)


def estimates(first: np.ndarray, pair: np.ndarray, token: np.ndarray, n: int, v: int, less: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(c(pair)/c(first), probability of the token alone) from levels; less: taken off each count."""
    c = np.maximum(RESTORED[pair] - less, 0)
    ratio = np.minimum(c / np.maximum(RESTORED[first] - less, 1e-9), 1.0) * (RESTORED[first] > less)
    return ratio, (np.maximum(RESTORED[token] - less, 0) + 0.5) / (n + 0.5 * (v + 1))


def triples(words: pd.Series, pair: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts of documents, levels of first word, pair, token) of consecutive documents, at most about TOGETHER tokens at once; a
    document's last token is its end, which its first one follows."""
    size = words.map(len).to_numpy(dtype=np.int64)
    part = (np.cumsum(size) - size) // TOGETHER
    for edge in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
        if len(edge):
            token, second = (np.frombuffer(b"".join(x.iloc[edge]), np.uint8).astype(np.int64) for x in (words, pair))
            ends = np.cumsum(size[edge])
            starts = ends - size[edge]
            first = np.concatenate([token[:1], token[:-1]])
            first[starts] = token[ends - 1]
            yield starts, first, second, token


def level_counts(levels: DataFrame) -> np.ndarray:
    """Training tokens of each (first word, pair, token) triple of levels."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(LEVELS ** 3, dtype=np.int64)
        for batch in batches:
            for _, first, second, token in triples(batch.words, batch.pairs):
                found += np.bincount((first * LEVELS + second) * LEVELS + token, minlength=LEVELS ** 3)
        code = np.flatnonzero(found)
        yield pd.DataFrame({"code": code, "n": found[code]})

    got = levels.where(~F.col("held_out")).select("words", "pairs").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most LEVELS ** 3 rows
    out = np.zeros(LEVELS ** 3, dtype=np.int64)
    out[got.code.to_numpy(dtype=np.int64)] = got.n.to_numpy(dtype=np.int64)
    return out


def fitted(counts: np.ndarray, n: int, v: int, rounds: int = 20) -> np.ndarray:
    """Weight of the pair estimate for each level of the first word, from level_counts; each token is left out of its counts."""
    code = np.flatnonzero(counts)
    first, seen = code // LEVELS ** 2, counts[code].astype(np.float64)
    ratio, alone = estimates(first, code // LEVELS % LEVELS, code % LEVELS, n, v, 1.0)
    weights, total = np.full(LEVELS, 0.2), np.bincount(first, seen, minlength=LEVELS)
    for _ in range(rounds):
        w = weights[first]
        share = seen * w * ratio / np.maximum(w * ratio + (1 - w) * alone, 1e-300)
        weights = (np.bincount(first, share, minlength=LEVELS) + 0.2) / (total + 1.0)
    return np.clip(weights, 1e-4, 0.9999)


def score_documents(docs: DataFrame, max_bytes: int = MAX_BYTES, head: int = HEAD, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    docs = with_split(docs, MOD, HELD)
    buckets = buckets or buckets_for(docs)
    grams = count_ngrams(docs, buckets)
    totals = {r["kind"]: r for r in grams.groupBy("kind").agg(F.sum("n_keys").alias("v"), F.sum("total").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    n, v = (totals[WORD]["n"], totals[WORD]["v"]) if totals else (0, 0)
    counts = saved(grams.where(F.col("kind") == WORD).select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select(F.col("x.keys").alias("h"), F.col("x.counts").alias("c")), "word-counts")
    top = counts.orderBy(F.desc("c"), "h").limit(head).toArrow().to_pandas()  # at most ``head`` rows
    order = np.argsort(top.h.to_numpy(dtype=np.int64).view(np.uint64))
    heads = spark.sparkContext.broadcast((top.h.to_numpy(dtype=np.int64).view(np.uint64)[order], np.log10(top.c.to_numpy(dtype=np.float64)[order] + 0.5)))
    numbered = docs.withColumn("row_", F.monotonically_increasing_id())
    names = grams.select("kind", "bucket", "name")
    with small_batches(spark):
        if sum(r["bytes"] for r in totals.values()) <= max_bytes:
            made = levels_by_worker(numbered, [tuple(r) for r in grams.select("kind", "bucket", "name", "bytes").orderBy("kind", "bucket").collect()], buckets, heads)  # no more names than filters of max_bytes
        else:
            made = levels_by_bucket(numbered, names, buckets, heads)
        levels = saved(made, "levels")
        weights = fitted(level_counts(levels), n, v)

    def score(words: pd.Series, pair: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for starts, first, second, token in triples(words, pair):
            ratio, alone = estimates(first, second, token, n, v)
            w = weights[first]
            out.append(np.add.reduceat(np.log10(w * ratio + (1 - w) * alone), starts))
        return pd.Series(np.concatenate(out))

    tail = (levels.select("row_", F.explode("tail").alias("h")).groupBy("row_", "h").agg(F.count("*").alias("k")).join(counts, "h", "left")
            .groupBy("row_").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_sum"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known")))
    scored = levels.select("row_", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", F.pandas_udf(score, "double")("words", "pairs").alias("score"))
    floor = F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return scored.join(tail, "row_", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
