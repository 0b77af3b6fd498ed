"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Three steps. (1) Tasks tokenise whole texts and cut documents of more than ``capacity`` ids into pieces. (2) The
plan is made on the driver from the histogram of piece lengths, at most ``capacity`` rows whatever the corpus: longest
first, the gap it leaves is looked up in an index of single lengths, pair sums and triple sums that fill it exactly under the
counts still available; where none does, the one of them that leaves the least goes in (best fit) and the rest of the gap is
tried again. Every length of the histogram is in the index, none is capped. A pattern is used as often as its counts allow at once, so the plan has rows per pattern, not per document.
(3) Every piece gets its rank within its length, from ranks within (length, bucket) and the buckets' counts, and
looks up its pattern, sequence and offset by that rank. No task holds all pieces of a length.

Defined results: ids beside nulls stay exact; null text is empty, and an empty document is its end id alone; rows that repeat a doc_id are packed
each; an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import saved, table

CAPACITY = 4096
END_ID = 1
#: Distinct strings whose ids a worker remembers, of each kind (about 250 bytes each); beyond that it forgets all of the kind.
REMEMBERED = 800_000
#: Texts encoded together.
TOGETHER = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Letters beyond ASCII whose lower-casing and composition concern one character alone.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[\\t-\\r\\x20-\\x7e{_LATIN}]*")
_PIECE = re.compile(f"[a-z{_LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\t-\\r a-z0-9{_LATIN}]+")
_SPACES = re.compile("[\x1c-\x1f]")


class WordEncoder:
    """Ids of whole texts, little-endian unsigned 32 bit, as word_bpe_49k.json gives them.

    A text of ASCII and Latin letters is cut into the tokenizer's own words, whose ids are looked up; unknown ones are encoded
    many at a time, which their end-of-word ids allow. The tokenizer never joins across white space, so of any other
    text the strings between white space are looked up or encoded one by one, and a text with one of \\x1c-\\x1f, which
    only Python's split() takes for white space, is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.strings: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 2000):
            part = new[at:at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                self.words.update(zip(part, (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
            else:
                self.words.update((x, self.encode(x)) for x in part)

    def apart(self, text: str) -> bytes:
        if _SPACES.search(text):
            return self.encode(text)
        if len(self.strings) > REMEMBERED:
            self.strings.clear()
        words = text.split()
        self.strings.update((x, self.encode(x)) for x in set(words).difference(self.strings))
        return b"".join(map(self.strings.__getitem__, words))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        get = self.words.__getitem__
        for at in range(0, len(texts), TOGETHER):
            part = texts[at:at + TOGETHER]
            cut = [_PIECE.findall(x.lower()) if "<|" not in x and _PLAIN.fullmatch(x) else None for x in part]
            seen = set().union(*(x for x in cut if x))
            new = seen.difference(self.words)
            if len(self.words) + len(new) > REMEMBERED:
                self.words.clear()
                new = seen
            self.learn(list(new))
            for text, words in zip(part, cut, strict=True):
                yield self.apart(text) if words is None else b"".join(map(get, words))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece (PIECES), with its ids on demand."""
    name = tokenizer or vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = WordEncoder(name), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.doc_id, encoder.texts(batch.text.tolist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("i8")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = PIECES + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        cut, schema.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


class Sums:
    """Index of single lengths, pair sums and triple sums under the counts that are left.

    For every sum it keeps the longest first length at which a pair or triple may still be found. Counts only fall, so what was not
    found once never comes back: entries move down and each is looked at once, whatever the number of searches.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length}")
            self.left[length] = n
        self.first2 = np.maximum(np.arange(capacity + 1) - 1, 0)
        self.first3 = np.maximum(np.arange(capacity + 1) - 2, 0)

    def _pair(self, total: int, top: int, without: int = 0) -> tuple[int, int] | None:
        """The pair with the longest first of at most ``top``, one piece of the length ``without`` being used otherwise."""
        a = np.arange(min(top, total - 1), (total - 1) // 2, -1)
        b = total - a
        ok = (self.left[a] > (a == without)) & (self.left[b] > (b == without).astype(np.int64) + (a == b))
        return (int(a[k]), int(b[k])) if a.size and ok[k := int(ok.argmax())] else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        found = self._pair(total, int(self.first2[total])) if self.first2[total] else None
        self.first2[total] = found[0] if found else 0
        return found

    def triple(self, total: int) -> tuple[int, ...] | None:
        top = int(self.first3[total])
        a = np.arange(top, -(-total // 3) - 1, -1) if top else np.zeros(0, dtype=np.int64)
        for x in a[(self.left[a] > 0) & (self.first2[total - a] > 0)].tolist():
            rest = self.pair(total - x)
            if rest and (x in rest):
                rest = self._pair(total - x, total - x - 1, x)
            if rest:
                self.first3[total] = x
                return x, *rest
        self.first3[total] = 0
        return None

    def best(self, gap: int) -> tuple[int, ...] | None:
        """The single length, pair or triple that fills the gap exactly or, where none does, leaves the least of it."""
        may = np.flatnonzero((self.left[1:gap + 1] > 0) | (self.first2[1:gap + 1] > 0) | (self.first3[1:gap + 1] > 0))[::-1] + 1
        for total in may.tolist():
            found = (total,) if self.left[total] > 0 else self.pair(total) or self.triple(total)
            if found:
                return found
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that use it; every pattern sums to at most capacity."""
    sums, made = Sums(counts, capacity), []
    left = sums.left
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            pattern, gap = [length], capacity - length
            while gap > 0 and (found := sums.best(gap)):
                for x in found:
                    left[x] -= 1
                pattern += found
                gap -= sum(found)
            uses = Counter(pattern)
            more = min(int(left[x]) // n for x, n in uses.items())
            for x, n in uses.items():
                left[x] -= n * more
            made.append((tuple(pattern), more + 1))
    return made


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset, uses in the sequence), by first rank."""
    found: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, uses in sorted(Counter(pattern).items(), reverse=True):
            found.setdefault(length, []).append((used[length], sequence, offset, uses))
            used[length] += uses * n
            offset += uses * length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def ranked(cut: DataFrame) -> DataFrame:
    """cut (with a number of its own for each row, row_) with rank_ from 0 within its length; the work on one length is spread over buckets."""
    buckets = max(8, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = cut.withColumn("bucket_", F.pmod(F.xxhash64("row_"), F.lit(buckets)).cast("int"))
    each = own.groupBy("length", "bucket_").agg(F.count("*").alias("n_"))
    before = each.select("length", "bucket_", (F.sum("n_").over(Window.partitionBy("length").orderBy("bucket_")) - F.col("n_")).alias("before_"))
    local = F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("row_")) - 1
    return (own.withColumn("local_", local).join(before, ["length", "bucket_"])
            .withColumn("rank_", F.col("before_") + F.col("local_")).drop("bucket_", "local_", "before_", "row_"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset (and ids on demand). Sequences number from 0 without gaps."""
    cut = saved(pieces(docs, capacity, tokenizer, with_ids).withColumn("row_", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    at = cut.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    columns = [f for f in cut.schema if f.name != "row_"]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, offset long"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for length, rows in batch.groupby("length").indices.items():
                first, base, start, uses = at.value[length].T
                rank = batch.rank_.to_numpy()[rows]
                k = np.searchsorted(first, rank, side="right") - 1
                sequence[rows] = base[k] + (rank - first[k]) // uses[k]
                offset[rows] = start[k] + (rank - first[k]) % uses[k] * length
            yield batch.drop(columns="rank_").assign(sequence_id=sequence, offset=offset)

    got = ranked(cut.withColumn("doc_id", F.col("doc_id").cast("string"))).select(*[f.name for f in columns], "rank_").mapInPandas(place, out.replace("doc_id bigint", "doc_id string"))
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
