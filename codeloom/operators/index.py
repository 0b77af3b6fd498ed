"""Approximate nearest neighbours: an inverted index with learned cells and sub-indexes by kind, and hash tables of random hyperplanes.

Both place every vector under codes and let a query probe some of them; ``probe`` does the search. Codes are dealt to slots, a slot's rows are
split into parts of ``PART_ROWS`` and its queries into parts of ``PART_QUERIES``, and every pair of parts is one small group: rows are copied to each part of
the other side, so a crowded code is spread over tasks and never gathered. Inside a group each code's rows are multiplied with its queries, ``CELLS`` products
at once, and only the k best of a query in the group are kept; a vector found under several codes counts once. Scores are exact cosines. Vectors are sent as they
came, floats as floats, and scaled in the group.

Defined results: null, empty, zero and non-finite vectors, and those of another width than ``width``, are not found and find nothing; a query never
finds its own id; ties go to the smaller id; rows that repeat an id count as one hit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.retrieval import CELLS, ivf_shape, top_k, unit
from codeloom.session import stored

#: Rows of vectors and of queries in one group, about.
PART_ROWS, PART_QUERIES = 16_384, 4_096
#: Slots that cells are dealt to: a query leaves its k best in each, so their number does not grow with the cells. Buckets of a hash table that make a slot.
SLOTS, BUCKETS = 16, 64
#: Vectors that cells are learned from, at most; cells of a sub-index, at most; nearest cells that keep a vector; rounds of learning.
SAMPLE, MOST_CELLS, COPIES, ROUNDS = 20_000, 4_096, 4, 8
#: Hash tables, hyperplanes of each, and buckets that a query probes in each, the likeliest first.
TABLES, BITS, PROBES, SEED = 16, 10, 32, 17


def valid(rows: DataFrame, column: str, width: int) -> DataFrame:
    """Rows whose vector has ``width`` finite components, not all zero."""
    x = F.col(column).cast("array<double>")
    return rows.where((F.size(x) == width) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & F.exists(x, lambda c: c != 0))


def sent_as(rows: DataFrame, column: str) -> str:
    """The type that a column of vectors is sent as: floats stay floats, all others are doubles."""
    return "array<float>" if rows.schema[column].dataType.simpleString() == "array<float>" else "array<double>"


def parts_of(counts: DataFrame, n: str, rows: int, name: str) -> DataFrame:
    return counts.select("slot_", F.ceil(F.col(n) / rows).cast("int").alias(name))


def probe(placed: DataFrame, asked: DataFrame, k: int, threshold: float, rows: int = PART_ROWS, queries: int = PART_QUERIES) -> DataFrame:
    """query_id, id, score, rank: placed (slot_, code_, id, vector) against asked (slot_, codes_, query_id, query_vector)."""
    placed, asked = stored(placed, "placed"), stored(asked, "asked")
    sizes = stored(parts_of(placed.groupBy("slot_").agg(F.count("*").alias("n")), "n", rows, "parts_").join(
        parts_of(asked.groupBy("slot_").agg(F.count("*").alias("n")), "n", queries, "query_parts_"), "slot_"), "slots")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = placed.join(sizes, "slot_").select("slot_", mine("id", "parts_").alias("part_"), every("query_parts_").alias("query_part_"), "code_", "id", "vector")
    right = asked.join(sizes, "slot_").select("slot_", every("parts_").alias("part_"), mine("query_id", "query_parts_").alias("query_part_"), "codes_", "query_id", "query_vector")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            width = len(a.vector.iloc[0])
            x, q = unit(a.vector.tolist(), width), unit(b.query_vector.tolist(), width)
            own, asks = a.id.to_numpy(), b.query_id.to_numpy()
            place = np.repeat(np.arange(len(b)), b.codes_.map(len))
            by = pd.Series(place).groupby(np.concatenate(b.codes_.to_numpy())).indices
            for code, at in a.groupby("code_").indices.items():
                if code in by:
                    step = max(1, CELLS // len(at))
                    for i in range(0, len(by[code]), step):
                        of = place[by[code][i:i + step]]
                        s = q[of] @ x[at].T
                        s = np.where((s > threshold) & (asks[of][:, None] != own[at][None]), s, -np.inf)
                        order = np.lexsort((np.broadcast_to(own[at], s.shape), -s), axis=1)[:, :k]
                        r = np.repeat(np.arange(len(of)), order.shape[1]), order.ravel()
                        ok = np.isfinite(s[r])
                        found.append(pd.DataFrame({"query_id": asks[of][r[0][ok]], "id": own[at][r[1][ok]], "score": s[r][ok]}))
        if not found:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        best = pd.concat(found).drop_duplicates(["query_id", "id"]).sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
        return best.groupby("query_id").head(k)

    key = ["slot_", "part_", "query_part_"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, id long, score double")
    return top_k(hits.groupBy("query_id", "id").agg(F.max("score").alias("score")), k, threshold)


def learned_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``cells`` cells of a sample of unit vectors, by spherical k-means; the first vectors are the first centres."""
    c = sample[:cells].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i:i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.where(n > 0, n, 1), c)
    return c


def cells_by_kind(chunks: DataFrame, width: int, sample: int = SAMPLE, most: int = MOST_CELLS) -> dict[str, tuple[np.ndarray, int]]:
    """kind: (centres, probes) of each sub-index, learned from the ``sample`` vectors of it whose ids hash smallest.

    Kinds are few (code, doc, config), so their counts and samples, bounded by the parameter, come to the driver.
    """
    out = {}
    for row in chunks.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect():
        cells, _ = ivf_shape(row.n)
        picked = chunks.where(F.col("kind").eqNullSafe(row.kind)).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector").to_pylist()
        known = np.unique(unit(picked, width), axis=0)
        order = np.random.default_rng(SEED).permutation(len(known))
        cells = min(cells, most, len(known))
        out[row.kind] = learned_cells(known[order], cells), max(1, cells // 8)
    return out


def _numbered(cells: dict[str, tuple[np.ndarray, int]]) -> dict[str, int]:
    """The first code of each kind: codes of all sub-indexes are one row of numbers."""
    out, at = {}, 0
    for kind, (c, _) in cells.items():
        out[kind], at = at, at + len(c)
    return out


def ivf_search(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.1, width: int = 64, kinds: list[str] | None = None, copies: int = COPIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, id, score, rank of the best chunks (id, kind, vector) of queries (query_id, query_vector) in the sub-indexes of ``kinds``, else of all.

    A sub-index of up to 500 vectors is one cell. Above, it has 4 sqrt(n) cells, at most ``MOST_CELLS``, and a query probes an eighth of them. Every vector is kept in
    its ``copies`` nearest cells: one alone misses a third of the neighbours of vectors that have no clusters.
    """
    own = valid(chunks, "vector", width).select(F.col("id").cast("long").alias("id"), "kind", F.col("vector").cast(sent_as(chunks, "vector")).alias("vector"))
    if kinds is not None:
        own = own.where(F.col("kind").isin(kinds))
    cells = cells_by_kind(own, width, sample)
    first = _numbered(cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, rows in batch.groupby("kind", dropna=False):
                kind = None if pd.isna(kind) else kind
                c, x = cells[kind][0], unit(rows.vector.tolist(), width)
                n = min(copies, len(c))
                code = first[kind] + (np.argpartition(-(x @ c.T), n - 1, axis=1)[:, :n] if n < len(c) else np.broadcast_to(np.arange(n), (len(x), n)))
                yield pd.DataFrame({"code_": code.ravel(), "id": np.repeat(rows.id.to_numpy(), n), "vector": [v for v in rows.vector for _ in range(n)]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = unit(batch.query_vector.tolist(), width)
            for kind, (c, probes) in cells.items():
                code = first[kind] + (np.argpartition(-(q @ c.T), probes - 1, axis=1)[:, :probes] if probes < len(c) else np.broadcast_to(np.arange(len(c)), (len(q), len(c))))
                yield pd.DataFrame({"codes_": list(code), "query_id": batch.query_id, "query_vector": batch.query_vector})

    placed = own.mapInPandas(place, f"code_ long, id long, vector {sent_as(chunks, 'vector')}").select(by_cell(F.col("code_")).alias("slot_"), "code_", "id", "vector")
    return probe(placed, _dealt(valid(queries, "query_vector", width), ask, by_cell), k, threshold)


def by_cell(code: Column) -> Column:
    return F.pmod(code, F.lit(SLOTS))


def by_table(code: Column) -> Column:
    """A slot has buckets of one table only, as a query probes every table."""
    return F.floor(code / BUCKETS)


def _dealt(queries: DataFrame, ask, slot) -> DataFrame:
    """Rows of probed codes (codes_, query_id, query_vector), one for every slot that they lie in."""
    kind = sent_as(queries, "query_vector")
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast(kind).alias("query_vector")).mapInPandas(ask, f"codes_ array<long>, query_id long, query_vector {kind}")
    each = rows.withColumn("slot_", F.explode(F.array_distinct(F.transform("codes_", slot))))
    return each.select("slot_", F.filter("codes_", lambda c: slot(c) == F.col("slot_")).alias("codes_"), "query_id", "query_vector")


def planes(width: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Hyperplanes of the tables (tables, width, bits); those of a table are at right angles as far as the width allows."""
    rng = np.random.default_rng(seed)
    blocks = [np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-bits // width))], 1)[:, :bits] for _ in range(tables)]
    return np.stack(blocks)


def flips(bits: int, most: int = 3) -> np.ndarray:
    """Which bits a probe turns over: none, and all choices of up to ``most``."""
    rows = [c for r in range(min(most, bits) + 1) for c in combinations(range(bits), r)]
    out = np.zeros((len(rows), bits), dtype=bool)
    for i, c in enumerate(rows):
        out[i, list(c)] = True
    return out


def hash_search(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.1, width: int = 64, tables: int = TABLES, bits: int = BITS, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, id, score, rank of the best chunks (id, vector) of queries (query_id, query_vector).

    A vector's bucket in a table is the side of each hyperplane that it is on. A query probes its own bucket and those that it is nearest to: the sum of
    squared distances to the hyperplanes that would have to be crossed decides (up to three of them).
    """
    h, masks = planes(width, tables, bits, seed), flips(bits)
    weight = 1 << np.arange(bits, dtype=np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = unit(batch.vector.tolist(), width)
            for t in range(tables):
                yield pd.DataFrame({"code_": (t << bits) + ((x @ h[t] > 0) * weight).sum(1), "id": batch.id, "vector": batch.vector})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = min(probes, len(masks))
        for batch in batches:
            q = unit(batch.query_vector.tolist(), width)
            for t in range(tables):
                m = q @ h[t]
                best = np.argsort((m ** 2) @ masks.T, axis=1, kind="stable")[:, :n]
                code = (((m > 0)[:, None] ^ masks[best]) * weight).sum(2)
                yield pd.DataFrame({"codes_": list((t << bits) + code), "query_id": batch.query_id, "query_vector": batch.query_vector})

    own = valid(chunks, "vector", width).select(F.col("id").cast("long").alias("id"), F.col("vector").cast(sent_as(chunks, "vector")).alias("vector"))
    placed = own.mapInPandas(place, f"code_ long, id long, vector {sent_as(chunks, 'vector')}").select(by_table(F.col("code_")).alias("slot_"), "code_", "id", "vector")
    return probe(placed, _dealt(valid(queries, "query_vector", width), ask, by_table), k, threshold)
