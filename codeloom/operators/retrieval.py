"""Vector retrieval: exact k nearest by cosine, per-file ranking, cells of an inverted index, re-ranking, caches.

A stated set of queries meets all chunks in blocks: queries are written to the shared folder, ``QUERY_ROWS`` a file at most, a task reads one file after
another, multiplies it with ``CHUNK_ROWS`` chunks and keeps what the operator asks for (the k best, the best of a label, counts). No row is made for
a pair, neither the driver nor a task ever holds more than a block of queries, and a task holds ``CELLS`` cosines at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.vectors import doubles
from codeloom.session import stored

#: Query rows that one block holds, about, and chunks that meet a block at once.
QUERY_ROWS, CHUNK_ROWS = 4_096, 16_384
#: Cosines that a task holds at once, about: queries of a block meet the chunks some at a time.
CELLS = 1 << 20


def unit(vectors: list, width: int) -> np.ndarray:
    """Vectors of ``width`` numbers scaled to length 1; others, and those without a length, are zero."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == width:
            x = np.asarray(v, dtype=np.float64)
            n = np.linalg.norm(x)
            if np.isfinite(n) and n > 0:
                out[k] = x / n
    return out


def gathered(batches: Iterator[pd.DataFrame], rows: int = CHUNK_ROWS) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``rows`` rows, so that blocks are read once for many chunks."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def read_block(uri: str) -> pd.DataFrame:
    """One file of the shared folder, by whatever store its scheme names."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, path = fs.FileSystem.from_uri(uri)
    return pq.read_table(path, filesystem=store, columns=["query_id", "query_vector"]).to_pandas()


def in_blocks(chunks: DataFrame, queries: DataFrame, keep: Callable[[np.ndarray, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str, query_rows: int = QUERY_ROWS) -> DataFrame:
    """chunks (vector and others) against queries (query_id, query_vector): what keep(query ids, cosines by query and chunk, chunks) gives for some thousand
    chunks and a block of queries. The driver sees the names of the files only."""
    own = stored(queries.select("query_id", "query_vector").where("query_vector is not null and size(query_vector) > 0"), "queries")
    parts = max(1, -(-own.count() // query_rows))
    files = stored(own.repartition(parts) if parts > 1 else own.coalesce(1), "query-blocks").inputFiles()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, pd.DataFrame] = {}
        for batch in gathered(batches):
            for file in files:
                if file not in last:
                    last = {file: read_block(file)}
                block = last[file]
                for width, g in block.groupby(block.query_vector.map(len)):
                    ids, q, c = g.query_id.to_numpy(), unit(g.query_vector.tolist(), int(width)), unit(batch.vector.tolist(), int(width)).T
                    step = max(1, CELLS // max(1, len(batch)))
                    for i in range(0, len(ids), step):
                        yield keep(ids[i:i + step], q[i:i + step] @ c, batch)

    return chunks.mapInPandas(run, schema)


def scored(chunks: DataFrame, queries: DataFrame, query_rows: int = QUERY_ROWS) -> DataFrame:
    """chunks with every query_id and its score: all pairs, for one question or a small store; searches keep the best (``nearest``)."""
    fields = [("query_id", queries.schema["query_id"].dataType), *((f.name, f.dataType) for f in chunks.schema.fields)]

    def keep(ids: np.ndarray, s: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([batch.assign(query_id=q, score=s[k]) for k, q in enumerate(ids)]) if len(ids) else batch.assign(query_id=0, score=0.0).iloc[:0]

    return in_blocks(chunks, queries, lambda *x: keep(*x)[[n for n, _ in fields] + ["score"]], ", ".join(f"`{n}` {t.simpleString()}" for n, t in fields) + ", score double", query_rows)


def nearest(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.1, inclusive: bool = False) -> DataFrame:
    """query_id, id, score, rank of the k best chunks (id, vector) of each query over the threshold, itself left out; ties by id."""

    def keep(ids: np.ndarray, s: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        own = batch.id.to_numpy()
        s = np.where((s >= threshold if inclusive else s > threshold) & (ids[:, None] != own[None]), s, -np.inf)
        # only what reaches a query's k-th best score is sorted
        least = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]] if s.shape[1] > k else -np.inf
        row, at = np.nonzero((s >= least) & np.isfinite(s))
        order = np.lexsort((own[at], -s[row, at], row))
        row, at = row[order], at[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"query_id": ids[row[best]], "id": own[at[best]], "score": s[row, at][best]})

    return top_k(in_blocks(chunks.select("id", "vector"), queries, keep, "query_id long, id long, score double"), k, -2.0)


def nearest_per(chunks: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query_id, key, id, score: the best chunk (id, key, vector) of each query and key, itself left out; ties by id."""
    kind = chunks.schema[key].dataType.simpleString()

    def keep(ids: np.ndarray, s: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        own, made = batch.id.to_numpy(), []
        s = np.where(ids[:, None] != own[None], s, -np.inf)
        for name, rows in batch.groupby(key, sort=False, dropna=False).indices.items():
            rows = rows[np.argsort(own[rows], kind="stable")]
            best = rows[s[:, rows].argmax(1)]
            made.append(pd.DataFrame({"query_id": ids, key: name, "id": own[best], "score": s[np.arange(len(ids)), best]}))
        got = pd.concat(made) if made else pd.DataFrame({"query_id": [], key: [], "id": [], "score": []})
        return got[np.isfinite(got.score.to_numpy(dtype=float))]

    return best_per(in_blocks(chunks.select("id", key, "vector"), queries, keep, f"query_id long, {key} {kind}, id long, score double"), key)


def hit_modes(chunks: DataFrame, queries: DataFrame, least: float = 0.3) -> DataFrame:
    """query_id, strict and inclusive (chunks over, and at or over, a score of ``least``) and best score, the query itself left out."""

    def keep(ids: np.ndarray, s: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        other = ids[:, None] != batch.id.to_numpy()[None]
        return pd.DataFrame({"query_id": ids, "strict": ((s > least) & other).sum(1), "inclusive": ((s >= least) & other).sum(1), "best": np.where(other, np.maximum(s, 0.0), -1.0).max(1, initial=-1.0)})

    parts = in_blocks(chunks.select("id", "vector"), queries, keep, "query_id long, strict long, inclusive long, best double")
    return parts.groupBy("query_id").agg(F.sum("strict").alias("strict"), F.sum("inclusive").alias("inclusive"), F.max("best").alias("best")).where("best >= 0")


def top_k(hits: DataFrame, k: int = 5, threshold: float = 0.1, inclusive: bool = False, tie: str = "id") -> DataFrame:
    """The k best of each query over the threshold, ties by id; ranks from 1."""
    enough = F.col("score") >= threshold if inclusive else F.col("score") > threshold
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return hits.where(enough).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per(hits: DataFrame, key: str, tie: str = "id") -> DataFrame:
    """The best hit of each query and key (one chunk a file)."""
    return hits.groupBy("query_id", key).agg(F.max_by(F.struct(tie, "score"), F.struct("score", F.negative(F.col(tie)))).alias("b_")).select("query_id", key, f"b_.{tie}", "b_.score")


def keyword_score(question: Column, content: Column) -> Column:
    """Share of the question's distinct words (3 letters or more) that the content has."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^a-z0-9_]+"), lambda w: F.length(w) >= 3))
    asked = words(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(content))) / F.size(asked)).otherwise(0.0)


def rerank(hits: DataFrame, question: str = "question", content: str = "content", path: str = "file_path", semantic: float = 0.7, boost: float = 0.2) -> DataFrame:
    """Adds final_score: semantic and keyword parts, and a boost where the question names the file."""
    named = F.contains(F.lower(F.col(question)), F.lower(F.element_at(F.split(F.col(path), "/"), -1)))
    return hits.withColumn("final_score", F.col("score") * semantic + keyword_score(F.col(question), F.col(content)) * (1 - semantic) + F.when(named, boost).otherwise(0.0))


def centroids(vectors: DataFrame, cell: str, column: str = "embedding") -> DataFrame:
    """Mean vector of each cell, component by component."""
    each = vectors.select(cell, F.posexplode(doubles(column)).alias("i", "x")).groupBy(cell, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_cell(vectors: DataFrame, cells: DataFrame, cell: str, probes: int = 1, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``probes`` nearest cells of every vector by cosine; cells are few (their number is fixed with the index), and ranked within the row of a vector."""
    if cells.count() > QUERY_ROWS:
        raise ValueError("more cells than an index may have")
    known = cells.select(cell, "centroid").toArrow().to_pandas().sort_values(cell)  # at most QUERY_ROWS rows
    kind = {n: vectors.schema[n].dataType.simpleString() for n in (key,)} | {cell: cells.schema[cell].dataType.simpleString()}
    sent = vectors.sparkSession.sparkContext.broadcast((known[cell].tolist(), {int(w): (g.index.to_numpy(), unit(g.centroid.tolist(), int(w))) for w, g in known.reset_index(drop=True).groupby(known.reset_index(drop=True).centroid.map(len))}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, by_width = sent.value
        for batch in batches:
            for width, (at, centres) in by_width.items():
                own = batch[batch[column].map(lambda v, width=width: v is not None and len(v) == width)]
                s = unit(own[column].tolist(), width) @ centres.T
                order = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                n = order.shape[1]
                yield pd.DataFrame({key: np.repeat(own[key].to_numpy(), n), cell: [names[at[j]] for j in order.ravel()], "probe": np.tile(np.arange(1, n + 1), len(own)), "similarity": np.take_along_axis(s, order, 1).ravel()})

    return vectors.select(key, column).mapInPandas(run, f"{key} {kind[key]}, {cell} {kind[cell]}, probe int, similarity double")


def ivf_shape(n: int) -> tuple[int, int]:
    """Cells and probes of an index over n vectors: 4 sqrt(n) and an eighth of them; one cell up to 500."""
    if n <= 500:
        return 1, 1
    cells = max(1, int(4 * n ** 0.5))
    return cells, max(1, cells // 8)


def sub_index(language: Column | str) -> Column:
    """Which of the three indexes a chunk belongs to."""
    lang = F.col(language) if isinstance(language, str) else language
    return F.when(lang.isin("Markdown"), "doc").when(lang.isin("JSON", "YAML", "TOML", "XML", "Environment", "Dockerfile", "Makefile", "Git Config"), "config").otherwise("code")


def embed_once(rows: DataFrame, text: str, embed) -> DataFrame:
    """Adds vector, computed once for each distinct text by the column function ``embed`` and joined back by content key."""
    keyed = rows.withColumn("key_", F.sha2(F.coalesce(text, F.lit("")), 256))
    vectors = keyed.groupBy("key_").agg(F.min(text).alias("t_")).select("key_", embed(F.col("t_")).alias("vector"))
    return keyed.join(vectors, "key_").drop("key_")
