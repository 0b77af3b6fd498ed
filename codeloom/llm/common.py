"""Shared helpers of the corpus operators: shared storage, hashing of splits, sampling of labels."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import own_dir, remove

#: Bytes of sampled texts that come to the driver, at most.
SAMPLE_BYTES = 32 << 20


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later stages start from files that
    survive a lost executor, and no expression above it is evaluated twice."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """As saved, with a call that deletes the table once nothing reads it any more."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: remove(spark, path)


def opened(uri: str, mode: str):
    """A binary stream on any store that pyarrow knows by its URI (file, hdfs, s3, gs)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_stream(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Within it, jobs hand texts to Python ``rows`` at a time, so that a worker holds few whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col, mod: int):
    """crc32 of the id's decimal text, modulo mod: the split rule of the learned operators."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def with_split(docs: DataFrame, mod: int, held: int) -> DataFrame:
    """doc_id (as text: whole numbers beside nulls would pass through floats in pandas), held_out, text of every row of docs."""
    split = F.coalesce(crc_mod(F.col("doc_id").cast("long"), mod) == held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), split.alias("held_out"), F.col("text").cast("string").alias("text"))


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest key hash: the same at every partitioning."""
    return df.orderBy(F.xxhash64(key), F.col(key)).limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int, most: int = SAMPLE_BYTES) -> pd.DataFrame:
    """doc_id, label_, text of at most ``rows`` training documents with at most ``most`` bytes of text together, on the driver.

    The labels are sampled first, so the side that is broadcast holds no more than ``rows`` rows whatever the input; rows of the held-out
    remainder and null labels or ids never leave the executors. In order of the id's hash a document is taken where its text still
    fits. Of rows that repeat a doc_id the smallest text counts, of labels the largest.
    """
    picked = sample_by_hash(
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), mod) != held))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label_")), "doc_id", rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = saved(own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label_").agg(F.min("text").alias("text")), "labelled")
    sizes = texts.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).toArrow().to_pandas().sort_values(["h", "doc_id"])
    left, chosen = most, []
    for doc_id, n in zip(sizes.doc_id.tolist(), sizes.n.tolist(), strict=True):
        if n <= left:
            left -= n
            chosen.append((doc_id,))
    if len(chosen) < len(sizes):
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    return texts.toArrow().to_pandas().sort_values("doc_id").reset_index(drop=True)
