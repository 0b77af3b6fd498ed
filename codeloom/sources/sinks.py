"""Stores as Parquet tables partitioned by project: overwrite, append, upsert, delete, expiry, checks before writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.relational import upsert

VECTORS = ("project_id", "chunk_hash", "file_path", "language", "content", "start_line", "end_line", "function_name", "symbol_type", "token_count", "vector")


def overwrite_projects(rows: DataFrame, path: str, key: str = "project_id") -> None:
    """Replaces the partitions of the projects in rows and leaves all others."""
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_projects(spark: SparkSession, path: str, project=None, key: str = "project_id") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if project is None else rows.where(F.col(key) == F.lit(project))


def checked_index(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """chunks joined with their vectors; fails when a chunk has none, a vector has no chunk, or there are no chunks."""
    both = chunks.withColumn("c_", F.lit(1)).join(vectors.withColumn("v_", F.lit(1)), key, "full")
    broken = both.agg(F.count("*").alias("n"), F.count_if(F.col("c_").isNull() | F.col("v_").isNull()).alias("bad")).first()
    if not broken["n"] or broken["bad"]:
        raise ValueError(f"{broken['n']} chunks and vectors, {broken['bad']} without the other")
    return both.drop("c_", "v_")


def collection_rows(chunks: DataFrame, project: str = "project_id") -> DataFrame:
    """Rows of an append: id, document (with a header naming its function or class), batch of 20."""
    w = Window.partitionBy(project).orderBy("file_path", "start_line", "end_line")
    n = F.row_number().over(w) - 1
    head = F.when(F.col("function_name").isNotNull(), F.concat(F.when(F.col("symbol_type") == "class", "[Class: ").otherwise("[Function: "), "function_name", F.lit("]\n"))).otherwise("")
    return chunks.withColumn("position", n).withColumn("id", F.concat_ws("_", project, F.lit("chunk"), F.col("position"))).withColumn("document", F.concat(head, "content")).withColumn("batch", F.floor(F.col("position") / 20))


def append(rows: DataFrame, path: str, key: str = "project_id") -> None:
    rows.write.mode("append").partitionBy(key).parquet(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Writes the upserted table as a new version next to the old one (a table is never overwritten while it is read)."""
    old = spark.read.parquet(path)
    upsert(old, new, keys).write.mode("errorifexists").parquet(version)
    return spark.read.schema(old.schema).parquet(version)


def drop_project(spark: SparkSession, path: str, project, key: str = "project_id") -> None:
    """Removes a project's partition."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={project}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "project_id") -> dict[str, DataFrame]:
    """Every table without the rows of the projects in gone."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def aged_out(uploads: DataFrame, modified: str = "modified_at", hours: int = 24) -> DataFrame:
    return uploads.where(F.col(modified) < F.current_timestamp() - F.expr(f"INTERVAL {hours} HOURS"))


def compact_cache(rows: DataFrame, keep: int = 3, batch: str = "batch_ts", key: str = "cache_key") -> DataFrame:
    """Entries of the last ``keep`` batches, the latest of each key."""
    last = rows.select(batch).distinct().orderBy(F.desc(batch)).limit(keep)
    return rows.join(F.broadcast(last), batch, "left_semi").groupBy(key).agg(F.max_by("vector", batch).alias("vector"), F.max(batch).alias(batch))
