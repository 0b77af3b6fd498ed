"""ZIP archives of file tables and landed pages of listings, written by tasks to a folder that executors share."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.readers import opened


def _placed(uri: str, write) -> None:
    """Writes beside ``uri`` and moves there at the end, so that a task tried again leaves one whole file."""
    store, path = opened(uri)
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    beside = f"{folder}/.{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(beside) as f:
        write(f)
    store.move(beside, path)


def write_archives(files: DataFrame, folder: str, top: str = "top") -> DataFrame:
    """project_id, n_files of the archives ``<project_id>.zip`` written when the result is computed; files (project_id, file_path, content); null contents are empty files.

    A project is written by one task, batch by batch and member by member; null projects and paths have no archive.
    """

    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def zipped(f):
            nonlocal n
            with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for batch in batches:
                    for path, content in zip(batch["file_path"], batch["content"], strict=True):
                        z.writestr(f"{top}/{path.as_py()}", (content.as_py() or "").encode())
                        n += 1

        n = 0
        _placed(f"{folder}/{key[0].as_py()}.zip", zipped)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([n], pa.int64())], names=["project_id", "n_files"])

    own = files.where("project_id is not null and file_path is not null").select("project_id", "file_path", "content")
    return own.groupBy("project_id").applyInArrow(write, "project_id string, n_files long")


def write_pages(rows: DataFrame, folder: str, page: str = "page") -> DataFrame:
    """page, n of the files ``<page>.json`` written when the result is computed: each page's rows (of a listing's fields, in order of id) as a JSON array.

    A page's number and rows are counted by Spark; a task's Python turns one body after another into a file and holds no second copy of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch[page], batch["body"], strict=True):
                _placed(f"{folder}/{number.as_py()}.json", lambda f, body=body: f.write(body.as_buffer()))
            yield batch.select([page, "n"])

    fields = [c for c in rows.columns if c != page]
    body = F.to_json(F.array_sort(F.collect_list(F.struct("id", *[c for c in fields if c != "id"]))))
    return rows.groupBy(F.col(page).cast("long").alias(page)).agg(F.count("*").alias("n"), body.alias("body")).mapInArrow(run, f"{page} long, n long")


def numbered(rows: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """rows with place_, from 0 in order of hash buckets of ``key``: places inside a bucket, after the sizes of the buckets before; no sort of all rows in one task."""
    own = rows.withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)))
    before = own.groupBy("bucket_").agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.orderBy("bucket_")) - F.col("n_")).drop("n_")
    place = F.row_number().over(Window.partitionBy("bucket_").orderBy(key)) - 1
    return own.withColumn("in_", place).join(F.broadcast(before), "bucket_").withColumn("place_", F.col("before_") + F.col("in_")).drop("bucket_", "before_", "in_")
