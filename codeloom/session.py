"""A SparkSession with the settings that the library's results depend on, and the folder that its tasks share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_own: dict[str, str] = {}


def session(master: str | None = None, name: str = "codeloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def _hadoop_path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session on a local master gets a folder of its own (as in tests), which also becomes the checkpoint folder;
    on any other master that is an error, as a folder of one machine is none that executors can reach.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="codeloom-")
            context.setCheckpointDir(_own[app])
        at = _own[app]
    path, store = _hadoop_path(spark, at)
    full = store.makeQualified(path).toString().rstrip("/")
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/codeloom-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder of the shared folder, if it is there."""
    path, store = _hadoop_path(spark, at)
    store.delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; DataFrames that read from there cannot be run again."""
    remove(spark, own_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """df as files in the shared folder, without its lineage; computed once, where a checkpoint of an uncached table would compute it twice."""
    return stored(df, "cut")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table of the shared folder, read back: what follows starts from files, and nothing above is computed again."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
