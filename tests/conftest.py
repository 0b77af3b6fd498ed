import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def files(spark):
    from codeloom.plans.sample import sample_files

    return sample_files(spark).cache()


def rows(df, *columns):
    """Rows as a set of tuples."""
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.select(*columns).collect()}
