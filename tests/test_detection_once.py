from pyspark.sql import functions as F

from codeloom.operators import detect, parsers


def test_files_are_searched_once(spark, files):
    """Exclusions, parents and stacks compare technologies with each other; none of that reads the files again."""
    own = files.where(F.col("content").isNotNull())
    tech = detect.technologies(own, parsers.configs(own), parsers.imports(parsers.parse_files(own)))
    plan = detect.stacks(tech)[1]._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "MapInPandas" not in plan
    assert {r.name for r in tech.collect()}
