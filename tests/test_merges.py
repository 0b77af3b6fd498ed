"""Tables of a row a file meet by merges: their size is guessed from compressed files, so a broadcast of them would grow with the input."""

from codeloom.operators import detect, graph
from codeloom.plans import sources
from codeloom.session import stored

SF = "/root/testdata/sf0.001"


def _left_joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and "LeftOuter" in line]


def test_symbols_meet_routes_by_a_merge(spark):
    routes = spark.createDataFrame([("p", "GET", "/a", "r.js", 1)], "project_id string, method string, path string, file string, line int")
    edges = spark.createDataFrame([("p", "r.js", "s.js"), ("p", "r.js", "t.js")], "project_id string, source string, target string")
    symbols = stored(spark.createDataFrame([("p", "s.js", f"f{k}", k) for k in range(7)], "project_id string, file_path string, name string, line int"), "symbols")
    flow = graph.controller_flow(routes, edges, symbols)
    joins = _left_joins(flow)
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert sorted((r.target, r.symbol) for r in flow.collect() if r.symbol) == [("s.js", f"f{k}") for k in range(5)]
    assert [r.symbol for r in flow.where("target = 't.js'").collect()] == [None]


def test_counts_of_files_meet_by_merges(spark):
    joins = [x for x in _left_joins(sources.project_facts(spark, SF)) if "file_path" in x or "file#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_base_paths_meet_routes_by_a_merge(spark):
    joins = _left_joins(detect.routes(sources.source_files(spark, SF)))
    assert joins and all("SortMergeJoin" in x for x in joins)
