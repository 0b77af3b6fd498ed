"""Connected components of an edge table, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import written


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node of edges (a, b): root is the smallest node of its component.

    A round links, for every node, its larger neighbours to its smallest (large star), then itself and its smaller neighbours to
    the smallest (small star), until nothing changes: about log² of the nodes at worst, few rounds for groups around one node. Minima are
    summed per task before their shuffle, and joined back by key, where AQE splits a hot node. A round's tables go when the next one's are written.
    """
    e, drop = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = _mark(e)
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m_")).select("a", F.least("a", "m_").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, drop_large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        drop()
        e, drop = written(small.where("a <> b").distinct(), "small-star")
        drop_large()
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
