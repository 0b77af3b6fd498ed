"""Running sums and greedy packs over sequences of any length, where one key may hold most of the rows.

Rows are dealt to blocks by range of (key, order); a block is summed by itself, and what the blocks before it hold, one row a key and block, is added.
So no task needs all rows of a key, as a window over the key would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut, stored

#: Rows of a key that one group may hold.
GROUP_ROWS = 50_000


def in_ranges(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows with block_: the number of its range in the order of columns; stored, as ranges are drawn anew whenever they are computed."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *order).withColumn("block_", F.spark_partition_id()), label)


def prefix_sums(rows: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """rows with, for each name of values, the sum of its expression over the rows of the key before this one, in the order of a column that tells them apart."""
    own = in_ranges(rows.select("*", *[F.coalesce(v.cast("long"), F.lit(0)).alias(f"{n}_v_") for n, v in values.items()]), [key, order], "ranges")
    totals = own.groupBy(key, "block_").agg(*[F.sum(f"{n}_v_").alias(f"{n}_t_") for n in values])
    earlier = Window.partitionBy(key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = totals.select(F.col(key).alias("key_"), F.col("block_").alias("of_"), *[F.coalesce(F.sum(f"{n}_t_").over(earlier), F.lit(0)).alias(f"{n}_o_") for n in values])
    inside = Window.partitionBy(key, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = own.select("*", *[F.coalesce(F.sum(f"{n}_v_").over(inside), F.lit(0)).alias(f"{n}_l_") for n in values])
    both = local.join(offsets, local[key].eqNullSafe(offsets["key_"]) & (local["block_"] == offsets["of_"]))
    return both.select(*[local[c] for c in rows.columns], *[(F.col(f"{n}_l_") + F.col(f"{n}_o_")).cast("long").alias(n) for n in values])


def first_above(points: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """asked (key, value, and others) with pos: the first of points (key, pos, total; totals never fall with pos) of the key whose total is above value.

    Both lie in one order of values, where the answer is the next point: that of the same range, or the first of a later one.
    """
    others = [c for c in asked.columns if c not in (key, "value")]
    both = points.select(key, F.col("total").alias("value"), F.lit(0).alias("kind_"), "pos", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in others]).unionByName(
        asked.select(key, "value", F.lit(1).alias("kind_"), F.lit(None).cast("long").alias("pos"), *others))
    own = in_ranges(both, [key, "value", "kind_", "pos"], "values")
    ahead = Window.partitionBy(key, "block_").orderBy("value", "kind_", "pos").rowsBetween(0, Window.unboundedFollowing)
    firsts = own.groupBy(key, "block_").agg(F.min("pos").alias("first_"))
    later = Window.partitionBy(key).orderBy("block_").rowsBetween(1, Window.unboundedFollowing)  # a row a block
    beyond = firsts.select(F.col(key).alias("key_"), F.col("block_").alias("of_"), F.min("first_").over(later).alias("beyond_"))
    here = own.withColumn("here_", F.min("pos").over(ahead)).where("kind_ = 1")
    found = here.join(beyond, here[key].eqNullSafe(beyond["key_"]) & (here["block_"] == beyond["of_"]))
    return found.select(here[key], "value", *others, F.coalesce("here_", "beyond_").alias("pos"))


def pack_starts(rows: DataFrame, key: str, most: int) -> DataFrame:
    """key, pos of the first row of each pack of rows (key, pos from 0, before: the sum in front of the row, size).

    A pack that starts at row s is followed by one that starts at the first row after it that does not fit, once the pack holds anything: a
    search in the sums, for all rows at once. Starts are the rows that the first one leads to by these steps; every round doubles the steps,
    so rounds follow the logarithm of the number of packs.
    """
    points = rows.select(key, "pos", (F.col("before") + F.col("size")).alias("total"))
    asked = rows.select(key, F.col("pos").alias("start"), F.explode(F.array(F.struct(F.lit(0).alias("room"), F.col("before").alias("value")), F.struct(F.lit(1).alias("room"), (F.col("before") + most).alias("value")))).alias("q"))
    found = first_above(points, asked.select(key, "start", "q.room", "q.value"), key)
    # the first row that fills the pack, and the first that overfills it, whichever of the row behind the one and the other comes later
    step = found.groupBy(key, "start").agg(F.max(F.when(F.col("room") == 0, F.col("pos") + 1)).alias("filled"), F.max(F.when(F.col("room") == 1, F.col("pos"))).alias("over"))
    jump = cut(step.where("filled is not null and over is not null").select(key, F.col("start").alias("pos"), F.greatest("filled", "over").alias("next")))
    jump = cut(jump.join(rows.select(key, F.col("pos").alias("next")), [key, "next"], "left_semi").select(key, "pos", "next"))
    starts = cut(rows.where("pos = 0").select(key, "pos"))
    while True:
        reached = starts.join(jump, [key, "pos"]).select(key, F.col("next").alias("pos"))
        more = cut(starts.unionByName(reached).distinct())
        if more.count() == starts.count():
            return more
        starts = more
        jump = cut(jump.join(jump.select(key, F.col("pos").alias("next"), F.col("next").alias("far")), [key, "next"]).select(key, "pos", F.col("far").alias("next")))


def pack_numbers(rows: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """rows with pack_no (from 0): rows of a key in order go together while they fit; a larger one is a pack of its own. No key needs one task."""
    at = stored(prefix_sums(rows, key, order, {"pos_": F.lit(1), "before_": F.col(size)}), "sequence")
    starts = pack_starts(at.select(key, F.col("pos_").alias("pos"), F.col("before_").alias("before"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")), key, most)
    marked = at.join(starts.select(key, F.col("pos").alias("pos_"), F.lit(1).alias("start_")), [key, "pos_"], "left")
    numbered = prefix_sums(marked, key, "pos_", {"packs_": F.col("start_")})
    return numbered.select(*rows.columns, (F.col("packs_") + F.coalesce("start_", F.lit(0)) - 1).cast("int").alias("pack_no"))
