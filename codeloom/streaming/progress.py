"""Progress events: latest phase, every n-th event, frames for the browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.prefixes import prefix_sums

#: Phases of an ingest, in order.
PHASES = ("extracting", "reading", "chunking", "embedding", "quality", "indexing", "analyzing", "completed")


def latest(events: DataFrame, key: str, phase: str, ts: str, order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(phase, F.struct(ts, order)).alias("phase"), F.max(ts).alias("updated_at"))


def throttled(events: DataFrame, key: str, order: list[str], every: int) -> DataFrame:
    """Every n-th event of a key, with its number."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") % every == 0)


def frames(payload: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def lines(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """key, line (number from 0), text of every line of a stream of text whose chunks are cut anywhere; what no line end follows is no line yet.

    A part between line ends belongs to the line whose number is that of the line ends in front of it. That is a sum over a stream's chunks, made of
    blocks of it, so a stream of any length is spread over tasks and only the parts of one line meet. Null chunks are empty; ``order`` tells chunks apart.
    """
    own = chunks.select(key, F.col(order).alias("order_"), F.split(F.coalesce(F.col(chunk), F.lit("")), "\n", -1).alias("parts_"))
    at = prefix_sums(own, key, "order_", {"before_": F.size("parts_") - 1})
    parts = at.select(key, "order_", "before_", F.posexplode("parts_").alias("i_", "part_"), F.size("parts_").alias("n_"))
    whole = parts.groupBy(key, (F.col("before_") + F.col("i_")).alias("line")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_", "i_", "part_"))), lambda p: p["part_"]), "").alias("text"), F.max(F.col("i_") < F.col("n_") - 1).alias("ended_"))
    return whole.where("ended_").select(key, "line", "text")
