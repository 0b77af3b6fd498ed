"""Windows, expiry and token rotation over event rows, in batch; the streaming forms are in streams.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def excess(events: DataFrame, key: str, ts: str, order: str, window: str, most: int) -> DataFrame:
    """Events beyond the first ``most`` of their key and window; windows are aligned to the epoch."""
    own = events.withColumn("window_start", F.window(ts, window)["start"].cast(events.schema[ts].dataType))
    w = Window.partitionBy(key, "window_start").orderBy(ts, order)
    return own.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") > most).drop("rn_")


def segments(events: DataFrame, key: str, ts: str, order: str, gap: str) -> DataFrame:
    """Sessions of a key: started, ended, n_events; a gap of ``gap`` or more begins a new one."""
    w = Window.partitionBy(key).orderBy(ts, order)
    fresh = F.coalesce((F.col(ts) - F.lag(ts).over(w)) >= F.expr(f"INTERVAL {gap}"), F.lit(True)).cast("int")
    return events.withColumn("n_", fresh).withColumn("s_", F.sum("n_").over(w)).groupBy(key, "s_").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events")).drop("s_")


def live(rows: DataFrame, ts: str, ttl: str, now) -> DataFrame:
    """Rows that have not expired: written less than ttl before now."""
    return rows.where(F.col(ts) + F.expr(f"INTERVAL {ttl}") > now)


def aged(rows: DataFrame, ts: str, age: str, now) -> DataFrame:
    return rows.where(F.col(ts) < now - F.expr(f"INTERVAL {age}"))


def current_tokens(tokens: DataFrame, family: str, order: list[str], reused: str, most: int = 0) -> DataFrame:
    """The latest token of each family, and whether more than ``most`` reuses of a spent one have revoked the family."""
    n = tokens.groupBy(family).agg(F.max_by(F.struct(*tokens.columns), F.struct(*order)).alias("t_"), F.count_if(F.col(reused)).alias("n_"))
    return n.select("t_.*", (F.col("n_") > most).alias("revoked"))
