"""Structured Streaming forms: windowed limits, sessions, latest phase, breaker with state, lines across chunks, caches that expire, upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.streaming.breaker import Breaker


def windowed_counts(events: DataFrame, key: str, ts: str, window: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls of a key and window; late ones count until the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("window_start"), "n")


def over_limit(events: DataFrame, key: str, ts: str, most: int, window: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return windowed_counts(events, key, ts, window, late).where(F.col("n") > most)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n_events")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_events")


def latest_phase(events: DataFrame, key: str, phase: str, ts: str) -> DataFrame:
    """For output mode update: the latest phase of each key."""
    return events.groupBy(key).agg(F.max_by(phase, ts).alias("phase"), F.max(ts).alias("updated_at"))


def breaker_states(events: DataFrame, key: str, ts: str, order: str, failures: int = 5, open_s: float = 30.0) -> DataFrame:
    """events (key, ts, order, failed): state of each call, the breaker of a key kept between micro-batches."""
    k, o = (events.schema[x].dataType.simpleString() for x in (key, order))

    def run(own: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, -1e300)
        b = Breaker(failures, open_s, count, until)
        pdf = pd.concat(list(batches)).sort_values([ts, order])
        out = [b.call(t.timestamp(), bool(f)) for t, f in zip(pdf[ts], pdf.failed, strict=True)]
        state.update((b.count, max(b.until, -1e300)))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "state": out})

    return events.select(key, ts, order, "failed").groupBy(key).applyInPandasWithState(run, f"{key} {k}, {order} {o}, state string", "n int, until double", "append", "NoTimeout")


def lines(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """key, line, text of the lines of a stream of chunks cut anywhere; what no line end follows waits in the key's state for the next micro-batch.

    Chunks of a key come in order from one micro-batch to the next, and in any order inside of one.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def run(own: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, rest = state.get if state.exists else (0, "")
        pdf = pd.concat(list(batches)).sort_values(order)
        *whole, rest = (rest + "".join(pdf[chunk].fillna(""))).split("\n")
        state.update((n + len(whole), rest))
        yield pd.DataFrame({key: [own[0]] * len(whole), "line": range(n, n + len(whole)), "text": whole})

    return chunks.select(key, order, chunk).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, line long, text string", "n long, rest string", "append", "NoTimeout")


def expiries(puts: DataFrame, key: str, value: str, ts: str, ttl_s: int, late: str = "10 minutes") -> DataFrame:
    """key, value, expired_at of the entries of a cache whose time runs out: the latest put of a key counts, and a timer of event time ends its entry.

    An entry lives ``ttl_s`` seconds from its latest put and is given out once, when the watermark passes its end; a put behind the watermark changes nothing.
    """
    k, v = (puts.schema[x].dataType.simpleString() for x in (key, value))

    def run(own: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            end, last = state.get
            state.remove()
            yield pd.DataFrame({key: [own[0]], value: [last], "expired_at": [pd.Timestamp(end, unit="ms")]})
            return
        end, last = state.get if state.exists else (-1, None)
        for pdf in batches:
            for t, x in zip(pdf[ts], pdf[value], strict=True):
                at = int(t.timestamp() * 1000) + ttl_s * 1000
                if (at, str(x)) > (end, str(last)):
                    end, last = at, x
        if end <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [own[0]], value: [last], "expired_at": [pd.Timestamp(end, unit="ms")]})
        else:
            state.update((end, last))
            state.setTimeoutTimestamp(end)

    return puts.withWatermark(ts, late).select(key, value, ts).groupBy(key).applyInPandasWithState(
        run, f"{key} {k}, {value} {v}, expired_at timestamp", f"end_ms long, last {v}", "append", "EventTimeTimeout")


def upsert_batches(stream: DataFrame, write, checkpoint: str):
    """Starts a query that gives every micro-batch to ``write(df, epoch)``."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").start()
