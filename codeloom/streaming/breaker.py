"""Circuit breaker: ``failures`` failures in a row open it for ``open_s`` seconds, during which calls are refused."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


class Breaker:
    def __init__(self, failures: int = 5, open_s: float = 30.0, count: int = 0, until: float = float("-inf")):
        self.failures, self.open_s, self.count, self.until = failures, open_s, count, until

    def call(self, at: float, failed: bool) -> str:
        """closed, open (the call is refused) or opened (this failure opens it)."""
        if at < self.until:
            return "open"
        self.count = self.count + 1 if failed else 0
        if self.count < self.failures:
            return "closed"
        self.count, self.until = 0, at + self.open_s
        return "opened"


def replay(events: DataFrame, key: str, ts: str, order: str, failures: int = 5, open_s: float = 30.0) -> DataFrame:
    """events (key, ts, order, failed) in batch: key, order, state of every call. A key's calls are one sequence."""
    k, o = (events.schema[x].dataType.simpleString() for x in (key, order))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, order])
        b = Breaker(failures, open_s)
        at = pdf[ts].astype("int64") / 1e9 if pdf[ts].dtype == "datetime64[ns]" else pdf[ts].map(lambda x: x.timestamp())
        return pdf.assign(state=[b.call(float(t), bool(f)) for t, f in zip(at, pdf.failed, strict=True)])[[key, order, "state"]]

    return events.select(key, ts, order, "failed").groupBy(key).applyInPandas(run, f"{key} {k}, {order} {o}, state string")
