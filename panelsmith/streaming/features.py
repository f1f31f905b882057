"""Running features per key, kept as state between batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelsmith.functions.numeric import as_whole, from_whole


# The processor travels to the workers as code, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RunningMean(StatefulProcessor):
    """Exponential mean and change of the bar totals of one key.

    The input is closed bars, not events: a key with very many events brings
    one row per window, so neither its state nor its batch grows with them.
    """

    def __init__(self, key: str, alpha: float):
        self.key = key
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", "seen long, mean double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("bar_end")
        seen, mean, last = self.state.get() if self.state.exists() else (0, None, None)
        out = []
        for bar_end, total in zip(fresh["bar_end"], fresh["total"]):
            mean = total if mean is None else self.alpha * total + (1 - self.alpha) * mean
            change = None if last is None else total - last
            seen, last = seen + 1, total
            out.append((key[0], bar_end, seen, total, mean, change))
        self.state.update((seen, float(mean), float(last)))
        yield pd.DataFrame(out, columns=[self.key, "bar_end", "seen", "total", "mean", "change"])

    def close(self) -> None:
        pass


def running_features(events: DataFrame, width: str, key: str, key_type: str, alpha: float, places: int = 2) -> DataFrame:
    """Running mean and change of ``value`` totals per key and closed window of a stream."""
    closed = events.groupBy(F.window("event_time", width).alias("w"), key).agg(
        F.sum(as_whole("value", places)).alias("_total")
    )
    rows = closed.select(key, F.col("w.end").alias("bar_end"), from_whole("_total", places).alias("total"))
    return rows.groupBy(key).transformWithStateInPandas(
        RunningMean(key, alpha),
        outputStructType=f"{key} {key_type}, bar_end timestamp, seen long, total double, mean double, change double",
        outputMode="Append",
        timeMode="None",
    )
