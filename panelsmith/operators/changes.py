"""Change points of an asset's series by two-sided cumulative sums (Page), restarted after each alarm.

The restart makes each step depend on all before it, which no window can say.
Rows are placed by asset and sorted by day, and a function on Arrow batches
walks them; it holds a few numbers and one stretch of a batch, so a task's
memory does not grow with an asset's history.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The function travels to the workers as code, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRETCH = 65_536  # rows that are taken out of a batch at once


def _walk(allowance: float, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = down = 0.0
        since_up = since_down = None
        for batch in batches:
            for lo in range(0, batch.num_rows, STRETCH):
                part = batch.slice(lo, STRETCH)
                first, asset, days, values = part.columns
                first, days = first.to_numpy(zero_copy_only=False), days.cast(pa.int32()).to_numpy()
                out = []
                for i, (starts, d, z) in enumerate(zip(first.tolist(), days.tolist(), values.to_numpy().tolist())):
                    if starts:
                        up = down = 0.0
                    # An upper sum above 0 goes on from the day on which it last left 0, the lower one too.
                    if up <= 0.0:
                        since_up = d
                    if down <= 0.0:
                        since_down = d
                    up, down = up + z - allowance, down - z - allowance
                    if up < 0.0:
                        up = 0.0
                    if down < 0.0:
                        down = 0.0
                    if up > limit or down > limit:
                        out.append((i, since_up, d, "up", up) if up >= down else (i, since_down, d, "down", down))
                        up = down = 0.0
                if out:
                    at, since, day, side, score = zip(*out)
                    yield pa.RecordBatch.from_arrays([
                        asset.take(pa.array(at, pa.int32())), pa.array(since, pa.int32()).cast(pa.date32()),
                        pa.array(day, pa.int32()).cast(pa.date32()), pa.array(side), pa.array(score, pa.float64()),
                    ], names=["asset", "since", "d", "side", "score"])

    return run


def change_points(panel: DataFrame, value: str, allowance: float = 0.5, limit: float = 5.0) -> DataFrame:
    """``(asset, since, d, side, score)``: alarms of a standardised value of each asset.

    Each day adds the value less ``allowance`` to the upper sum and its negative
    less ``allowance`` to the lower one; neither falls below 0.  A sum above
    ``limit`` is an alarm on day ``d``; ``since`` is the day on which that sum
    last left 0.  Both start anew after an alarm.  Days without a value, NULL or
    NaN, are passed over.  An asset has one row a day.
    """
    known = panel.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col("d").isNotNull()).select(F.col("asset").cast("long").alias("asset"), "d", F.col(value).cast("double").alias("z"))
    # The window places and sorts rows by asset, which costs nothing if the panel comes so already.
    first = (F.row_number().over(Window.partitionBy("asset").orderBy("d")) == 1).alias("first")
    return known.select(first, "asset", "d", "z").mapInArrow(
        _walk(allowance, limit), "asset long, since date, d date, side string, score double")
