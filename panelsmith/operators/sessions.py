"""Sessions of stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions.numeric import as_whole, from_whole
from panelsmith.operators.timejoin import hot_cuts, micros, with_bin
from panelsmith.storage import settle


def _numbered(rows: DataFrame, within: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Number the runs of each group; a run ends where the pause exceeds ``gap`` microseconds."""
    order = Window.partitionBy(*within).orderBy(start, end)
    pause = micros(F.col(start)) - micros(F.lag(end).over(order))
    begins = F.when(pause <= gap, 0).otherwise(1)
    marked = rows.withColumn("_begins", begins)
    return marked.withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(
    events: DataFrame, gap_seconds: int, key: str, bin_seconds: int | None = None, places: int = 2
) -> DataFrame:
    """Runs of events of a key with pauses of at most ``gap_seconds``.

    Values have at most ``places`` decimal places; one with more is an error.

    If some key has too many events for a task, runs are first formed within
    bins of time, over many tasks.  Only the first and the last run of a bin can
    go on in another; these, at most two per bin, are then joined up, and all
    others are done.
    """
    cuts = hot_cuts(events, key, "ts") if bin_seconds is None else None
    gap = gap_seconds * 1_000_000
    timed = events.select(
        key, F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), F.lit(1).cast("long").alias("n"),
        as_whole("value", places).alias("_total"),
    )

    def merge(rows: DataFrame, within: list[str]) -> DataFrame:
        numbered = _numbered(rows, within, "first_ts", "last_ts", gap)
        return numbered.groupBy(*within, "_run").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
            F.sum("n").alias("n"), F.sum("_total").alias("_total"),
        )

    columns = [key, "first_ts", "last_ts", "n", "_total"]
    if bin_seconds is None and cuts is None:
        joined = merge(timed, [key]).select(*columns)
    else:
        runs = merge(with_bin(timed, key, "first_ts", bin_seconds, cuts), [key, "_bin"])
        edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy(key, "_bin")))
        runs = settle(runs.withColumn("_edge", edge), "runs")
        joined = merge(runs.filter("_edge").select(*columns), [key]).select(*columns).unionByName(runs.filter("NOT _edge").select(*columns))
    return joined.select(key, "first_ts", "last_ts", "n", from_whole("_total", places).alias("total"))
