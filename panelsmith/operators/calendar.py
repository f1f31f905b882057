"""Calendar fill and coarser bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.operators.timeseries import past


def fill_calendar(panel: DataFrame, values: list[str], keep: list[str] = ["grp"]) -> DataFrame:
    """One row per asset and calendar day between the asset's first and last day.

    The values of a missing day are the last known ones; ``filled`` tells such
    rows apart.  Each row is spread over the gap that follows it, so no
    calendar is joined.
    """
    so_far = past().rowsBetween(Window.unboundedPreceding, 0)
    known = panel.select(
        "asset", *keep, "d",
        *[F.last(v, ignorenulls=True).over(so_far).alias(v) for v in values],
        F.lead("d").over(past()).alias("_next"),
    )
    until = F.coalesce(F.date_sub("_next", 1), F.col("d"))
    spread = known.withColumn("_day", F.explode(F.sequence("d", until)))
    return spread.select(
        "asset", *keep, F.col("_day").alias("d"), *values, (F.col("_day") > F.col("d")).alias("filled")
    )


def resample(panel: DataFrame, unit: str = "week") -> DataFrame:
    """Open, high, low, close and volume per asset and calendar unit."""
    return (
        panel.groupBy("asset", F.date_trunc(unit, "d").cast("date").alias("bar"))
        .agg(
            F.min_by("px", "d").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "d").alias("close"),
            F.sum("vol").alias("volume"),
            F.count(F.lit(1)).alias("days"),
        )
    )
