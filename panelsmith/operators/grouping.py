"""Summaries over several groupings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(df: DataFrame, dims: dict[str, Column], value: str, how: str = "cube") -> DataFrame:
    """Count and mean of ``value`` for every grouping of a cube or rollup.

    The rows are first summed at the finest level, and only those sums are
    multiplied out to the coarser ones.
    """
    fine = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*[c.alias(name) for name, c in dims.items()])
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"))
    )
    grouped = fine.cube(*dims) if how == "cube" else fine.rollup(*dims)
    return grouped.agg(
        F.grouping_id().cast("long").alias("level"),
        F.sum("_n").alias("n"),
        (F.sum("_sum") / F.sum("_n")).alias("mean"),
    )
