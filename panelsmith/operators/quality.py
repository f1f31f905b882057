"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.numeric import ratio
from panelsmith.operators.ordering import attach
from panelsmith.operators.timeseries import past


def column_report(df: DataFrame) -> DataFrame:
    """Rows, NULLs, NaNs, least and greatest value of every column, in one scan."""
    counts = []
    for i, (name, kind) in enumerate(df.dtypes):
        floating = kind in ("double", "float")
        nan = F.isnan(name) if floating else F.lit(False)
        least, greatest = (f(name) + F.lit(0.0) if floating else f(name) for f in (F.min, F.max))  # no -0.0
        counts += [
            F.count(name).alias(f"_n{i}"),
            F.count_if(nan).alias(f"_nan{i}"),
            least.cast("string").alias(f"_min{i}"),
            greatest.cast("string").alias(f"_max{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("column"), F.col("rows"), (F.col("rows") - F.col(f"_n{i}")).alias("nulls"),
            F.col(f"_nan{i}").alias("nans"),
            F.col(f"_min{i}").alias("least"), F.col(f"_max{i}").alias("greatest"),
        )
        for i, name in enumerate(df.columns)
    ])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def gaps(panel: DataFrame, longer_than: int = 1) -> DataFrame:
    """Per asset: days present, gaps of more than ``longer_than`` days, longest gap and days missed."""
    steps = panel.select("asset", "d", F.datediff("d", F.lag("d").over(past())).alias("_step"))
    return steps.groupBy("asset").agg(
        F.count(F.lit(1)).alias("days"),
        F.count(F.when(F.col("_step") > longer_than, 1)).alias("gaps"),
        F.max("_step").alias("longest"),
        F.coalesce(F.sum(F.col("_step") - 1), F.lit(0)).cast("long").alias("missed"),
    )


def outliers(panel: DataFrame, x: str, k: float) -> DataFrame:
    """Rows more than ``k`` standard deviations from their asset's mean."""
    stats = panel.groupBy("asset").agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))
    score = ratio(F.col(x) - F.col("_mean"), "_std")
    return (
        attach(panel, stats, ["asset"], null_keys=False).withColumn("score", score)
        .filter(F.abs("score") > k).drop("_mean", "_std")
    )
