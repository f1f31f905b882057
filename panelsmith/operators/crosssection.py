"""Transforms of a signal across the assets of a day.

``by`` names the columns of the cross-section, ``["d"]`` by default; add "grp"
or "signal" for finer ones.  ``group_rows`` is the measured size of the largest
cross-section; left out, it is counted where it matters.  ``slices`` asks for
the way that cross-sections too large for a task take.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions.numeric import ratio
from panelsmith.operators.ordering import (
    attach,
    attach_group_stats,
    bucket_from,
    group_quantiles,
    percent_rank_from,
    positions,
)

DAY = ["d"]
SINGULAR = 1e-9
PRUNED_K = 1000  # fixed value: spark.sql.optimizer.windowGroupLimitThreshold


def percent_rank(
    df: DataFrame, x: str, out: str, by: list[str] = DAY, group_rows: int | None = None, slices: int | None = None
) -> DataFrame:
    """Rank from 0 to 1; equal values in asset order, NULLs last."""
    placed = positions(df, by, x, "asset", group_rows, "_pos", "_n", slices)
    return placed.withColumn(out, percent_rank_from(F.col("_pos"), F.col("_n"))).drop("_pos", "_n")


def demean(df: DataFrame, x: str, out: str, by: list[str] = DAY, group_rows: int | None = None) -> DataFrame:
    both = attach_group_stats(df, by, {"_mean": F.avg(x)}, group_rows)
    return both.withColumn(out, F.col(x) - F.col("_mean")).drop("_mean")


def zscore(df: DataFrame, x: str, out: str, by: list[str] = DAY, group_rows: int | None = None) -> DataFrame:
    stats = {"_mean": F.avg(x), "_std": F.stddev_samp(x), "_low": F.min(x), "_high": F.max(x)}
    both = attach_group_stats(df, by, stats, group_rows)
    score = F.when(F.col("_high") > F.col("_low"), ratio(F.col(x) - F.col("_mean"), "_std"))
    return both.withColumn(out, score).drop(*stats)


def scale_to_gross(
    df: DataFrame, x: str, out: str, by: list[str] = DAY, gross: float = 1.0, group_rows: int | None = None
) -> DataFrame:
    """Scale so that absolute values add up to ``gross``."""
    both = attach_group_stats(df, by, {"_gross": F.sum(F.abs(x))}, group_rows)
    return both.withColumn(out, ratio(F.col(x) * F.lit(float(gross)), "_gross")).drop("_gross")


def winsorise(
    df: DataFrame, x: str, out: str, low: float = 0.05, high: float = 0.95,
    by: list[str] = DAY, group_rows: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Pull values outside two quantiles of the day back to those quantiles."""
    marks = group_quantiles(df, by, x, {"_low": low, "_high": high}, "asset", group_rows, slices)
    inside = F.greatest(F.least(F.col(x), F.col("_high")), F.col("_low"))
    both = attach(df, marks, by)
    return both.withColumn(out, F.when(F.col(x).isNotNull(), inside)).drop("_low", "_high")


def bucket(
    df: DataFrame, x: str, out: str, buckets: int = 5, by: list[str] = DAY, group_rows: int | None = None
) -> DataFrame:
    """Equal-count buckets 1..buckets by (value, asset); rows with NULL are left out."""
    placed = positions(df.filter(F.col(x).isNotNull()), by, x, "asset", group_rows, "_pos", "_n")
    return placed.withColumn(out, bucket_from(F.col("_pos"), F.col("_n"), buckets)).drop("_pos", "_n")


def top_and_bottom(df: DataFrame, x: str, k: int, by: list[str] = DAY, group_rows: int | None = None) -> DataFrame:
    """The k largest and the k smallest per cross-section, with ``side`` and ``place``.

    For a small k the filter on the row number lets every task drop all but
    its own k before the shuffle, so a large day needs no slicing.  Spark does
    so up to ``PRUNED_K``; beyond that places are found as for ranks.
    """
    known = df.filter(F.col(x).isNotNull())

    def first_k(side, value):
        made = known.withColumn("_value", value)
        if k <= PRUNED_K:
            window = Window.partitionBy(*by).orderBy("_value", "asset")
            placed = made.withColumn("place", F.row_number().over(window))
        else:
            placed = positions(made, by, "_value", "asset", group_rows, "place", "_n").drop("_n")
            placed = placed.withColumn("place", F.col("place").cast("int"))
        return placed.filter(F.col("place") <= k).drop("_value").withColumn("side", F.lit(side))

    return first_k("top", -F.col(x)).unionByName(first_k("bottom", F.col(x)))


def regression_residual(df: DataFrame, y: str, factors: list[str], out: str, by: list[str] = DAY) -> DataFrame:
    """Residual of ``y`` on several factors and a constant, day by day.

    Only covariances leave the executors' partial aggregation.  The normal
    equations of a day, one row, are solved in batches of days.  NULL where a
    value is missing, where the day has too few rows or where the factors are
    collinear.
    """
    names = [y, *factors]
    complete = F.lit(True)
    for name in names:
        complete = complete & F.col(name).isNotNull()
    col = {name: F.when(complete, F.col(name)) for name in names}
    moments = df.groupBy(*by).agg(
        F.count(F.when(complete, 1)).alias("_n"),
        *[F.avg(col[c]).alias(f"_mean_{c}") for c in names],
        F.array(*[F.covar_pop(col[a], col[b]) for a in factors for b in factors]).alias("_xx"),
        F.array(*[F.covar_pop(col[a], col[y]) for a in factors]).alias("_xy"),
    )
    k = len(factors)
    enough = F.col("_n") >= k + 2

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        betas = pd.Series([None] * len(xx), dtype=object)
        given = np.flatnonzero(xx.notna() & xy.notna())
        if not len(given):
            return betas
        a = np.stack(xx.to_numpy()[given]).astype(float).reshape(-1, k, k)
        b = np.stack(xy.to_numpy()[given]).astype(float)
        var = np.diagonal(a, axis1=1, axis2=2)
        usable = (var > 0).all(axis=1)
        given, a, b, sd = given[usable], a[usable], b[usable], np.sqrt(var[usable])
        usable = np.linalg.det(a / (sd[:, :, None] * sd[:, None, :])) > SINGULAR
        found = np.linalg.solve(a[usable], b[usable][:, :, None])[:, :, 0]
        for at, beta in zip(given[usable], found):
            betas[at] = beta
        return betas

    solved = moments.withColumn("_beta", solve(F.when(enough, F.col("_xx")), F.col("_xy"))).drop("_xx", "_xy", "_n")
    fitted = F.lit(0.0)
    for i, name in enumerate(factors):
        fitted = fitted + F.col("_beta")[i] * (F.col(name) - F.col(f"_mean_{name}"))
    both = attach(df, solved, by)
    return both.withColumn(out, F.col(y) - F.col(f"_mean_{y}") - fitted).drop(
        "_beta", *[f"_mean_{c}" for c in names]
    )
