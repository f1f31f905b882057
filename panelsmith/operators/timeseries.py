"""Trailing features of one asset.

Frames count rows unless a name says ``days``: a missing day is no row, see
``calendar.fill_calendar``.  All look back only.  An asset has at most one row
per date in a panel, so its history is bounded by the calendar and fits a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelsmith.functions.numeric import as_col, correlation, ratio, slope, varies

def past() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("d")


def trailing(n: int) -> WindowSpec:
    """The current row and the n - 1 rows before it."""
    return past().rowsBetween(1 - n, 0)


def trailing_days(n: int) -> WindowSpec:
    """The rows of the last n calendar days, today included."""
    return Window.partitionBy("asset").orderBy(F.unix_date("d")).rangeBetween(1 - n, 0)


def delay(x: Column | str, k: int) -> Column:
    return F.lag(as_col(x), k).over(past())


def delta(x: Column | str, k: int) -> Column:
    return as_col(x) - delay(x, k)


def change(x: Column | str, k: int = 1) -> Column:
    """Return over the last k rows."""
    return ratio(x, delay(x, k)) - 1


def rolling_zscore(x: Column | str, n: int) -> Column:
    x, w = as_col(x), trailing(n)
    return F.when(varies(x, w), ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def rolling_correlation(a: Column | str, b: Column | str, n: int) -> Column:
    return correlation(a, b, trailing(n))


def rolling_slope(y: Column | str, x: Column | str, n: int) -> Column:
    return slope(y, x, trailing(n))


def rolling_rank(x: Column | str, n: int) -> Column:
    """Share of the window's values that are at most today's."""
    x = as_col(x)
    values = F.collect_list(x).over(trailing(n))
    at_most = F.size(F.filter(values, lambda v: v <= x))
    return F.when(x.isNotNull(), ratio(at_most.cast("double"), F.size(values).cast("double")))


def _newest_first(x: Column, n: int) -> Column:
    return F.reverse(F.collect_list(F.struct(x.alias("v"))).over(trailing(n)).getField("v"))


def rows_since_max(x: Column | str, n: int) -> Column:
    """Rows back to the latest maximum of the window; 0 when it is today."""
    values = _newest_first(as_col(x), n)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rows_since_min(x: Column | str, n: int) -> Column:
    values = _newest_first(as_col(x), n)
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def linear_decay(x: Column | str, n: int) -> Column:
    """Mean with weights n, n - 1, ..., 1 from today backwards, over the values present."""
    values = _newest_first(as_col(x), n)
    weights = F.sequence(F.lit(n), F.lit(n) - F.size(values) + 1, F.lit(-1))
    weighted = F.zip_with(values, weights, lambda v, w: v * w)
    present = F.zip_with(values, weights, lambda v, w: F.when(v.isNotNull(), w).otherwise(0))
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return ratio(total, F.aggregate(present, F.lit(0), lambda acc, w: acc + w).cast("double"))


def rolling_quantile(x: Column | str, p: float, n: int) -> Column:
    return F.percentile(as_col(x), F.lit(float(p))).over(trailing(n))


def exponential_mean(df: DataFrame, x: str, alpha: float, out: str, block: int = 64) -> DataFrame:
    """Exponentially weighted mean: E1 = x1, then E = alpha * x + (1 - alpha) * E.

    The history is cut into blocks of ``block`` values.  Within a block the
    recursion is a plain running sum of rescaled values; a block takes over
    the end value of those before it.  Rows with NULL get NULL and do not
    count.
    """
    if not 0 < alpha < 1 or (1 - alpha) ** block < 1e-280:
        raise ValueError("alpha must lie between 0 and 1, and (1 - alpha) ** block above 1e-280")
    keep = F.lit(1.0 - alpha)
    known = F.col(x).isNotNull()
    seen = F.count(x).over(past().rowsBetween(Window.unboundedPreceding, 0))
    placed = df.withColumn("_at", seen - 1).withColumn("_block", F.floor(F.col("_at") / F.lit(block)))
    placed = placed.withColumn("_spot", (F.col("_at") % block).cast("double"))
    share = F.when(F.col("_at") == 0, F.col(x)).otherwise(F.lit(alpha) * F.col(x))
    inside = Window.partitionBy("asset", "_block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(F.when(known, share * F.pow(keep, -F.col("_spot")))).over(inside) * F.pow(keep, F.col("_spot"))
    placed = placed.withColumn("_local", local)
    ended = F.collect_list(F.when(known & (F.col("_spot") == block - 1), F.col("_local"))).over(
        past().rowsBetween(Window.unboundedPreceding, -1)
    )
    per_block = F.pow(keep, F.lit(float(block)))
    carried = F.aggregate(ended, F.lit(0.0), lambda acc, end: acc * per_block + end)
    value = F.col("_local") + F.pow(keep, F.col("_spot") + 1) * F.coalesce(carried, F.lit(0.0))
    return placed.withColumn(out, F.when(known, value)).drop("_at", "_block", "_spot", "_local")
