"""The panels and signals the queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.functions.numeric import ratio
from panelsmith.operators import timeseries as ts
from panelsmith.operators.calendar import fill_calendar
from panelsmith.operators.evaluation import forward_returns, long_form
from panelsmith.operators.ordering import fits_one_task, place
from panelsmith.sources.panels import build_panel
from panelsmith.sources.tables import load
from panelsmith.storage import Stored, keep_panel

PANEL_TABLES = ["lineitem", "supplier", "nation"]
SIGNALS = ["volume_shock", "reversal", "momentum", "calm", "placebo"]
HORIZONS = [1, 5, 20]


def panel_from_tables(spark: SparkSession, folder: str, asset: str) -> DataFrame:
    return build_panel(
        load(spark, folder, "lineitem"), load(spark, folder, "supplier"), load(spark, folder, "nation"), asset
    )


def panel(spark: SparkSession, folder: str) -> Stored:
    """The supplier panel, written once per application."""
    return keep_panel(spark, "panel", folder, lambda: panel_from_tables(spark, folder, "supplier"), PANEL_TABLES)


def volume_shock() -> Column:
    """Yesterday's volume less the mean of the 19 rows before."""
    return ts.delay("vol", 1) - F.avg("vol").over(ts.past().rowsBetween(-20, -2))


def add_signals(df: DataFrame) -> DataFrame:
    """Five signals that use rows before today only, and the forward returns to test them on."""
    moves = df.withColumn("ret", ts.change("px", 1))
    made = moves.select(
        "*",
        volume_shock().alias("volume_shock"),
        (-ts.delay("ret", 1)).alias("reversal"),
        (ratio(ts.delay("px", 1), ts.delay("px", 21)) - 1).alias("momentum"),
        (-F.stddev_samp("ret").over(ts.past().rowsBetween(-20, -1))).alias("calm"),
        (F.pmod(F.col("asset") * 7919 + F.unix_date("d") * 104729, F.lit(1009)) / F.lit(1009.0)).alias("placebo"),
    )
    return forward_returns(made, HORIZONS)


def signals(spark: SparkSession, folder: str) -> Stored:
    return keep_panel(spark, "signals", folder, lambda: add_signals(panel(spark, folder).df), PANEL_TABLES)


def long_signals(spark: SparkSession, folder: str, copies: int = 1) -> tuple[DataFrame, int]:
    """Signals in long form, and the measured size of the largest signal-day.

    When a day of one signal fits one task, the wide rows are brought together
    by day first: everything done per signal and day then runs without moving
    the longer table.  Tasks are as many as the rows ask for once they are
    spread over the signals, and over ``copies`` of those later.
    """
    stored = signals(spark, folder)
    spread = len(SIGNALS) * copies
    wide = place(stored.df, ["d"], stored.rows * spread) if fits_one_task(stored.max_day_rows) else stored.df
    return spread_signals(wide), stored.max_day_rows


def daily_signals(spark: SparkSession, folder: str) -> Stored:
    """Signals on every calendar day of an asset's life, the last known ones on days without a row (``filled``).

    ``fwd_1`` reaches to the next calendar day, so books earn and compound by the day.
    """

    def build() -> DataFrame:
        # From the panel itself: signals and calendar then share one placing by asset.
        wide = add_signals(panel(spark, folder).df).select("asset", "grp", "d", "px", *SIGNALS)
        return forward_returns(fill_calendar(wide, ["px", *SIGNALS]), [1])

    return keep_panel(spark, "daily-signals", folder, build, PANEL_TABLES)


def spread_signals(wide: DataFrame) -> DataFrame:
    return long_form(wide, SIGNALS, ["asset", "grp", "d", *[f"fwd_{h}" for h in HORIZONS]])


def r(expression: str, places: int = 6) -> str:
    """SQL twin of ``numeric.tidy``."""
    unit = f"1e{places}"
    return f"(round_even(({expression}) * {unit}, 0) / {unit} + 0e0)"


def panel_sql(asset: str = "l_suppkey") -> str:
    amount = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"
    quantity = "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)"
    return f"""
    panel AS (
      SELECT CAST({asset} AS BIGINT) AS asset, n_regionkey AS grp, CAST(l_shipdate AS DATE) AS d,
             {amount} / nullif({quantity}, 0e0) AS px, {quantity} AS vol
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      GROUP BY 1, 2, 3)"""


PAST = "PARTITION BY asset ORDER BY d"

SIGNALS_SQL = f"""{panel_sql()},
    moves AS (SELECT *, px / nullif(lag(px) OVER ({PAST}), 0e0) - 1 AS ret FROM panel),
    signals AS (
      SELECT *,
        lag(vol) OVER ({PAST}) - avg(vol) OVER ({PAST} ROWS BETWEEN 20 PRECEDING AND 2 PRECEDING) AS volume_shock,
        -lag(ret) OVER ({PAST}) AS reversal,
        lag(px, 1) OVER ({PAST}) / nullif(lag(px, 21) OVER ({PAST}), 0e0) - 1 AS momentum,
        -stddev_samp(ret) OVER ({PAST} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS calm,
        ((asset * 7919 + date_diff('day', DATE '1970-01-01', d) * 104729) % 1009) / 1009e0 AS placebo,
        lead(px, 1) OVER ({PAST}) / nullif(px, 0e0) - 1 AS fwd_1,
        lead(px, 5) OVER ({PAST}) / nullif(px, 0e0) - 1 AS fwd_5,
        lead(px, 20) OVER ({PAST}) / nullif(px, 0e0) - 1 AS fwd_20
      FROM moves)"""

LONG_SQL = SIGNALS_SQL + ",\n    long AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS signal, asset, grp, d, fwd_1, fwd_5, fwd_20, {s} AS x FROM signals" for s in SIGNALS
) + ")"


DAILY_SQL = f"""{SIGNALS_SQL},
    known AS (SELECT asset, grp, d, lead(d) OVER ({PAST}) AS next_d, {', '.join(
        f'last_value({c} IGNORE NULLS) OVER ({PAST} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}' for c in ['px', *SIGNALS])}
      FROM signals),
    every_day AS (SELECT *, unnest(generate_series(d, coalesce(next_d - 1, d), INTERVAL 1 DAY)) AS day FROM known),
    daily AS (SELECT asset, grp, CAST(day AS DATE) AS d, {', '.join(SIGNALS)},
      lead(px) OVER (PARTITION BY asset ORDER BY day) / nullif(px, 0e0) - 1 AS fwd_1 FROM every_day),
    long AS ({' UNION ALL '.join(f"SELECT '{s}' AS signal, asset, grp, d, fwd_1, {s} AS x FROM daily" for s in SIGNALS)})"""


def guarded_corr_sql(a: str, b: str) -> str:
    """Correlation of two columns without NULLs, NULL where one is constant."""
    return (
        f"CASE WHEN max({a}) > min({a}) AND max({b}) > min({b}) "
        f"THEN covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0e0) END"
    )


def ic_sql(source: str, by: str, target: str = "fwd_1", name: str = "ics") -> str:
    """CTEs that end in ``name``: the daily IC of ``x`` in ``source``."""
    return f"""
    {name}_pairs AS (SELECT {by}, {r('x', 9)} AS px_x, {r(target, 9)} AS px_y FROM {source}
      WHERE x IS NOT NULL AND {target} IS NOT NULL),
    {name}_ranked AS (SELECT *,
        rank() OVER (PARTITION BY {by} ORDER BY px_x) + (count(*) OVER (PARTITION BY {by}, px_x) - 1) / 2e0 AS rx,
        rank() OVER (PARTITION BY {by} ORDER BY px_y) + (count(*) OVER (PARTITION BY {by}, px_y) - 1) / 2e0 AS ry
      FROM {name}_pairs),
    {name} AS (SELECT {by}, count(*) AS assets, {guarded_corr_sql('rx', 'ry')} AS rank_ic,
        {guarded_corr_sql('px_x', 'px_y')} AS ic
      FROM {name}_ranked GROUP BY {by} HAVING count(*) >= 5)"""
