"""Queries on the history of each asset."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelsmith.functions.numeric import tidy
from panelsmith.operators import timeseries as ts
from panelsmith.plans.inputs import PAST, SIGNALS_SQL, guarded_corr_sql, panel, panel_sql, r, signals
from panelsmith.plans.registry import query

KEY = ["asset", "d"]
ROWS20 = f"({PAST} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
NUMBERED = f"{panel_sql()}, numbered AS (SELECT *, row_number() OVER ({PAST}) AS rn FROM panel)"
WINDOW20 = "numbered a JOIN numbered b ON a.asset = b.asset AND b.rn BETWEEN a.rn - 19 AND a.rn"
WINDOW10 = "numbered a JOIN numbered b ON a.asset = b.asset AND b.rn BETWEEN a.rn - 9 AND a.rn"


@query(f"""WITH {panel_sql()} SELECT asset, d,
    {r(f'px / nullif(lag(px, 1) OVER ({PAST}), 0e0) - 1')} AS ret_1,
    {r(f'px / nullif(lag(px, 5) OVER ({PAST}), 0e0) - 1')} AS ret_5,
    {r(f'px / nullif(lag(px, 20) OVER ({PAST}), 0e0) - 1')} AS ret_20 FROM panel""")
def trailing_returns(spark, folder):
    return panel(spark, folder).df.select(*KEY, *[tidy(ts.change("px", k)).alias(f"ret_{k}") for k in (1, 5, 20)])


@query(f"""WITH {panel_sql()} SELECT asset, d, lag(px, 5) OVER ({PAST}) AS px_delayed,
    vol - lag(vol, 5) OVER ({PAST}) AS vol_delta FROM panel""")
def delay_and_delta(spark, folder):
    return panel(spark, folder).df.select(
        *KEY, ts.delay("px", 5).alias("px_delayed"), ts.delta("vol", 5).alias("vol_delta")
    )


@query(f"""WITH {panel_sql()} SELECT asset, d, {r(f'avg(px) OVER {ROWS20}', 4)} AS px_mean,
    sum(vol) OVER {ROWS20} AS vol_sum, {r(f'stddev_samp(px) OVER {ROWS20}', 4)} AS px_std,
    min(px) OVER {ROWS20} AS px_min, max(px) OVER {ROWS20} AS px_max FROM panel""")
def rolling_statistics(spark, folder):
    w = ts.trailing(20)
    return panel(spark, folder).df.select(
        *KEY, tidy(F.avg("px").over(w), 4).alias("px_mean"), F.sum("vol").over(w).alias("vol_sum"),
        tidy(F.stddev_samp("px").over(w), 4).alias("px_std"), F.min("px").over(w).alias("px_min"), F.max("px").over(w).alias("px_max"),
    )


@query(f"""WITH {panel_sql()} SELECT asset, d,
    {r(f'avg(px) OVER ({PAST} RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)', 4)} AS px_mean,
    sum(vol) OVER ({PAST} RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS vol_sum,
    count(*) OVER ({PAST} RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS days_seen FROM panel""")
def rolling_calendar_days(spark, folder):
    w = ts.trailing_days(30)
    return panel(spark, folder).df.select(
        *KEY, tidy(F.avg("px").over(w), 4).alias("px_mean"), F.sum("vol").over(w).alias("vol_sum"),
        F.count(F.lit(1)).over(w).alias("days_seen"),
    )


@query(f"""WITH {panel_sql()} SELECT asset, d,
    {r(f'''CASE WHEN max(px) OVER {ROWS20} > min(px) OVER {ROWS20} THEN
      (px - avg(px) OVER {ROWS20}) / nullif(stddev_samp(px) OVER {ROWS20}, 0e0) END''')} AS px_score FROM panel""")
def rolling_zscores(spark, folder):
    return panel(spark, folder).df.select(*KEY, tidy(ts.rolling_zscore("px", 20)).alias("px_score"))


@query(f"""WITH {NUMBERED} SELECT a.asset, a.d, {r(guarded_corr_sql('b.px', 'b.vol'))} AS px_vol_corr,
    {r('CASE WHEN max(b.vol) > min(b.vol) THEN covar_pop(b.px, b.vol) / nullif(var_pop(b.vol), 0e0) END', 4)} AS px_on_vol
    FROM {WINDOW20} GROUP BY a.asset, a.d""")
def rolling_comovement(spark, folder):
    return panel(spark, folder).df.select(
        *KEY, tidy(ts.rolling_correlation("px", "vol", 20)).alias("px_vol_corr"),
        tidy(ts.rolling_slope("px", "vol", 20), 4).alias("px_on_vol"),
    )


@query(f"""WITH {NUMBERED} SELECT a.asset, a.d,
    {r('count(*) FILTER (WHERE b.px <= a.px) / CAST(count(*) AS DOUBLE)')} AS px_rank
    FROM {WINDOW20} GROUP BY a.asset, a.d""")
def rolling_ranks(spark, folder):
    return panel(spark, folder).df.select(*KEY, tidy(ts.rolling_rank("px", 20)).alias("px_rank"))


@query(f"""WITH {NUMBERED},
    marked AS (SELECT *, max(px) OVER {ROWS20} AS hi, min(px) OVER {ROWS20} AS lo FROM numbered)
    SELECT a.asset, a.d, CAST(a.rn - max(b.rn) FILTER (WHERE b.px = a.hi) AS INTEGER) AS since_max,
      CAST(a.rn - max(b.rn) FILTER (WHERE b.px = a.lo) AS INTEGER) AS since_min
    FROM marked a JOIN marked b ON a.asset = b.asset AND b.rn BETWEEN a.rn - 19 AND a.rn
    GROUP BY a.asset, a.d, a.rn""")
def rolling_extreme_age(spark, folder):
    return panel(spark, folder).df.select(
        *KEY, ts.rows_since_max("px", 20).alias("since_max"), ts.rows_since_min("px", 20).alias("since_min")
    )


@query(f"""WITH {NUMBERED} SELECT a.asset, a.d,
    {r('sum((10 - a.rn + b.rn) * b.px) / sum(CAST(10 - a.rn + b.rn AS DOUBLE))', 4)} AS px_decay
    FROM {WINDOW10} GROUP BY a.asset, a.d""")
def linear_decay_means(spark, folder):
    return panel(spark, folder).df.select(*KEY, tidy(ts.linear_decay("px", 10), 4).alias("px_decay"))


@query(f"""WITH RECURSIVE {SIGNALS_SQL},
    numbered AS (SELECT asset, d, ret, row_number() OVER ({PAST}) AS rn FROM signals WHERE ret IS NOT NULL),
    ewm AS (SELECT asset, d, rn, ret AS e FROM numbered WHERE rn = 1
      UNION ALL SELECT n.asset, n.d, n.rn, 1e-1 * n.ret + 9e-1 * ewm.e
      FROM ewm JOIN numbered n ON n.asset = ewm.asset AND n.rn = ewm.rn + 1)
    SELECT signals.asset, signals.d, {r('e')} AS ret_ewm FROM signals LEFT JOIN ewm USING (asset, d)""")
def exponential_means(spark, folder):
    smooth = ts.exponential_mean(signals(spark, folder).df, "ret", 0.1, "ret_ewm")
    return smooth.select(*KEY, tidy("ret_ewm").alias("ret_ewm"))


@query(f"""WITH {SIGNALS_SQL} SELECT asset, d, {r(f'quantile_cont(ret, 0.25) OVER {ROWS20}')} AS ret_q25,
    {r(f'quantile_cont(ret, 0.75) OVER {ROWS20}')} AS ret_q75 FROM signals""")
def rolling_quantiles(spark, folder):
    return signals(spark, folder).df.select(
        *KEY, tidy(ts.rolling_quantile("ret", 0.25, 20)).alias("ret_q25"),
        tidy(ts.rolling_quantile("ret", 0.75, 20)).alias("ret_q75"),
    )
