"""Queries across the assets of a day."""

from __future__ import annotations

from panelsmith.functions.numeric import tidy
from panelsmith.operators import crosssection as xs
from panelsmith.operators.ordering import SLICES
from panelsmith.plans.inputs import SIGNALS_SQL, panel, panel_sql, r, signals
from panelsmith.plans.registry import query

KEY = ["asset", "d"]


RANK_SQL = f"""WITH {panel_sql()} SELECT asset, d,
    {r('percent_rank() OVER (PARTITION BY d ORDER BY vol NULLS LAST, asset)')} AS vol_rank FROM panel"""


def _percent_rank(spark, folder, sliced):
    p = panel(spark, folder)
    ranked = xs.percent_rank(p.df, "vol", "vol_rank", group_rows=p.max_day_rows, slices=SLICES if sliced else None)
    return ranked.select(*KEY, tidy("vol_rank").alias("vol_rank"))


@query(RANK_SQL)
def section_percent_rank(spark, folder):
    return _percent_rank(spark, folder, sliced=False)


@query(RANK_SQL)
def section_percent_rank_sliced(spark, folder):
    """The same by the way that days too large for a task take."""
    return _percent_rank(spark, folder, sliced=True)


@query(f"""WITH {panel_sql()} SELECT asset, d, {r('''CASE WHEN max(vol) OVER (PARTITION BY d) > min(vol) OVER (PARTITION BY d)
    THEN (vol - avg(vol) OVER (PARTITION BY d)) / nullif(stddev_samp(vol) OVER (PARTITION BY d), 0e0) END''')} AS vol_score
    FROM panel""")
def section_zscore(spark, folder):
    return xs.zscore(panel(spark, folder).df, "vol", "vol_score").select(*KEY, tidy("vol_score").alias("vol_score"))


WINSORISED_SQL = f"""WITH {SIGNALS_SQL},
    marks AS (SELECT d, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM signals GROUP BY d)
    SELECT asset, d, {r('CASE WHEN ret IS NOT NULL THEN greatest(least(ret, hi), lo) END')} AS ret_inside
    FROM signals JOIN marks USING (d)"""


def _winsorised(spark, folder, sliced):
    s = signals(spark, folder)
    inside = xs.winsorise(s.df, "ret", "ret_inside", group_rows=s.max_day_rows, slices=SLICES if sliced else None)
    return inside.select(*KEY, tidy("ret_inside").alias("ret_inside"))


@query(WINSORISED_SQL)
def section_winsorised(spark, folder):
    return _winsorised(spark, folder, sliced=False)


@query(WINSORISED_SQL)
def section_winsorised_sliced(spark, folder):
    """The same by the way that days too large for a task take."""
    return _winsorised(spark, folder, sliced=True)


@query(f"""WITH {panel_sql()} SELECT asset, d,
    {r('vol / nullif(sum(abs(vol)) OVER (PARTITION BY d), 0e0)')} AS vol_share FROM panel""")
def section_scaled(spark, folder):
    return xs.scale_to_gross(panel(spark, folder).df, "vol", "vol_share").select(*KEY, tidy("vol_share").alias("vol_share"))


@query(f"""WITH {SIGNALS_SQL} SELECT asset, d, {r('ret - avg(ret) OVER (PARTITION BY d)')} AS ret_day,
    {r('ret - avg(ret) OVER (PARTITION BY d, grp)')} AS ret_grp FROM signals""")
def section_demeaned(spark, folder):
    returns = signals(spark, folder).df.select(*KEY, "grp", "ret")
    both = xs.demean(xs.demean(returns, "ret", "ret_day"), "ret", "ret_grp", ["d", "grp"])
    return both.select(*KEY, tidy("ret_day").alias("ret_day"), tidy("ret_grp").alias("ret_grp"))


@query(f"""WITH {SIGNALS_SQL},
    complete AS (SELECT d, ret AS y, volume_shock AS a, momentum AS b FROM signals
      WHERE ret IS NOT NULL AND volume_shock IS NOT NULL AND momentum IS NOT NULL),
    moments AS (SELECT d, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb,
      covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM complete GROUP BY d),
    solved AS (SELECT d, my, ma, mb, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
      (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb
      FROM moments WHERE n >= 4 AND saa > 0 AND sbb > 0 AND 1e0 - sab * sab / (saa * sbb) > 1e-9)
    SELECT s.asset, s.d, {r('s.ret - my - ba * (s.volume_shock - ma) - bb * (s.momentum - mb)')} AS residual
    FROM signals s LEFT JOIN solved USING (d)""")
def section_regression_residual(spark, folder):
    """Return of the day not explained by volume shock and momentum."""
    left = xs.regression_residual(signals(spark, folder).df, "ret", ["volume_shock", "momentum"], "residual")
    return left.select(*KEY, tidy("residual").alias("residual"))


@query(f"""WITH {panel_sql()} SELECT asset, d,
    CAST(ntile(5) OVER (PARTITION BY d ORDER BY vol, asset) AS INTEGER) AS vol_bucket FROM panel""")
def section_buckets(spark, folder):
    p = panel(spark, folder)
    return xs.bucket(p.df, "vol", "vol_bucket", 5, group_rows=p.max_day_rows).select(*KEY, "vol_bucket")


@query(f"""WITH {panel_sql()},
    placed AS (SELECT asset, d, vol, row_number() OVER (PARTITION BY d ORDER BY vol DESC, asset) AS t,
      row_number() OVER (PARTITION BY d ORDER BY vol, asset) AS b FROM panel)
    SELECT d, 'top' AS side, CAST(t AS INTEGER) AS place, asset, vol FROM placed WHERE t <= 3
    UNION ALL SELECT d, 'bottom', CAST(b AS INTEGER), asset, vol FROM placed WHERE b <= 3""")
def section_top_and_bottom(spark, folder):
    return xs.top_and_bottom(panel(spark, folder).df, "vol", 3).select("d", "side", "place", "asset", "vol")
