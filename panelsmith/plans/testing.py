"""Queries that test signals, hold them as portfolios and judge the results."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelsmith.functions.numeric import correlation, ratio, tidy, two_sided_p
from panelsmith.operators import evaluation as ev
from panelsmith.operators import grouping, inference, portfolio
from panelsmith.operators.crosssection import demean
from panelsmith.operators.ordering import SLICES
from panelsmith.plans.inputs import (
    DAILY_SQL,
    HORIZONS,
    LONG_SQL,
    PAST,
    SIGNALS,
    SIGNALS_SQL,
    daily_signals,
    guarded_corr_sql,
    ic_sql,
    long_signals,
    panel,
    panel_from_tables,
    panel_sql,
    r,
    signals,
    spread_signals,
    volume_shock,
)
from panelsmith.plans.registry import query
from panelsmith.sources.tables import load


@query(f"""WITH {panel_sql()} SELECT asset, d,
    {r(f'lead(px, 1) OVER ({PAST}) / nullif(px, 0e0) - 1')} AS fwd_1,
    {r(f'lead(px, 5) OVER ({PAST}) / nullif(px, 0e0) - 1')} AS fwd_5,
    {r(f'lead(px, 20) OVER ({PAST}) / nullif(px, 0e0) - 1')} AS fwd_20 FROM panel""")
def forward_return_targets(spark, folder):
    made = ev.forward_returns(panel(spark, folder).df, HORIZONS)
    return made.select("asset", "d", *[tidy(f"fwd_{h}").alias(f"fwd_{h}") for h in HORIZONS])


@query(f"""WITH {panel_sql('n_nationkey')},
    shocked AS (SELECT *,
        lag(vol) OVER ({PAST}) - avg(vol) OVER ({PAST} ROWS BETWEEN 20 PRECEDING AND 2 PRECEDING) AS shock,
        lead(px, 1) OVER ({PAST}) / nullif(px, 0e0) - 1 AS fwd_1 FROM panel),
    neutral AS (SELECT *, shock - avg(shock) OVER (PARTITION BY d, grp) AS x FROM shocked),
    {ic_sql('neutral', 'd')}
    SELECT d, assets, {r('rank_ic')} AS rank_ic, {r('ic')} AS ic FROM ics""")
def nation_rank_ic(spark, folder):
    """Daily IC of a region-neutral volume shock over nations, from the raw tables in one plan.

    A day holds one row per nation, so its size is that of the nation table.
    Placing the rows by day first serves the regional means, the ranks and
    the final correlation with a single shuffle.
    """
    nations = load(spark, folder, "nation").count()
    df = panel_from_tables(spark, folder, "nation").withColumn("shock", volume_shock())
    df = ev.forward_returns(df, [1]).repartition("d")
    neutral = demean(df, "shock", "x", ["d", "grp"], group_rows=nations)
    ics = ev.daily_ic(neutral, "x", "fwd_1", ["d"], group_rows=nations)
    return ics.select("d", "assets", tidy("rank_ic").alias("rank_ic"), tidy("ic").alias("ic"))


DAILY_IC_SQL = f"""WITH {LONG_SQL}, {ic_sql('long', 'signal, d')}
    SELECT signal, d, assets, {r('rank_ic')} AS rank_ic, {r('ic')} AS ic FROM ics"""


@query(DAILY_IC_SQL)
def signal_daily_ic_sliced(spark, folder):
    """The same in ranges of rows: days that the end of a range cuts go the way of days too large for a task."""
    stored = signals(spark, folder)
    ics = ev.daily_ic_in_slices(stored.df, spread_signals, stored.rows * len(SIGNALS), SLICES)
    return ics.select("signal", "d", "assets", tidy("rank_ic").alias("rank_ic"), tidy("ic").alias("ic"))


@query(DAILY_IC_SQL)
def signal_daily_ic(spark, folder):
    df, rows = long_signals(spark, folder)
    ics = ev.daily_ic(df, group_rows=rows)
    return ics.select("signal", "d", "assets", tidy("rank_ic").alias("rank_ic"), tidy("ic").alias("ic"))


SUMMARY_SQL = f"""count(*) AS days, {r('avg(rank_ic)')} AS mean_ic, {r('stddev_samp(rank_ic)')} AS std_ic,
      {r('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0e0)')} AS ic_ratio,
      {r('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0e0) * sqrt(CAST(count(*) AS DOUBLE))')} AS t_value,
      {r(f"avg(CASE WHEN {r('rank_ic', 9)} > 0 THEN 1e0 ELSE 0e0 END)")} AS hit_rate"""


@query(f"""WITH {LONG_SQL}, {ic_sql('long', 'signal, d')}
    SELECT signal, {SUMMARY_SQL} FROM ics WHERE rank_ic IS NOT NULL GROUP BY signal""")
def signal_ic_summary(spark, folder):
    df, rows = long_signals(spark, folder)
    return ev.ic_summary(ev.daily_ic(df, group_rows=rows))


@query(f"""WITH {LONG_SQL},
    {', '.join(ic_sql('long', 'signal, d', f'fwd_{h}', f'ics_{h}') for h in HORIZONS)},
    every AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, * FROM ics_{h}' for h in HORIZONS)}),
    known_ics AS (SELECT * FROM every WHERE rank_ic IS NOT NULL),
    ic_errors AS (SELECT *, rank_ic - avg(rank_ic) OVER (PARTITION BY signal, horizon) AS e FROM known_ics),
    ic_lags AS (SELECT *, {', '.join(f'lag(e, {k}) OVER (PARTITION BY signal, horizon ORDER BY d) AS e{k}' for k in range(1, max(HORIZONS)))}
      FROM ic_errors),
    overlap AS (SELECT signal, horizon, avg(rank_ic) AS m, count(*) AS n, sum(e * e) + {' + '.join(
        f'2e0 * coalesce(sum(greatest(0e0, 1e0 - {k}e0 / horizon) * e * e{k}), 0e0)' for k in range(1, max(HORIZONS)))} AS s
      FROM ic_lags GROUP BY signal, horizon),
    summary AS (SELECT signal, horizon, {SUMMARY_SQL} FROM known_ics GROUP BY signal, horizon)
    SELECT signal, CAST(horizon AS INTEGER) AS horizon, days, mean_ic, std_ic, ic_ratio, t_value, hit_rate,
      {r('m / nullif(sqrt(CASE WHEN s > 0 THEN s END) / n, 0e0)')} AS t_overlap
    FROM summary JOIN overlap USING (signal, horizon)""")
def signal_ic_decay(spark, folder):
    df, rows = long_signals(spark, folder, copies=len(HORIZONS))
    return ev.ic_decay(df, HORIZONS, group_rows=rows)


@query(f"""WITH {LONG_SQL},
    placed AS (SELECT signal, d, fwd_1, ntile(5) OVER (PARTITION BY signal, d ORDER BY {r('x', 9)}, asset) AS b
      FROM long WHERE x IS NOT NULL AND fwd_1 IS NOT NULL),
    daily AS (SELECT signal, d, {', '.join(f'avg(fwd_1) FILTER (WHERE b = {b}) AS q{b}' for b in range(1, 6))}
      FROM placed GROUP BY signal, d),
    means AS (SELECT signal, count(q5 - q1) AS days, avg(q5 - q1) AS spread,
      {', '.join(f'avg(q{b}) AS q{b}' for b in range(1, 6))} FROM daily GROUP BY signal)
    SELECT signal, days, {r('spread')} AS spread, {', '.join(f"{r(f'q{b}')} AS q{b}" for b in range(1, 6))},
      {r('(' + ' + '.join(f'CASE WHEN q{b + 1} > q{b} THEN 1e0 ELSE 0e0 END' for b in range(1, 5)) + ') / 4e0')} AS monotone
    FROM means""")
def signal_quantile_spread(spark, folder):
    df, rows = long_signals(spark, folder)
    return ev.quantile_spread(ev.quantile_returns(df, 5, group_rows=rows))


BOOK_SQL = f"""{DAILY_SQL},
    centred AS (SELECT *, x - avg(x) OVER (PARTITION BY signal, d) AS c FROM long WHERE x IS NOT NULL),
    held AS (SELECT *, c / nullif(sum(abs(c)) OVER (PARTITION BY signal, d), 0e0) AS w FROM centred)"""


# Weights are often small fractions; on a grid of one over an odd prime only one half lies half way between two points.
GRID = 999_983
NOISE = 1e-12


def on_grid(w: Column) -> Column:
    """A weight on the grid.  A lone asset on its side holds one half, whatever noise the sums over the others left."""
    half = F.abs(F.abs(w) - F.lit(0.5)) < F.lit(NOISE)
    return F.rint(F.when(half, F.signum(w) * F.lit(0.5)).otherwise(w) * F.lit(float(GRID))) / F.lit(float(GRID)) + F.lit(0.0)


@query(f"""WITH {BOOK_SQL} SELECT signal, asset, d, round_even(w * {GRID}e0, 0) / {GRID}e0 + 0e0 AS w FROM held""")
def book_weights(spark, folder):
    """What each book holds of each asset on each day."""
    held = portfolio.weights_of_books(daily_signals(spark, folder).df, SIGNALS, ["asset", "d"])
    return held.select("signal", "asset", "d", on_grid(F.col("w")).alias("w"))


@query(f"""WITH {BOOK_SQL},
    days AS (SELECT signal, d, lag(d) OVER (PARTITION BY signal ORDER BY d) AS prev_d,
      lead(d) OVER (PARTITION BY signal ORDER BY d) AS next_d FROM (SELECT DISTINCT signal, d FROM held)),
    bought AS (SELECT h.signal, h.d, sum(abs(coalesce(h.w, 0e0) - coalesce(p.w, 0e0))) AS size
      FROM held h JOIN days USING (signal, d)
      LEFT JOIN held p ON p.signal = h.signal AND p.asset = h.asset AND p.d = days.prev_d GROUP BY 1, 2),
    sold AS (SELECT h.signal, days.next_d AS d, sum(abs(coalesce(h.w, 0e0))) AS size
      FROM held h JOIN days USING (signal, d)
      LEFT JOIN held n ON n.signal = h.signal AND n.asset = h.asset AND n.d = days.next_d
      WHERE days.next_d IS NOT NULL AND n.asset IS NULL GROUP BY 1, 2)
    SELECT signal, d, {r('sum(size)')} AS turnover, {r('sum(size) * 1e-3', 9)} AS cost
    FROM (SELECT * FROM bought UNION ALL SELECT * FROM sold) GROUP BY signal, d""")
def book_turnover(spark, folder):
    stored = daily_signals(spark, folder)
    traded = portfolio.turnover_of_books(stored.df, SIGNALS, rows=stored.rows)
    return traded.select("signal", "d", tidy("turnover").alias("turnover"), tidy("cost", 9).alias("cost"))


PATH_SQL = f"""{BOOK_SQL},
    returns AS (SELECT signal, d, sum(w * fwd_1) AS r FROM held
      WHERE w IS NOT NULL AND fwd_1 IS NOT NULL GROUP BY signal, d),
    wealth AS (SELECT *,
      coalesce(sum(CASE WHEN r > -1 THEN ln(1e0 + r) END) OVER (PARTITION BY signal ORDER BY d), 0e0) AS log_wealth,
      count(*) FILTER (WHERE r <= -1) OVER (PARTITION BY signal ORDER BY d) AS wiped_days FROM returns),
    path AS (SELECT *, exp(log_wealth - greatest(max(log_wealth) OVER (PARTITION BY signal ORDER BY d), 0e0)) - 1
      AS drawdown FROM wealth)"""


@query(f"""WITH {PATH_SQL} SELECT signal, d, {r('r')} AS r, {r('log_wealth')} AS log_wealth, wiped_days,
    {r('drawdown')} AS drawdown FROM path""")
def book_performance(spark, folder):
    path = portfolio.performance(portfolio.returns_of_books(daily_signals(spark, folder).df, SIGNALS))
    return path.select(
        "signal", "d", tidy("r").alias("r"), tidy("log_wealth").alias("log_wealth"), "wiped_days",
        tidy("drawdown").alias("drawdown"),
    )


@query(f"""WITH {PATH_SQL},
    centred_path AS (SELECT *, r - avg(r) OVER (PARTITION BY signal) AS e FROM path)
    SELECT signal, count(r) AS days, {r('avg(r)')} AS mean_return, {r('stddev_samp(r) * sqrt(365e0)')} AS volatility,
      {r('avg(r) / nullif(stddev_samp(r), 0e0) * sqrt(365e0)')} AS sharpe,
      {r('avg(e * e * e) / nullif(pow(avg(e * e), 1.5e0), 0e0)')} AS skew,
      {r('avg(e * e * e * e) / nullif(pow(avg(e * e), 2e0), 0e0) - 3')} AS kurtosis,
      {r('min(drawdown)')} AS max_drawdown
    FROM centred_path GROUP BY signal""")
def book_risk(spark, folder):
    path = portfolio.performance(portfolio.returns_of_books(daily_signals(spark, folder).df, SIGNALS))
    return portfolio.risk_summary(path, periods=portfolio.CALENDAR_DAYS)


@query(f"""WITH {LONG_SQL},
    slopes AS (SELECT signal, d, covar_pop(x, fwd_1) / nullif(var_pop(x), 0e0) AS b FROM long
      WHERE x IS NOT NULL AND fwd_1 IS NOT NULL GROUP BY signal, d
      HAVING count(*) >= 5 AND max(x) > min(x)),
    errors AS (SELECT *, b - avg(b) OVER (PARTITION BY signal) AS e FROM slopes),
    lagged AS (SELECT *, lag(e, 1) OVER (PARTITION BY signal ORDER BY d) AS e1,
      lag(e, 2) OVER (PARTITION BY signal ORDER BY d) AS e2 FROM errors),
    sums AS (SELECT signal, count(*) AS days, avg(b) AS m,
      sum(e * e) + 2e0 * (1e0 - 1e0 / 3e0) * sum(e * e1) + 2e0 * (1e0 - 2e0 / 3e0) * sum(e * e2) AS s
      FROM lagged GROUP BY signal)
    SELECT signal, days, {r('m', 9)} AS mean_slope, {r('m / nullif(sqrt(s) / days, 0e0)')} AS t_value FROM sums""")
def signal_fama_macbeth(spark, folder):
    # Plain aggregates, partly formed where the rows are read: no placing by day.
    return inference.fama_macbeth(spread_signals(signals(spark, folder).df))


STEPS_SQL = " + ".join(f"CAST(u >= {step!r} AS INTEGER)" for step in inference._poisson_steps())


@query(f"""WITH {LONG_SQL}, {ic_sql('long', 'signal, d')},
    draws AS (SELECT signal, k, rank_ic,
      CAST('0x' || substr(md5(k || ':' || CAST(d AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS u
      FROM ics, (SELECT unnest(range(1, 201)) AS k) WHERE rank_ic IS NOT NULL),
    means AS (SELECT signal, k, sum(({STEPS_SQL}) * rank_ic) / nullif(sum({STEPS_SQL}), 0) AS m
      FROM draws GROUP BY signal, k)
    SELECT signal, {r('mean')} AS mean, replicas, low, high
    FROM (SELECT signal, avg(rank_ic) AS mean FROM ics GROUP BY signal)
    JOIN (SELECT signal, count(m) AS replicas, {r('quantile_cont(m, 0.025)')} AS low, {r('quantile_cont(m, 0.975)')} AS high
      FROM means GROUP BY signal) USING (signal)""")
def signal_ic_bootstrap(spark, folder):
    df, rows = long_signals(spark, folder)
    return inference.bootstrap_mean(ev.daily_ic(df, group_rows=rows), "rank_ic", "d", ["signal"])


MEAN_BLOCK, STEP_DOWN_REPLICAS = 20, 500


def _means_sql(replicas: int) -> str:
    """CTEs that end in ``means``: the mean IC of each signal in each replica of a stationary bootstrap."""
    def share(place: int) -> str:
        return f"CAST('0x' || substr(md5(k || ':' || i), {place}, 8) AS BIGINT) / 4294967296e0"

    return f"""known_ics AS (SELECT signal, d, rank_ic FROM ics WHERE rank_ic IS NOT NULL),
    dates AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM known_ics)),
    walk AS (SELECT k, i, n, CASE WHEN i = 0 OR {share(1)} < 1e0 / {MEAN_BLOCK}e0
        THEN CAST(floor({share(9)} * n) AS BIGINT) - i END AS jump
      FROM dates, (SELECT unnest(range(1, {replicas + 1})) AS k)),
    drawn AS (SELECT k, (last_value(jump IGNORE NULLS) OVER (PARTITION BY k ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i) % n AS i FROM walk),
    times AS (SELECT k, i, count(*) AS times FROM drawn GROUP BY k, i),
    means AS (SELECT signal, k, sum(times * rank_ic) / sum(times) AS m
      FROM known_ics JOIN dates USING (d) JOIN times USING (i) GROUP BY signal, k),
    plain AS (SELECT signal, avg(rank_ic) AS mean FROM known_ics GROUP BY signal)"""


@query(f"""WITH {LONG_SQL}, {ic_sql('long', 'signal, d')}, {_means_sql(200)}
    SELECT signal, {r('any_value(mean)')} AS mean, count(m) AS replicas, {r('stddev_samp(m)')} AS std_error,
      {r('quantile_cont(m, 0.025)')} AS low, {r('quantile_cont(m, 0.975)')} AS high
    FROM means JOIN plain USING (signal) GROUP BY signal""")
def signal_ic_stationary_bootstrap(spark, folder):
    """Intervals of the mean IC that allow for dependence from day to day."""
    df, rows = long_signals(spark, folder)
    return inference.stationary_bootstrap(ev.daily_ic(df, group_rows=rows), "rank_ic", ["signal"], mean_block=MEAN_BLOCK)


@query(f"""WITH {LONG_SQL}, {ic_sql('long', 'signal, d')}, {_means_sql(STEP_DOWN_REPLICAS)},
    errors AS (SELECT signal, stddev_samp(m) AS error FROM means GROUP BY signal),
    facts AS (SELECT signal, mean, error, {r('mean / error', 8)} AS t FROM plain JOIN errors USING (signal) WHERE error > 0),
    placed AS (SELECT *, row_number() OVER (ORDER BY abs(t) DESC, signal) AS place FROM facts),
    away AS (SELECT signal, k, t, max({r('abs(m - mean) / error', 8)}) OVER (PARTITION BY k ORDER BY place DESC) AS largest
      FROM means JOIN placed USING (signal)),
    raw AS (SELECT signal, (count(*) FILTER (WHERE largest >= abs(t)) + 1) / (count(*) + 1e0) AS p FROM away GROUP BY signal),
    tested AS (SELECT *, max(p) OVER (ORDER BY place) AS q FROM placed JOIN raw USING (signal))
    SELECT signal, {r('mean', 9)} AS mean, {r('t', 4)} AS t_value, {r('q')} AS p_adjusted, q <= 0.05e0 AS kept FROM tested""")
def signal_ic_step_down(spark, folder):
    """Which signals have an IC, tested together."""
    df, rows = long_signals(spark, folder)
    return inference.step_down(ev.daily_ic(df, group_rows=rows), "rank_ic", "signal", STEP_DOWN_REPLICAS, MEAN_BLOCK)


def _pair_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS signal_a, '{b}' AS signal_b, {r(guarded_corr_sql(a, b))} AS correlation
      FROM signals WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


@query(f"WITH {SIGNALS_SQL} " + " UNION ALL ".join(
    _pair_sql(a, b) for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1:]
))
def signal_correlation_pairs(spark, folder):
    return inference.signal_correlations(signals(spark, folder).df, SIGNALS)


LAGS = range(6)
LAGGED = {f"{s}_{k}": (s, k) for s in SIGNALS for k in LAGS}


@query(f"""WITH {SIGNALS_SQL},
    lagged AS (SELECT asset, d, {', '.join(f'lag({s}, {k}) OVER ({PAST}) AS {name}' for name, (s, k) in LAGGED.items())} FROM signals),
    long_lagged AS ({' UNION ALL '.join(f"SELECT '{name}' AS signal, {i} AS place, asset, d, {name} AS x FROM lagged WHERE {name} IS NOT NULL" for i, name in enumerate(LAGGED))})
    SELECT l.signal AS signal_a, r.signal AS signal_b, {r(guarded_corr_sql('l.x', 'r.x'))} AS correlation
    FROM long_lagged l JOIN long_lagged r ON l.asset = r.asset AND l.d = r.d AND l.place < r.place GROUP BY 1, 2""")
def lagged_signal_correlations(spark, folder):
    """Every two signals, each as of today and of the five days before: 435 pairs from one scan."""
    past = Window.partitionBy("asset").orderBy("d")
    lagged = signals(spark, folder).df.select("asset", "d", *[F.lag(s, k).over(past).alias(name) for name, (s, k) in LAGGED.items()])
    return inference.signal_correlations(lagged, list(LAGGED))


TEST_DAYS = 10
TESTS_SQL = f"""WITH {SIGNALS_SQL},
    raw AS (SELECT asset, count(*) AS n, {guarded_corr_sql('volume_shock', 'fwd_1')} AS c FROM signals
      WHERE volume_shock IS NOT NULL AND fwd_1 IS NOT NULL GROUP BY asset HAVING count(*) >= {TEST_DAYS}),
    scored AS (SELECT asset, abs(c) * sqrt((n - 2) / nullif(1e0 - c * c, 0e0)) / sqrt(2e0) AS z FROM raw),
    steps AS (SELECT asset, z, 1e0 / (1e0 + 0.3275911e0 * z) AS u FROM scored),
    tests AS (SELECT asset, u * (0.254829592e0 + u * (-0.284496736e0 + u * (1.421413741e0 + u * (-1.453152027e0
      + u * 1.061405429e0)))) * exp(-z * z) AS p FROM steps WHERE z IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (ORDER BY p, asset) AS pos, count(*) OVER () AS n FROM tests),
    adjusted AS (SELECT asset, p, least(min(p * n / pos) OVER (ORDER BY pos DESC), 1e0) AS q FROM placed)
    SELECT asset, {r('p')} AS p, {r('q')} AS q, q <= 0.1e0 AS kept FROM adjusted"""


def _asset_tests(spark, folder, rows, slices=None):
    """One test per asset with at least ``TEST_DAYS`` complete days: does its volume shock go with its next return?"""
    complete = signals(spark, folder).df.filter("volume_shock IS NOT NULL AND fwd_1 IS NOT NULL")
    raw = complete.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), correlation("volume_shock", "fwd_1").alias("c")
    ).filter(F.col("n") >= TEST_DAYS)
    t = F.abs("c") * F.sqrt(ratio((F.col("n") - 2).cast("double"), 1 - F.col("c") * F.col("c")))
    found = inference.benjamini_hochberg(raw.select("asset", two_sided_p(t).alias("p")), "p", "asset", 0.1, rows=rows, slices=slices)
    return found.select("asset", tidy("p").alias("p"), tidy("q").alias("q"), "kept")


@query(TESTS_SQL)
def asset_tests_corrected(spark, folder):
    return _asset_tests(spark, folder, load(spark, folder, "supplier").count())  # no more tests than suppliers


@query(TESTS_SQL)
def asset_tests_corrected_sliced(spark, folder):
    """The same by the way that more tests than fit a task take."""
    return _asset_tests(spark, folder, None, SLICES)


DIMS_SQL = """SELECT grp, CAST(year(d) AS INTEGER) AS year, CASE WHEN volume_shock > 0 THEN 'up' ELSE 'down' END AS side,
      fwd_1 FROM signals WHERE volume_shock IS NOT NULL AND fwd_1 IS NOT NULL"""


def _summary_input(spark, folder):
    df = signals(spark, folder).df.filter("volume_shock IS NOT NULL")
    dims = {
        "grp": F.col("grp"), "year": F.year("d"),
        "side": F.when(F.col("volume_shock") > 0, "up").otherwise("down"),
    }
    return df, dims


def _grouped_sql(how: str) -> str:
    return f"""WITH {SIGNALS_SQL}, facts AS ({DIMS_SQL})
    SELECT grp, year, side, CAST(grouping_id(grp, year, side) AS BIGINT) AS level, count(*) AS n,
      {r('avg(fwd_1)')} AS mean FROM facts GROUP BY {how}(grp, year, side)"""


@query(_grouped_sql("CUBE"))
def return_cube(spark, folder):
    return grouping.summarise(*_summary_input(spark, folder), "fwd_1", "cube").withColumn("mean", tidy("mean"))


@query(_grouped_sql("ROLLUP"))
def return_rollup(spark, folder):
    return grouping.summarise(*_summary_input(spark, folder), "fwd_1", "rollup").withColumn("mean", tidy("mean"))
