import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.operators import timeseries as ts
from panelsmith.operators.calendar import fill_calendar, resample
from panelsmith.operators.evaluation import forward_returns
from panelsmith.operators.quality import column_report, gaps, outliers, repeated_keys
from panelsmith.plans.inputs import SIGNALS, add_signals
from tests.conftest import day


def by_key(df, *cols):
    return {(r.asset, r.d): tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_delay_counts_rows_not_days(small_panel):
    got = by_key(small_panel.select("asset", "d", ts.delay("px", 1).alias("x")), "x")
    assert got[1, day(5)] == 12.0 and got[4, day(2)] == 7.0 and got[3, day(0)] is None


def test_change_with_missing_price(small_panel):
    got = by_key(small_panel.select("asset", "d", ts.change("px", 1).alias("x")), "x")
    assert got[1, day(1)] is None and got[1, day(2)] is None and got[1, day(5)] == 0.0


def test_constant_series_has_no_score_and_no_correlation(small_panel):
    got = by_key(small_panel.select(
        "asset", "d", ts.rolling_zscore("px", 3).alias("z"), ts.rolling_correlation("px", "vol", 3).alias("c")
    ), "z", "c")
    assert got[2, day(3)] == (None, None) and got[3, day(0)] == (None, None)


def test_window_by_days_and_by_rows_differ_over_a_gap(small_panel):
    got = by_key(small_panel.select(
        "asset", "d", F.sum("vol").over(ts.trailing(2)).alias("rows"),
        F.sum("vol").over(ts.trailing_days(2)).alias("days"),
    ), "rows", "days")
    assert got[1, day(5)] == (12.0, 7.0)


def test_ties_take_the_latest_maximum(small_panel):
    got = by_key(small_panel.select("asset", "d", ts.rows_since_max("px", 4).alias("x")), "x")
    assert got[1, day(5)] == 0 and got[2, day(3)] == 0 and got[4, day(3)] == 1


def test_missing_values_weigh_nothing(small_panel):
    got = by_key(small_panel.select("asset", "d", ts.linear_decay("px", 3).alias("x")), "x")
    assert got[1, day(2)] == pytest.approx((3 * 12 + 1 * 10) / 4)
    assert got[4, day(3)] == pytest.approx((3 * 6 + 2 * 9 + 1 * 7) / 6)


def test_rolling_features_match_pandas(random_panel):
    n = 7
    got = random_panel.select(
        "asset", "d", "px",
        ts.rolling_rank("vol", n).alias("rank"), ts.rolling_quantile("vol", 0.25, n).alias("q"),
        ts.rolling_slope("px", "vol", n).alias("slope"), ts.rolling_zscore("vol", n).alias("z"),
    ).toPandas().sort_values(["asset", "d"])
    raw = random_panel.toPandas().sort_values(["asset", "d"])
    roll = raw.groupby("asset")["vol"].rolling(n, min_periods=1)
    assert np.allclose(got["q"], roll.quantile(0.25).values)
    assert np.allclose(got["rank"], roll.apply(lambda w: (w <= w.iloc[-1]).mean(), raw=False).values)
    std = roll.std().values
    std[std == 0] = np.nan
    assert np.allclose(got["z"], (raw["vol"].values - roll.mean().values) / std, equal_nan=True)


@pytest.mark.parametrize("alpha,block", [(0.1, 8), (0.5, 64), (0.9, 16)])
def test_exponential_mean(random_panel, alpha, block):
    got = ts.exponential_mean(random_panel, "px", alpha, "e", block).toPandas().sort_values(["asset", "d"])
    known = got.dropna(subset=["px"])
    want = known.groupby("asset")["px"].transform(lambda s: s.ewm(alpha=alpha, adjust=False).mean())
    assert np.allclose(known["e"], want, rtol=1e-11)
    assert got.loc[got["px"].isna(), "e"].isna().all()


def test_exponential_mean_rejects_what_would_overflow(random_panel):
    with pytest.raises(ValueError):
        ts.exponential_mean(random_panel, "px", 0.99999, "e", block=64)


def test_trailing_features_and_signals_do_not_look_ahead(random_panel):
    cut = day(80)

    def features(df):
        made = add_signals(df).select(
            "*", ts.rolling_rank("px", 10).alias("f1"), ts.rows_since_min("px", 10).alias("f2"),
            ts.linear_decay("px", 10).alias("f3"), ts.rolling_correlation("px", "vol", 10).alias("f4"),
            F.avg("px").over(ts.trailing_days(10)).alias("f5"), ts.rolling_quantile("px", 0.5, 10).alias("f6"),
        )
        made = ts.exponential_mean(made, "px", 0.2, "f7", 16)
        cols = [*SIGNALS, *[f"f{i}" for i in range(1, 8)]]
        return made.filter(F.col("d") <= F.lit(cut)).select("asset", "d", *cols).toPandas().sort_values(["asset", "d"])

    full, cut_off = features(random_panel), features(random_panel.filter(F.col("d") <= F.lit(cut)))
    pd.testing.assert_frame_equal(full.reset_index(drop=True), cut_off.reset_index(drop=True))


def test_signals_do_not_use_today(random_panel):
    doubled = random_panel.withColumn("px", F.when(F.col("d") == F.lit(day(119)), F.col("px") * 2).otherwise(F.col("px")))
    doubled = doubled.withColumn("vol", F.when(F.col("d") == F.lit(day(119)), 99.0).otherwise(F.col("vol")))
    a = add_signals(random_panel).select("asset", "d", *SIGNALS).toPandas().sort_values(["asset", "d"])
    b = add_signals(doubled).select("asset", "d", *SIGNALS).toPandas().sort_values(["asset", "d"])
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_forward_returns(small_panel):
    got = by_key(forward_returns(small_panel, [1]), "fwd_1")
    assert got[4, day(0)] == pytest.approx(9 / 7 - 1) and got[4, day(3)] is None


def test_calendar_fill(small_panel):
    got = by_key(fill_calendar(small_panel, ["px", "vol"]), "px", "vol", "filled")
    assert got[1, day(1)] == (10.0, 6.0, False)  # a missing price takes the last one
    assert got[1, day(3)] == got[1, day(4)] == (12.0, 5.0, True)
    assert got[4, day(1)] == (7.0, 2.0, True)
    assert (3, day(1)) not in got and len(got) == 6 + 4 + 1 + 4


def test_resample(small_panel):
    got = {(r.asset, r.bar): r for r in resample(small_panel, "week").collect()}
    bar = got[4, day(0)]
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume, bar.days) == (7.0, 9.0, 6.0, 6.0, 8.0, 3)


def test_quality_reports(spark, small_panel):
    report = {r["column"]: r for r in column_report(small_panel).collect()}
    assert report["px"].nulls == 1 and report["px"].rows == 12 and report["vol"].nulls == 0
    assert report["asset"].least == "1" and report["asset"].greatest == "4"
    assert repeated_keys(small_panel, ["asset", "d"]).count() == 0
    assert repeated_keys(small_panel.union(small_panel.limit(1)), ["asset", "d"]).first().copies == 2
    holes = {r.asset: (r.days, r.gaps, r.longest, r.missed) for r in gaps(small_panel).collect()}
    assert holes[1] == (4, 1, 3, 2) and holes[2] == (4, 0, 1, 0) and holes[3] == (1, 0, None, 0)
    spiked = spark.createDataFrame([(1, day(i), 1000.0 if i == 30 else float(i % 3)) for i in range(31)], "asset long, d date, px double")
    assert [r.d for r in outliers(spiked, "px", 3.0).collect()] == [day(30)]
