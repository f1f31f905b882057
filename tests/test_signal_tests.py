import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.operators import crosssection as xs
from panelsmith.operators import evaluation as ev
from panelsmith.operators import grouping, inference, portfolio
from panelsmith.operators.timeseries import delay
from panelsmith.sources.panels import build_panel
from panelsmith.sources.tables import load
from tests.conftest import day

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("a", "b"):
        for n in range(60):
            for asset in range(12):
                x = None if rng.random() < 0.05 else float(rng.integers(0, 6))
                rows.append((s, asset, day(n), x, None if n == 59 else float(rng.standard_normal()) / 50))
    return spark.createDataFrame(rows, "signal string, asset long, d date, x double, fwd_1 double").cache()


def test_rank_ic_is_spearman(long):
    got = ev.daily_ic(long, group_rows=12).toPandas().set_index(["signal", "d"])
    unknown = ev.daily_ic(long).toPandas().set_index(["signal", "d"]).loc[got.index]
    assert np.allclose(got["rank_ic"], unknown["rank_ic"]) and np.allclose(got["ic"], unknown["ic"])
    raw = long.toPandas().dropna()
    for key, part in raw.groupby(["signal", "d"]):
        assert got.loc[key, "rank_ic"] == pytest.approx(part["x"].rank().corr(part["fwd_1"].rank()))
        assert got.loc[key, "assets"] == len(part)
    assert len(got) == 2 * 59


def test_lagged_signal_passes_and_unlagged_volume_fails_the_placebo_check(spark):
    """Volume is the divisor of the price, so that unlagged it seems to predict."""
    tables = [load(spark, FOLDER, t) for t in ("lineitem", "supplier", "nation")]
    panel = ev.forward_returns(build_panel(*tables, "nation"), [1]).cache()
    panel = panel.withColumn("lagged", delay("vol", 1)).withColumn("hashed", F.xxhash64("asset", "d") / 1e18)
    summary = ev.ic_summary(ev.daily_ic(ev.long_form(panel, ["vol", "lagged", "hashed"], ["d", "fwd_1"]), group_rows=25))
    t = {r.signal: r.t_value for r in summary.collect()}
    assert t["vol"] > 20 and abs(t["lagged"]) < 4 and abs(t["hashed"]) < 4


def test_quantile_spread(long):
    got = ev.quantile_spread(ev.quantile_returns(long, 3, group_rows=12), 3).toPandas()
    unknown = ev.quantile_spread(ev.quantile_returns(long, 3), 3).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("signal", ignore_index=True), unknown.sort_values("signal", ignore_index=True))
    assert set(got["monotone"]) <= {0.0, 0.5, 1.0}


def test_weights_are_neutral_with_unit_gross(long):
    held = portfolio.weights(long, group_rows=12).toPandas()
    sums = held.groupby(["signal", "d"])["w"]
    assert np.allclose(sums.sum(), 0, atol=1e-12) and np.allclose(sums.apply(lambda w: w.abs().sum()), 1)


def test_exits_are_charged(spark):
    held = spark.createDataFrame(
        [("s", 1, day(0), 0.5), ("s", 2, day(0), -0.5), ("s", 1, day(1), 0.5), ("s", 3, day(4), 1.0), ("s", 2, day(4), 0.25)],
        "signal string, asset long, d date, w double",
    )
    got = {r.d: (r.turnover, r.cost) for r in portfolio.turnover(held, rate=0.01).collect()}
    assert got[day(0)][0] == 1.0
    assert got[day(1)][0] == 0.5            # asset 2 is gone
    assert got[day(4)][0] == 0.5 + 1.0 + 0.25  # asset 1 is sold, 3 and 2 are bought
    assert got[day(4)][1] == pytest.approx(0.0175)


def test_wiped_days_are_counted_not_compounded(spark):
    returns = spark.createDataFrame(
        [("s", day(0), 0.1), ("s", day(1), -1.5), ("s", day(2), -0.5)], "signal string, d date, r double"
    )
    rows = portfolio.performance(returns).orderBy("d").collect()
    assert [r.wiped_days for r in rows] == [0, 1, 1]
    assert rows[2].log_wealth == pytest.approx(math.log(1.1) + math.log(0.5))
    assert rows[2].drawdown == pytest.approx(-0.5)


def test_risk_summary(spark):
    rng = np.random.default_rng(1)
    r = rng.standard_normal(80) / 100
    returns = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(r)], "signal string, d date, r double")
    got = portfolio.risk_summary(portfolio.performance(returns)).first()
    e = r - r.mean()
    assert got.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(252), abs=1e-5)
    assert got.skew == pytest.approx((e**3).mean() / (e**2).mean() ** 1.5, abs=1e-5)
    assert got.kurtosis == pytest.approx((e**4).mean() / (e**2).mean() ** 2 - 3, abs=1e-5)
    wealth = np.cumprod(1 + r)
    assert got.max_drawdown == pytest.approx((wealth / np.maximum(np.maximum.accumulate(wealth), 1) - 1).min(), abs=1e-5)


def test_fama_macbeth(long):
    got = {r.signal: r for r in inference.fama_macbeth(long).collect()}
    raw = long.toPandas().dropna()
    for s, part in raw.groupby("signal"):
        b = part.groupby("d").apply(lambda p: np.polyfit(p["x"], p["fwd_1"], 1)[0], include_groups=False).to_numpy()
        e, n = b - b.mean(), len(b)
        spread = e @ e + 2 * (2 / 3) * (e[1:] @ e[:-1]) + 2 * (1 / 3) * (e[2:] @ e[:-2])
        assert got[s].days == n and got[s].mean_slope == pytest.approx(b.mean(), abs=1e-8)
        assert got[s].t_value == pytest.approx(b.mean() / (math.sqrt(spread) / n), abs=1e-5)


def test_regression_residual_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in range(10):
        for asset in range(3 if n == 0 else 15):
            f = [float(v) for v in rng.standard_normal(3)]
            rows.append((asset, day(n), None if asset == 7 else float(rng.standard_normal()), f[0], 2 * f[0] if n == 1 else f[1], f[2]))
    df = spark.createDataFrame(rows, "asset long, d date, y double, a double, b double, c double")
    got = xs.regression_residual(df, "y", ["a", "b", "c"], "res").toPandas().sort_values(["d", "asset"])
    assert got.loc[got["d"].isin([day(0), day(1)]), "res"].isna().all()  # too few rows, collinear
    for d, part in got[got["d"] > day(1)].groupby("d"):
        known = part.dropna(subset=["y"])
        x = np.column_stack([np.ones(len(known)), known[["a", "b", "c"]]])
        want = known["y"] - x @ np.linalg.lstsq(x, known["y"], rcond=None)[0]
        assert np.allclose(known["res"], want, atol=1e-9)
        assert part.loc[part["y"].isna(), "res"].isna().all()


def test_top_and_bottom_prunes_before_the_shuffle(long, capsys):
    got = xs.top_and_bottom(long, "x", 2, ["signal", "d"])
    assert got.groupBy("signal", "d", "side").count().agg(F.max("count")).first()[0] == 2
    got.explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(4)
    p = [float(v) for v in np.round(np.concatenate([rng.random(300), rng.random(40) / 200, [0.02] * 60]), 4)]
    tests = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(999, None)], "id long, p double")
    known = inference.benjamini_hochberg(tests, "p", "id", rows=500).toPandas().sort_values("id")
    sliced = inference.benjamini_hochberg(tests, "p", "id", slices=8).toPandas().sort_values("id")
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = np.empty(len(p))
    want[order] = np.minimum(q, 1)
    assert np.allclose(known["q"], want) and np.allclose(sliced["q"], want)
    assert list(known["kept"]) == list(sliced["kept"]) == list(want <= 0.1)


def test_bootstrap_interval_covers_like_the_normal_one(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(400)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "s string, i long, x double")
    got = inference.bootstrap_mean(df, "x", "i", ["s"], replicas=400).first()
    half = 1.96 * x.std() / 20
    assert got.mean == pytest.approx(x.mean(), abs=1e-6) and got.replicas == 400
    assert got.low == pytest.approx(x.mean() - half, abs=0.03) and got.high == pytest.approx(x.mean() + half, abs=0.03)


def test_signal_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, None, 5.0), (4.0, 0.0, 5.0)], "a double, b double, c double")
    got = {(r.signal_a, r.signal_b): r.correlation for r in inference.signal_correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 0])[0, 1], abs=1e-6)
    assert got[("a", "c")] is None and got[("b", "c")] is None


@pytest.mark.parametrize("how,levels", [("cube", 4), ("rollup", 3)])
def test_summaries(long, how, levels):
    dims = {"signal": F.col("signal"), "month": F.month("d")}
    got = grouping.summarise(long, dims, "fwd_1", how).collect()
    assert len({r.level for r in got}) == levels
    total = [r for r in got if r.level == 3][0]
    known = long.toPandas()["fwd_1"].dropna()
    assert total.n == len(known) and total["mean"] == pytest.approx(known.mean())


def test_a_gap_in_the_data_is_no_trade(spark):
    """Asset 2 has no row on two days: it is held meanwhile, earns its move when it is seen, and is sold at its end."""
    from panelsmith.operators.calendar import fill_calendar
    from panelsmith.operators.evaluation import forward_returns, long_form

    day = lambda n: dt.date(2024, 1, 1 + n)
    rows = [(1, 0, day(n), 10.0 + n, 1.0) for n in range(6)] + [(2, 0, day(0), 20.0, -1.0), (2, 0, day(3), 30.0, -1.0)]
    panel = spark.createDataFrame(rows, "asset int, grp int, d date, px double, x1 double")
    made = forward_returns(fill_calendar(panel, ["px", "x1"]), [1])
    held = portfolio.weights(long_form(made, ["x1"], ["asset", "d", "fwd_1"]), group_rows=2)
    traded = {r.d: r.turnover for r in portfolio.turnover(held).collect()}
    assert [round(traded[day(n)], 9) for n in range(5)] == [1.0, 0.0, 0.0, 0.0, 1.0]
    earned = {r.d: r.r for r in portfolio.daily_returns(held).collect()}
    assert earned[day(0)] == pytest.approx(0.5 * 0.1) and earned[day(2)] == pytest.approx(0.5 * (13 / 12 - 1) - 0.5 * 0.5)
    days = spark.createDataFrame([("x1", day(n)) for n in range(6)], "signal string, d date")
    assert {r.d: r.turnover for r in portfolio.turnover(held, days=days).collect()} == traded


def test_daily_ic_in_slices_writes_only_days_that_a_range_cuts(spark, monkeypatch):
    """Days of all sizes give what a plain window gives, and F1's long rows are not written."""
    from panelsmith.operators import ordering

    rng = np.random.default_rng(8)
    pick = lambda: [None, float("nan"), 0.0, -0.0, float(rng.normal())][rng.choice(5, p=[0.05, 0.05, 0.2, 0.1, 0.6])]
    sizes = [4000, 300, 3, *[40] * 50]
    wide = ordering.settle(spark.createDataFrame(
        [(i, n, pick(), pick(), pick()) for n, size in enumerate(sizes) for i in range(size)], "asset long, d int, a double, b double, fwd_1 double"), "wide")
    spread = lambda df: ev.long_form(df, ["a", "b"], ["asset", "d", "fwd_1"])
    written, settle = [], ordering.settle
    monkeypatch.setattr(ordering, "settle", lambda df, label, *a: written.append(settle(df, label, *a)) or written[-1])
    shown = lambda df: sorted((r.signal, r.d, r.assets, round(r.rank_ic, 9), round(r.ic, 9)) for r in df.collect())
    sliced = shown(ev.daily_ic_in_slices(wide, spread, 2 * sum(sizes), 16))
    assert sliced == shown(ev.daily_ic(spread(wide), group_rows=4000)) and len(sliced) == 2 * 52
    days = {r.d for t in written if t.columns == ["d", "_group"] for r in t.collect()}
    assert 0 in days and len(days) <= 16
    assert max(t.count() for t in written if "_place" in t.columns) <= 2 * sum(sizes[d] for d in days)


def test_signal_daily_ic_sliced_writes_few_of_its_rows(spark, monkeypatch):
    from panelsmith.operators import ordering
    from panelsmith.plans import REGISTRY
    from panelsmith.plans.inputs import signals

    written, settle = [], ordering.settle
    monkeypatch.setattr(ordering, "settle", lambda df, label, *a: written.append(settle(df, label, *a)) or written[-1])
    assert REGISTRY["signal_daily_ic_sliced"].build(spark, FOLDER).count() == 12_386
    rows = [t.count() for t in written if "_x" in t.columns]
    assert len(rows) >= 3 and sum(rows) < 0.2 * signals(spark, FOLDER).rows
