"""Keys of decay, overlapping series, many signals, long top lists and slices of measured size."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsmith.operators import crosssection as xs
from panelsmith.operators import evaluation as ev
from panelsmith.operators import inference, ordering, quality

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(3)
    rows = [
        (s, a % 2, a, DAY + dt.timedelta(days=int(d)), float(rng.normal()), float(rng.normal()), float(rng.normal()))
        for s in ("one", "two") for a in range(14) for d in range(25)
    ]
    return spark.createDataFrame(rows, "signal string, grp int, asset int, d date, x double, fwd_1 double, fwd_5 double").cache()


def test_decay_by_other_keys(long):
    whole = ev.ic_decay(long, [1, 5]).collect()
    assert {(r.signal, r.horizon) for r in whole} == {(s, h) for s in ("one", "two") for h in (1, 5)}
    by_group = ev.ic_decay(long, [1, 5], by=["signal", "grp", "d"]).collect()
    assert len(by_group) == 8
    apart = {(r.signal, r.grp, r.horizon): r.mean_ic for r in by_group}
    for g in (0, 1):
        for r in ev.ic_decay(long.filter(F.col("grp") == g), [1, 5]).collect():
            assert apart[r.signal, g, r.horizon] == r.mean_ic
    assert {r.horizon for r in ev.ic_decay(long.filter("signal = 'one'"), [1, 5], by=["d"]).collect()} == {1, 5}


def test_one_nan_leaves_the_summary_standing(long):
    spoilt = long.withColumn("x", F.when((F.col("asset") == 3) & (F.col("d") == F.lit(DAY)), float("nan")).otherwise(F.col("x")))
    got = {r.signal: r for r in ev.ic_summary(ev.daily_ic(spoilt), "ic").collect()}
    clean = {r.signal: r for r in ev.ic_summary(ev.daily_ic(spoilt.filter("NOT isnan(x)")), "ic").collect()}
    assert got == clean and all(np.isfinite(r.t_value) for r in got.values())
    assert next(r.nans for r in quality.column_report(spoilt).collect() if r["column"] == "x") == 2


def test_overlapping_series_get_wider_errors(spark):
    rng = np.random.default_rng(8)
    h, n = 5, 400
    noise = rng.normal(size=n + h)
    series = np.array([noise[i:i + h].mean() for i in range(n)]) + 0.05
    frame = spark.createDataFrame([("s", h, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(series)], "signal string, horizon int, d date, rank_ic double")
    got = ev.ic_summary(frame, by=["signal", "horizon"], span="horizon", longest=9).first().t_overlap
    e = series - series.mean()
    spread = e @ e + 2 * sum((1 - k / h) * (e[k:] @ e[:-k]) for k in range(1, h))
    assert got == pytest.approx(series.mean() / (np.sqrt(spread) / n), abs=1e-5)
    plain = series.mean() / series.std(ddof=1) * np.sqrt(n)
    assert abs(got) < 0.7 * abs(plain)


def test_sixty_signals_in_chunks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 60)).round(3)
    names = [f"s{i}" for i in range(60)]
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{n} double" for n in names))
    got = {(r.signal_a, r.signal_b): r.correlation for r in inference.signal_correlations(frame, names).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 60 * 59 // 2
    assert all(got[names[i], names[j]] == pytest.approx(want[i, j], abs=1e-6) for i in range(60) for j in range(i + 1, 60))


@pytest.mark.parametrize("rows", [None, 5_000])
def test_long_top_list(spark, rows):
    frame = spark.range(5_000).select(F.lit(DAY).alias("d"), F.col("id").alias("asset"), ((F.col("id") * 37) % 1000).cast("double").alias("x"))
    got = xs.top_and_bottom(frame, "x", 1_500, group_rows=rows).collect()
    every = [(float(i * 37 % 1000), i) for i in range(5_000)]
    top = [i for _, i in sorted(every, key=lambda t: (-t[0], t[1]))[:1_500]]
    bottom = [i for _, i in sorted(every)[:1_500]]
    for side, want in (("top", top), ("bottom", bottom)):
        assert [r.asset for r in sorted((r for r in got if r.side == side), key=lambda r: r.place)] == want


def test_slices_follow_the_largest_group(spark, monkeypatch):
    frame = spark.range(9_000).select(F.lit(1).alias("d"), F.col("id").alias("asset"), F.rand(3).alias("x"))
    assert ordering.slice_count(frame, ["d"], None) == ordering.SLICES
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 200)
    slices = ordering.slice_count(frame, ["d"], None)
    assert slices == 180
    marked = ordering.slice_in_order(frame, ["d"], "x", "asset", slices)
    assert marked.groupBy("_major", "_minor").count().agg(F.max("count")).first()[0] <= 200


def test_residual_of_days_without_a_solution(spark):
    rng = np.random.default_rng(2)
    rows = []
    for day in range(4):
        for asset in range(8):
            a, b = rng.normal(size=2)
            rows.append((day, asset, float(1 + 2 * a - b), float(a), float(a if day == 1 else (1.0 if day == 2 else b))))
    rows += [(5, 0, 1.0, 2.0, 3.0), (6, 0, None, None, None)]
    frame = spark.createDataFrame(rows, "d int, asset int, y double, a double, b double")
    got = {(r.d, r.asset): r.res for r in xs.regression_residual(frame, "y", ["a", "b"], "res").collect()}
    assert all(got[d, a] == pytest.approx(0, abs=1e-9) for d in (0, 3) for a in range(8))
    assert all(got[d, a] is None for d in (1, 2) for a in range(8)) and got[5, 0] is None and got[6, 0] is None
