"""Moments of all pairs of columns in one scan, and books kept wide, against plain ways."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsmith.operators import gram, inference, portfolio
from panelsmith.operators.evaluation import long_form
from panelsmith.storage import settle
from tests.conftest import day


def frame(spark, x):
    names = [f"s{i}" for i in range(x.shape[1])]
    rows = [tuple(None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(row)) for row in x]  # NULLs and NaNs
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4), names


def awkward(rows=400, columns=150):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 7.25  # constant
    x[:, 4] = np.nan  # empty
    x[:, 5] = 1e6 + x[:, 6] * 1e-3  # large mean, small deviations
    x[: rows // 2, 7] = np.nan
    x[rows // 2:, 8] = np.nan  # never together with the one before
    return x


def test_pairs_against_plain_correlations(spark):
    x = awkward()
    df, names = frame(spark, x)
    got = {(r.a, r.b): r for r in gram.pair_moments(df, names).collect()}
    assert len(got) == 150 * 149 // 2
    plain = pd.DataFrame(x)
    want, count = plain.corr().to_numpy(), (~plain.isna()).astype(int)
    count = count.T.to_numpy() @ count.to_numpy()
    for (a, b), r in got.items():
        assert r.n == count[a, b]
        if 3 in (a, b) or 4 in (a, b) or (a, b) == (7, 8):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(want[a, b], abs=1e-6 if 5 in (a, b) else 1e-10)
    both = plain[[10, 11]].dropna()
    r = got[10, 11]
    assert (r.mean_a, r.mean_b) == pytest.approx((both[10].mean(), both[11].mean()))
    assert r.product == pytest.approx(((both[10] - both[10].mean()) * (both[11] - both[11].mean())).sum())


def test_bands_and_partitions_change_nothing(spark, monkeypatch):
    df, names = frame(spark, awkward(200, 140))
    rows = lambda found: [(r.a, r.b, r.n, r.correlation is None, pytest.approx(r.correlation or 0.0, abs=1e-7)) for r in sorted(found.collect(), key=lambda r: (r.a, r.b))]
    whole = rows(gram.pair_moments(df, names))
    monkeypatch.setattr(gram, "STATE_CELLS", 140 * gram.SIDE)  # three scans
    got = [(r.a, r.b, r.n, r.correlation is None, r.correlation or 0.0) for r in sorted(gram.pair_moments(df.repartition(1), names).collect(), key=lambda r: (r.a, r.b))]
    assert got == whole


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31), st.integers(0, 30), st.integers(0, 30))
def test_parts_merge_to_the_whole(seed, first, second):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(first + second, 3)) * 10 + rng.integers(-10**6, 10**6, 3)
    x[rng.random(x.shape) < 0.3] = np.nan
    whole = gram.Moments.of(x, x).parts
    parts = gram.Moments.of(x[:first], x[:first]).merged(gram.Moments.of(x[first:], x[first:])).parts
    some = whole[0] > 0
    for w, p in zip(whole, parts):
        assert np.allclose(w[some], p[some], rtol=1e-9, atol=1e-6)


@pytest.fixture
def many(spark):
    names = [f"s{i}" for i in range(500)]
    made = spark.range(0, 3000, 1, 6).select(*[((F.col("id") * (i + 3) * 7919) % (997 + i)).cast("double").alias(n) for i, n in enumerate(names)])
    return settle(made, "many-signals"), names


def test_five_hundred_signals_take_one_scan(many):
    df, names = many
    found = inference.signal_correlations(df, names)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.signal_a, r.signal_b): r.correlation for r in found.collect()}
    want = np.corrcoef(df.toPandas().to_numpy().T)
    assert len(got) == 500 * 499 // 2
    for a, b in [(0, 1), (0, 499), (63, 64), (64, 128), (250, 251), (498, 499)]:
        assert got[f"s{a}", f"s{b}"] == pytest.approx(want[a, b], abs=1e-6)


def test_tables_without_rows(spark):
    df, names = frame(spark, np.zeros((1, 20)))
    assert gram.pair_moments(df.limit(0), names).count() == 0
    assert {r.correlation for r in gram.pair_moments(df, names).collect()} == {None}


def test_wide_books_trade_like_long_ones(spark):
    rng = np.random.default_rng(9)
    rows = []
    for asset in range(12):
        for n in range(40):
            if rng.random() < 0.15 or (asset == 3 and n > 20) or n == 17:
                continue  # gaps, an asset that ends, a day without rows
            rows.append((asset, day(n), *[None if rng.random() < 0.2 or (s == 1 and n in (5, 6)) else float(rng.normal()) for s in range(3)]))
    rows.append((99, day(50), 1.0, None, None))  # a day on which a book holds one asset
    wide = spark.createDataFrame(rows, "asset long, d date, a double, b double, c double")
    books = ["a", "b", "c"]
    want = portfolio.turnover(portfolio.weights(long_form(wide, books, ["asset", "d"]), group_rows=100)).toPandas()
    for group_rows in (None, 100):
        got = portfolio.turnover_of_books(wide, books, group_rows=group_rows).toPandas()
        both = want.merge(got, on=["signal", "d"], how="outer")
        assert len(both) == len(want) == len(got)
        assert np.allclose(both["turnover_x"], both["turnover_y"], atol=1e-12) and np.allclose(both["cost_x"], both["cost_y"], atol=1e-12)
