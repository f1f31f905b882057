"""Stationary bootstrap and step-down tests against plain Python, and what they are for."""

import hashlib
import math

import numpy as np
import pytest

from panelsmith.operators import inference
from tests.conftest import day

SERIES = "signal string, d date, x double"


def walk(n, replica, mean_block, seed=""):
    """The days that a replica draws, step by step."""
    out, at = [], None
    for i in range(n):
        h = hashlib.md5(f"{seed}{replica}:{i}".encode()).hexdigest()
        u, v = int(h[:8], 16) / 2**32, int(h[8:16], 16) / 2**32
        at = int(math.floor(v * n)) if i == 0 or u < 1 / mean_block else (at + 1) % n
        out.append(at)
    return out


def series(n=120, signals=6, seed=3):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=n)
    out = {}
    for s in range(signals):
        x = 0.6 * common + rng.normal(size=n) + [0.0, 0.1, 0.35, 0.0, -0.4, 0.02][s % 6]
        out[f"s{s}"] = [None if (i * 7 + s) % 23 == 0 else float(v) for i, v in enumerate(x)]
    return out


def frame(spark, values):
    return spark.createDataFrame([(s, day(i), x) for s, xs in values.items() for i, x in enumerate(xs)], SERIES)


def brute_means(values, replicas, mean_block):
    n = len(next(iter(values.values())))
    draws = {k: walk(n, k, mean_block) for k in range(1, replicas + 1)}
    return {s: [np.mean([xs[i] for i in draws[k] if xs[i] is not None]) for k in range(1, replicas + 1)] for s, xs in values.items()}


def test_draws_against_a_walk(spark):
    days = spark.createDataFrame([(day(i),) for i in range(50)] + [(None,), (day(3),)], "d date")
    got = {(r.replica, r.d): r.times for r in inference.stationary_draws(days, 7, 4.0, "s").collect()}
    want = {(0, day(i)): 1 for i in range(50)}
    for k in range(1, 8):
        for i in walk(50, k, 4.0, "s"):
            want[k, day(i)] = want.get((k, day(i)), 0) + 1
    assert got == want


def test_bootstrap_against_plain_python(spark):
    values = series()
    got = {r.signal: r for r in inference.stationary_bootstrap(frame(spark, values), "x", ["signal"], 60, 8.0).collect()}
    for s, means in brute_means(values, 60, 8.0).items():
        r = got[s]
        assert r.replicas == 60
        assert r.mean == pytest.approx(np.mean([v for v in values[s] if v is not None]), abs=1e-6)
        assert r.std_error == pytest.approx(np.std(means, ddof=1), abs=1e-6)
        assert (r.low, r.high) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)), abs=1e-6)


def test_intervals_widen_where_neighbours_are_alike(spark):
    rng = np.random.default_rng(1)
    x = [0.0]
    for e in rng.normal(size=799):
        x.append(0.9 * x[-1] + e)
    noise = [float(v) for v in rng.normal(size=800) * np.std(x)]
    df = frame(spark, {"alike": [float(v) for v in x], "noise": noise})
    width = lambda rows: {r.signal: r.high - r.low for r in rows}
    plain = width(inference.bootstrap_mean(df, "x", "d", ["signal"]).collect())
    blocks = width(inference.stationary_bootstrap(df, "x", ["signal"], 200, 40.0).collect())
    assert blocks["alike"] > 2 * plain["alike"]
    assert 0.6 < blocks["noise"] / plain["noise"] < 1.5


def test_step_down_against_brute_force(spark):
    values, replicas = series(), 99
    got = {r.signal: r for r in inference.step_down(frame(spark, values), "x", "signal", replicas, 8.0).collect()}
    means = brute_means(values, replicas, 8.0)
    mean = {s: np.mean([v for v in xs if v is not None]) for s, xs in values.items()}
    error = {s: np.std(m, ddof=1) for s, m in means.items()}
    order = sorted(values, key=lambda s: -abs(mean[s] / error[s]))
    least = 0.0
    for j, s in enumerate(order):
        t = abs(mean[s] / error[s])
        reached = sum(max(abs(means[o][k] - mean[o]) / error[o] for o in order[j:]) >= t for k in range(replicas))
        least = max(least, (reached + 1) / (replicas + 1))
        assert got[s].p_adjusted == pytest.approx(least, abs=1e-6)
        assert got[s].kept == (least <= 0.05)
        assert got[s].t_value == pytest.approx(mean[s] / error[s], abs=1e-4)
    assert any(r.kept for r in got.values()) and not all(r.kept for r in got.values())


def test_step_down_is_no_stricter_than_it_must_be_for_equal_series(spark):
    """A hundred copies of one series are one test; the usual bound would multiply its p value by a hundred."""
    x = series(signals=3)["s2"]
    one = inference.step_down(frame(spark, {"a": x}), "x", "signal", 99, 8.0).first().p_adjusted
    many = inference.step_down(frame(spark, {f"c{i:03d}": x for i in range(100)}), "x", "signal", 99, 8.0)
    assert {r.p_adjusted for r in many.collect()} == {one}


def test_series_without_days_or_spread(spark):
    none = spark.createDataFrame([], SERIES)
    assert inference.stationary_bootstrap(none, "x", ["signal"], 5).count() == 0
    assert inference.step_down(none, "x", "signal", 5).count() == 0
    flat = frame(spark, {"flat": [1.0] * 9, "nan": [float("nan"), None] + [1.0, 2.0, 3.0, 2.0, 1.0, 4.0, 2.0]})
    assert [r.signal for r in inference.step_down(flat, "x", "signal", 30, 3.0).collect()] == ["nan"]
    got = {r.signal: r for r in inference.stationary_bootstrap(flat, "x", ["signal"], 30, 3.0).collect()}
    assert got["flat"].low == got["flat"].high == 1.0 and got["nan"].mean == pytest.approx(15 / 7, abs=1e-6)
