"""Books from wide rows, days attached without moving rows, and tasks by the rows that they hold."""

import pytest
from pyspark.sql import functions as F

from panelsmith.operators import portfolio
from panelsmith.operators.evaluation import long_form
from panelsmith.operators.ordering import PLACED_ROWS, place
from panelsmith.plans import REGISTRY
from panelsmith.plans.inputs import long_signals
from panelsmith.plans.testing import GRID, on_grid
from tests.conftest import day

FOLDER = "/root/testdata/sf0.01"


def test_half_a_weight_goes_to_one_point_of_the_grid_whatever_noise_it_has(spark):
    noisy = [0.5, 0.5 - 2**-54, 0.5 + 2**-53, -0.5, -0.5 + 2**-54, 0.25, None, 0.0]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(noisy)], "i int, w double")
    got = [None if r.w is None else round(r.w * GRID) for r in df.select("i", on_grid(F.col("w")).alias("w")).orderBy("i").collect()]
    assert got == [499_992, 499_992, 499_992, -499_992, -499_992, 249_996, None, 0]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [
        (1, day(0), 1.0, None, 0.1), (2, day(0), 3.0, None, 0.2), (3, day(0), 7.0, 5.0, None),
        (1, day(1), 2.0, 1.0, None), (2, day(1), None, 4.0, -0.5), (3, day(1), 2.0, 4.0, 0.25), (4, day(1), 2.0, 9.0, 0.0),
        (1, day(2), 1.0, 2.0, None), (2, day(2), 5.0, 3.0, None),
    ]
    return spark.createDataFrame(rows, "asset long, d date, a double, b double, fwd_1 double")


def test_wide_weights_and_returns_are_those_of_long_books(wide):
    held = portfolio.weights(long_form(wide, ["a", "b"], ["asset", "d", "fwd_1"]))
    want = {(r.signal, r.asset, r.d): r.w for r in held.collect()}
    got = {(r.signal, r.asset, r.d): r.w for r in portfolio.weights_of_books(wide, ["a", "b"], ["asset", "d"]).collect()}
    assert got.keys() == want.keys() and None in got.values()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    earned = {(r.signal, r.d): r.r for r in portfolio.daily_returns(held).collect()}
    assert {(r.signal, r.d): r.r for r in portfolio.returns_of_books(wide, ["a", "b"]).collect()} == pytest.approx(earned)


def _plan(df, capsys):
    capsys.readouterr()
    df.explain("simple")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["book_weights", "section_demeaned", "section_zscore", "section_scaled"])
def test_rows_stay_where_they_are_when_a_day_is_attached(spark, capsys, name):
    assert "Exchange hashpartitioning" not in _plan(REGISTRY[name].build(spark, FOLDER), capsys)


def test_tasks_follow_the_rows_that_they_will_hold(spark):
    few = spark.range(10).withColumn("d", F.col("id") % 5)
    assert place(few, ["d"], 10 * PLACED_ROWS + 1).rdd.getNumPartitions() == 11
    one, rows = long_signals(spark, FOLDER)
    assert one.rdd.getNumPartitions() < long_signals(spark, FOLDER, copies=20)[0].rdd.getNumPartitions()
