import pytest
import math

from pyspark.sql import functions as F

from panelsmith.functions.numeric import correlation, exact_sum, ratio, slope, tidy, two_sided_p


def one(df):
    return df.first()[0]


def test_zero_divisor_gives_null(spark):
    assert one(spark.range(1).select(ratio(F.lit(1.0), F.lit(0.0)))) is None


def test_correlation_with_a_constant_side_is_null(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 4.0)], "a double, b double")
    assert one(df.agg(correlation("a", "b"))) is None
    assert one(df.agg(slope("b", "a"))) is None
    assert one(df.agg(slope("a", "b"))) == 0.0


def test_correlation_uses_complete_pairs_only(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0), (None, 90.0), (70.0, None)], "a double, b double")
    complete = df.dropna()
    assert math.isclose(one(df.agg(correlation("a", "b"))), one(complete.agg(F.corr("a", "b"))), rel_tol=1e-12)


def test_tidy_has_no_negative_zero(spark):
    assert math.copysign(1.0, one(spark.range(1).select(tidy(F.lit(-1e-12))))) == 1.0


def test_exact_sum_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") / 100.0 + 0.01).alias("x"))
    sums = {one(df.repartition(n).agg(exact_sum("x"))) for n in (1, 3, 16)}
    assert sums == {sum(i + 1 for i in range(1000)) / 100}


def test_two_sided_p(spark):
    for t in (0.0, 0.5, 1.96, 4.0):
        got = one(spark.range(1).select(two_sided_p(F.lit(-t))))
        assert abs(got - math.erfc(t / math.sqrt(2))) < 2e-7


def test_more_places_than_declared_are_an_error(spark):
    df = spark.createDataFrame([(0.004,), (0.004,), (0.004,), (0.125,), (None,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="more than 2 decimal places: 0.0"):
        df.agg(exact_sum("x")).collect()
    assert df.agg(exact_sum("x", 3)).first()[0] == 0.137
    large = spark.createDataFrame([(123456789012.29,), (0.01,)], "x double")
    assert large.agg(exact_sum("x")).first()[0] == 123456789012.3


@pytest.mark.parametrize("amount", [6000000000000.004, -6000000000000.004, 2e13 + 0.0040, 3e13 + 0.00390625, 90071992547.127])
def test_more_places_of_a_large_amount_are_an_error(spark, amount):
    df = spark.createDataFrame([(amount,)], "x double")
    with pytest.raises(Exception, match="more than 2 decimal places"):
        df.agg(exact_sum("x")).collect()


def test_large_amounts_of_two_places_are_exact(spark):
    from decimal import Decimal

    import numpy as np

    rng = np.random.default_rng(4)
    whole = [int(v) for top in (10**12, 10**14, 10**15, 2 * 10**15) for v in rng.integers(-top, top, 200)]
    df = spark.createDataFrame([(w / 100,) for w in whole], "x double").repartition(5)
    assert df.agg(exact_sum("x")).first()[0] == float(Decimal(sum(whole)) / 100)
    assert spark.createDataFrame([(5e13,), (4e15,)], "x double").agg(exact_sum("x")).first()[0] == 4.05e15


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (float("nan"), 9.0), (4.0, float("nan"))], "a double, b double")
    clean = df.filter("NOT isnan(a) AND NOT isnan(b)")
    assert df.select(correlation("a", "b")).first() == clean.select(correlation("a", "b")).first()
    assert df.select(slope("a", "b")).first() == clean.select(slope("a", "b")).first()
