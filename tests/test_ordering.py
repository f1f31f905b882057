"""The sliced way must give what a plain window gives, whatever the skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelsmith.operators import crosssection as xs
from panelsmith.operators.ordering import (
    attach_group_stats,
    average_ranks,
    bucket_from,
    group_quantiles,
    positions,
    slice_in_order,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and a third of its rows hold one value; some are NULL."""
    rng = np.random.default_rng(3)
    rows = []
    for g, size in (("hot", 6000), ("mild", 300), ("single", 1)):
        for i in range(size):
            draw = rng.random()
            x = None if draw < 0.05 else 0.0 if draw < 0.4 else float(np.round(rng.standard_normal(), 2))
            rows.append((g, i, x))
    return spark.createDataFrame(rows, "g string, asset long, x double").cache()


def as_pandas(df, keys=("g", "asset")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def test_positions(skewed):
    plain = as_pandas(positions(skewed, ["g"], "x", "asset", group_rows=6000))
    sliced = as_pandas(positions(skewed, ["g"], "x", "asset", slices=16))
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])


def test_no_slice_holds_a_large_part_of_a_hot_group(skewed):
    sizes = slice_in_order(skewed, ["g"], "x", "asset", 16).groupBy("g", "_major", "_minor").count()
    assert sizes.filter("g = 'hot'").agg(F.max("count")).first()[0] < 6000 * 0.2


def test_average_ranks(skewed):
    plain = as_pandas(average_ranks(skewed, ["g"], {"x": "rank", "asset": "other"}, group_rows=6000))
    sliced = as_pandas(average_ranks(skewed, ["g"], {"x": "rank", "asset": "other"}, slices=16))
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])
    for column, rank in (("x", "rank"), ("asset", "other")):
        assert np.allclose(plain[rank], plain.groupby("g")[column].rank(), equal_nan=True)


def test_quantiles(skewed):
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0}
    plain = as_pandas(group_quantiles(skewed, ["g"], "x", probs, "asset", group_rows=6000), ["g"])
    sliced = as_pandas(group_quantiles(skewed, ["g"], "x", probs, "asset", slices=16), ["g"])
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])
    want = skewed.toPandas().groupby("g")["x"].quantile(0.95)
    assert np.allclose(plain.set_index("g")["hi"], want.loc[plain["g"]], equal_nan=True)


def test_group_stats(skewed):
    stats = {"mean": F.avg("x"), "top": F.max("x")}
    plain = as_pandas(attach_group_stats(skewed, ["g"], stats, group_rows=6000))
    joined = as_pandas(attach_group_stats(skewed, ["g"], stats))
    pd.testing.assert_frame_equal(plain, joined[plain.columns])


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), ("a", 3, 5.0)], "g string, asset long, x double")
    plain = as_pandas(attach_group_stats(df, ["g"], {"m": F.avg("x")}, group_rows=2), ["asset"])
    joined = as_pandas(attach_group_stats(df, ["g"], {"m": F.avg("x")}), ["asset"])
    assert plain["m"].tolist() == joined["m"].tolist() == [2.0, 2.0, 5.0]


@pytest.mark.parametrize("n", [1, 3, 5, 7, 12])
def test_bucket_is_ntile(spark, n):
    df = spark.range(n).withColumn("g", F.lit(0))
    order = Window.partitionBy("g").orderBy("id")
    both = df.select(
        F.ntile(5).over(order).alias("want"),
        bucket_from(F.row_number().over(order).cast("long"), F.lit(n).cast("long"), 5).alias("got"),
    ).collect()
    assert [r.want for r in both] == [r.got for r in both]


@pytest.mark.parametrize(
    "apply",
    [
        lambda df, rows: xs.percent_rank(df, "x", "out", ["g"], rows),
        lambda df, rows: xs.zscore(df, "x", "out", ["g"], rows),
        lambda df, rows: xs.demean(df, "x", "out", ["g"], rows),
        lambda df, rows: xs.scale_to_gross(df, "x", "out", ["g"], group_rows=rows),
        lambda df, rows: xs.winsorise(df, "x", "out", by=["g"], group_rows=rows),
        lambda df, rows: xs.bucket(df, "x", "out", 5, ["g"], rows),
    ],
)
def test_sections_do_not_depend_on_the_known_size(skewed, apply):
    known, unknown = as_pandas(apply(skewed, 6000)), as_pandas(apply(skewed, None))
    assert len(known) == len(unknown)
    assert np.allclose(known["out"].astype(float), unknown["out"].astype(float), equal_nan=True)


def test_a_measured_size_decides(skewed, monkeypatch):
    """A small group of unknown size takes the plain window and writes nothing; slices are cut only where asked for."""
    from panelsmith.operators import ordering

    def refuse(*_):
        raise AssertionError("written")

    monkeypatch.setattr(ordering, "settle", refuse)
    assert ordering.positions(skewed, ["g"], "x", "asset").count() == skewed.count()
    assert ordering.average_ranks(skewed, ["g"], {"x": "rank"}).count() == skewed.count()
    with pytest.raises(AssertionError, match="written"):
        ordering.positions(skewed, ["g"], "x", "asset", slices=4)
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 10)
    with pytest.raises(AssertionError, match="written"):
        ordering.positions(skewed, ["g"], "x", "asset")


@pytest.mark.parametrize("n,width", [(0, 1), (1, 1), (7, 3), (9, 3), (10, 3), (100, 10), (101, 10)])
def test_cuts_are_looked_up_in_two_steps(spark, n, width):
    from panelsmith.operators import ordering

    cuts = [float(2 * i) for i in range(n)]
    values = [None] + [float(v) for v in range(-2, 2 * n + 3)]
    df = spark.createDataFrame([(cuts, v) for v in values], "cuts array<double>, x double").withColumn("c", ordering.chunked(F.col("cuts"), width))
    got = df.select("x", ordering.cuts_below("c", F.col("x"), width).alias("below"), ordering._is_cut("c", F.col("x")).alias("cut")).collect()
    for r in got:
        if r.x is not None:
            assert (r.below, r.cut) == (sum(c < r.x for c in cuts), r.x in cuts)
        else:
            assert not r.cut


def test_ranks_by_piece_place_rows_once_a_column(spark, monkeypatch):
    """No row is moved for a sketch of its group or to learn its slice's size; no task holds much of a busy value."""
    from panelsmith.operators import ordering

    rng = np.random.default_rng(11)
    rows = [(None if g == 2 else g, i, [None, float("nan"), 1e300, -0.0, 0.0, 1e-300][i % 40] if i % 40 < 6 else 7.0 if rng.random() < 0.6 else float(rng.normal()))
            for g, size in enumerate((5000, 400, 30)) for i in range(size)]
    df = spark.createDataFrame(rows, "g int, asset long, x double")
    written, settle = [], ordering.settle
    monkeypatch.setattr(ordering, "settle", lambda df, label, *a: written.append((label, settle(df, label, *a))) or written[-1][1])
    sliced = average_ranks(df, ["g"], {"x": "rank", "asset": "other"}, slices=16)
    plain = average_ranks(df, ["g"], {"x": "rank", "asset": "other"}, group_rows=5000)
    key = lambda d: sorted(((str(r.g), r.asset, str(r.x), r.rank, r.other) for r in d.collect()), key=str)
    assert key(sliced) == key(plain)
    places = [t for label, t in written if label == "ranks" and "_place" in t.columns]
    assert len(places) == 2 and not any("slice" in label for label, _ in written)
    pieces = places[0].filter("x = 7.0").groupBy("_piece_0").count().toPandas()["count"]
    assert len(pieces) > 3 and pieces.max() < 0.25 * len(rows)


def test_only_groups_cut_by_a_range_are_placed_by_value(spark, monkeypatch):
    """What slices write and place twice grows with the ranges, not with all rows."""
    from panelsmith.operators import ordering

    rng = np.random.default_rng(5)
    rows = [(g, i, float(np.round(rng.normal(), 1))) for g in range(60) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, asset long, x double")
    written, settle = [], ordering.settle
    monkeypatch.setattr(ordering, "settle", lambda df, label, *a: written.append(settle(df, label, *a)) or written[-1])
    sliced = as_pandas(average_ranks(df, ["g"], {"x": "rank", "asset": "other"}, slices=8))
    plain = as_pandas(average_ranks(df, ["g"], {"x": "rank", "asset": "other"}, group_rows=50))
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])
    placed = [t.count() for t in written if "_place" in t.columns]
    assert len(placed) == 2 and 0 < max(placed) <= 8 * 50


def test_groups_of_equal_hash_do_not_mix(spark):
    numbers = spark.range(300_000).select((F.col("id") * 1_000_003_000_007).alias("id"))
    hashes = numbers.groupBy(F.hash("id")).agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)
    a, b = hashes.first()["ids"][:2]
    rng = np.random.default_rng(6)
    rows = [(g, i, float(rng.normal())) for g in (a, b) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, asset long, x double")
    plain = as_pandas(average_ranks(df, ["g"], {"x": "rank"}, group_rows=200))
    sliced = as_pandas(average_ranks(df, ["g"], {"x": "rank"}, slices=4))
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])


@pytest.mark.parametrize("slices", [1, 12])
def test_parted_keeps_every_row_and_no_whole_group_above_a_range(spark, slices):
    from panelsmith.operators import ordering

    sizes = {None: 7, 1: 900, 2: 30, 3: 1, **{g: 20 for g in range(4, 40)}}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g int, asset long")
    groups, pieces = ordering.cut_groups(df, ["g"], slices)
    together, apart = [{r.g: r["count"] for r in t.groupBy("g").count().collect()} for t in ordering.parted(ordering.attach(df, groups, ["g"]))]
    assert apart | together == sizes and not apart.keys() & together.keys()
    assert pieces == slices and len(apart) <= slices and (1 in apart) == (slices > 1)
    assert max(together.values()) <= -(-sum(sizes.values()) // slices)
    assert sorted(r["_group"] for r in groups.collect()) == list(range(1, len(apart) + 1))


def test_slices_of_nothing(spark):
    df = spark.createDataFrame([], "g int, asset long, x double")
    assert average_ranks(df, ["g"], {"x": "rank"}, slices=4).collect() == []
