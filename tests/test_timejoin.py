import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.operators import timejoin
from panelsmith.operators.sessions import sessions

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    """One key holds most rows of both sides; times repeat; some keys are NULL or known to one side only."""
    rng = np.random.default_rng(11)

    def draw(n, first):
        keys = [1 if rng.random() < 0.7 else int(rng.integers(2, 8)) for _ in range(n)]
        ats = [START + dt.timedelta(minutes=int(rng.integers(0, 3000))) for _ in range(n)]
        return [(first + i, k, t, float(i)) for i, (k, t) in enumerate(zip(keys, ats))]

    left = draw(800, 0) + [(9001, None, START, 0.0), (9002, 99, START, 0.0)]
    right = draw(500, 0) + [(9003, None, START, 0.0), (9004, 98, START, 0.0)]
    schema = "id long, k long, at timestamp_ntz, v double"
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema.replace("at ", "since "))


@pytest.mark.parametrize("seconds", [None, 600, 7 * 86_400])
def test_asof_join(sides, seconds):
    left, right = sides
    right = right.select("k", "since", F.col("v").alias("rv"), F.col("id").alias("rid"))
    got = timejoin.asof_join(left, right, "k", "at", "since", "rid", ["since", "rv"], seconds).toPandas()
    assert len(got) == left.count() and list(got.columns) == ["id", "k", "at", "v", "since", "rv"]
    answers = right.toPandas().dropna(subset=["k"])
    for row in got.itertuples():
        fit = answers[(answers["k"] == row.k) & (answers["since"] <= row.at)].sort_values(["since", "rid"])
        if len(fit):
            assert (row.since, row.rv) == (fit.iloc[-1]["since"], fit.iloc[-1]["rv"])
        else:
            assert pd.isna(row.since) and pd.isna(row.rv)


def burst(spark, n=10_000):
    """All rows of one key within a minute, and one row of it a year before."""
    at = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 60.0 / n)
    far = F.lit(START - dt.timedelta(days=365)).cast("timestamp_ntz")
    return spark.range(n).select("id", F.lit(1).cast("long").alias("k"), F.when(F.col("id") == 0, far).otherwise(at).alias("at"), (F.col("id") % 7).cast("double").alias("v"))


def test_cuts_follow_a_burst(spark, monkeypatch):
    df = burst(spark)
    assert timejoin.hot_cuts(df, "k", "at") is None
    monkeypatch.setattr(timejoin, "ONE_TASK_ROWS", 1_000)
    cuts = timejoin.hot_cuts(df, "k", "at")
    binned = timejoin.with_bin(df, "k", "at", None, cuts)
    largest, least = binned.groupBy("k", "_bin").count().agg(F.max("count"), F.min("count")).first()
    assert largest <= 1_000 and least >= 100
    quiet = timejoin.with_bin(df.withColumn("k", F.lit(2).cast("long")), "k", "at", None, cuts)
    assert quiet.select("_bin").distinct().count() == 1


def test_large_keys_give_the_same_rows(spark, sides, monkeypatch):
    left, right = sides
    right = right.select("k", "since", F.col("v").alias("rv"), F.col("id").alias("rid"))
    changes = right.filter("k IS NOT NULL").select("k", F.col("since").alias("at"), "rid")
    events = left.filter("k IS NOT NULL").select(F.col("k").alias("user"), F.col("at").alias("ts"), F.col("v").alias("value"))
    lengthy = burst(spark, 500).select("k", "at", F.col("id").alias("rid"))

    def results():
        joined = timejoin.asof_join(left, right, "k", "at", "since", "rid", ["since", "rv"])
        spans = timejoin.spans_from_changes(changes, "k", "at", "rid")
        ends = spans.withColumn("valid_to", F.col("valid_from") + F.expr("interval 90 minutes"))
        frames = [joined, spans, timejoin.overlapping_spans(ends, "k", "valid_from", "valid_to"), sessions(events, 900, "user"),
                  sessions(lengthy.select(F.col("k").alias("user"), F.col("at").alias("ts"), F.lit(1.5).alias("value")), 0, "user")]
        return [sorted(map(str, f.collect())) for f in frames]

    whole = results()
    monkeypatch.setattr(timejoin, "ONE_TASK_ROWS", 40)
    assert results() == whole


def test_ties_keep_their_type_and_null_times_find_nothing(spark):
    left = spark.createDataFrame([(1, START), (1, None), (None, START)], "k long, at timestamp_ntz")
    right = spark.createDataFrame([(1, START, 1.9, "hi"), (1, START, 1.2, "lo")], "k long, since timestamp_ntz, tie double, what string")
    got = timejoin.asof_join(left, right, "k", "at", "since", "tie", ["what"]).collect()
    assert sorted((str(r.k), str(r.at), r.what) for r in got) == [("1", "2024-01-01 00:00:00", "hi"), ("1", "None", None), ("None", "2024-01-01 00:00:00", None)]
    words = right.withColumn("tie", F.col("what"))
    assert timejoin.asof_join(left.limit(1), words, "k", "at", "since", "tie", ["what"]).first().what == "lo"


@pytest.mark.parametrize("seconds", [None, 600, 86_400])
def test_spans_from_changes(sides, seconds):
    _, right = sides
    changes = right.filter("k IS NOT NULL").select("k", F.col("since").alias("at"), "id")
    got = timejoin.spans_from_changes(changes, "k", "at", "id", seconds).toPandas().sort_values(["k", "valid_from"])
    raw = changes.toPandas().sort_values(["k", "at", "id"]).drop_duplicates(["k", "at"], keep="last")
    assert got["id"].tolist() == raw["id"].tolist()
    want = raw.groupby("k")["at"].shift(-1).reset_index(drop=True)
    pd.testing.assert_series_equal(got["valid_to"].reset_index(drop=True), want, check_names=False)


def test_asof_join_refuses_columns_of_one_name(sides):
    left, right = sides
    with pytest.raises(ValueError, match="v"):
        timejoin.asof_join(left, right, "k", "at", "since", "id", ["v"])


def test_point_in_time_join(spark):
    changes = spark.createDataFrame(
        [(1, START, "a", 1), (1, START + dt.timedelta(days=2), "b", 2), (1, START + dt.timedelta(days=2), "c", 3)],
        "k long, at timestamp_ntz, grade string, change long",
    )
    spans = timejoin.spans_from_changes(changes, "k", "at", "change")
    assert sorted((r.grade, r.valid_to is None) for r in spans.collect()) == [("a", False), ("c", True)]
    closed = spans.withColumn("valid_to", F.coalesce("valid_to", F.lit(START + dt.timedelta(days=4)).cast("timestamp_ntz")))
    facts = spark.createDataFrame([(1, START + dt.timedelta(days=n)) for n in range(-1, 6)], "k long, at timestamp_ntz")
    got = timejoin.point_in_time_join(facts, closed, "k", "at", "valid_from", "valid_to", "change", ["grade"])
    assert [r.grade for r in got.orderBy("at").collect()] == [None, "a", "a", "c", "c", None, None]


@pytest.mark.parametrize("seconds", [None, 86_400, 30 * 86_400])
def test_overlapping_spans(spark, seconds):
    spans = spark.createDataFrame(
        [(1, 0, 5), (1, 5, 9), (1, 6, 7), (2, 0, None), (2, 3, 4)], "k int, a int, b int"
    ).select("k", *[F.when(F.col(c).isNotNull(), F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(days=F.col(c))).alias(c) for c in ("a", "b")])
    found = timejoin.overlapping_spans(spans, "k", "a", "b", seconds)
    assert [(r.k, (r.a - START).days) for r in found.orderBy("k").collect()] == [(1, 6), (2, 3)]


@pytest.mark.parametrize("seconds", [None, 60, 3600, 10 * 86_400])
def test_sessions(sides, seconds):
    left, _ = sides
    events = left.filter("k IS NOT NULL").select(F.col("k").alias("user"), F.col("at").alias("ts"), F.col("v").alias("value"))
    got = sessions(events, 900, "user", seconds).toPandas().sort_values(["user", "first_ts"]).reset_index(drop=True)
    raw = events.toPandas().sort_values(["user", "ts"])
    raw["run"] = (raw.groupby("user")["ts"].diff() > pd.Timedelta(seconds=900)).groupby(raw["user"]).cumsum()
    want = raw.groupby(["user", "run"]).agg(
        first_ts=("ts", "min"), last_ts=("ts", "max"), n=("ts", "size"), total=("value", "sum")
    ).reset_index().drop(columns="run")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
