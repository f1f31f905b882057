"""Panels refreshed by the day, windows published early, and the as-of join of streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelsmith import incremental
from panelsmith.sources.tables import load_stream, schema_of
from panelsmith.storage import listed, new_path
from panelsmith.streaming import bars as live
from panelsmith.streaming import versions
from panelsmith.streaming.asof import asof_join_streams
from panelsmith.streaming.jobs import run_to_table, state_session
from tests.conftest import day

ROWS = "asset long, d date, x double"
START = dt.datetime(2024, 1, 1)


def rows_of(days, bump=()):
    return [(a, day(n), float(10 * n + a + (100 if (a, n) in bump else 0))) for n in days for a in range(3)]


def three_day_mean(source):
    from pyspark.sql import Window

    window = Window.partitionBy("asset").orderBy(F.unix_date("d")).rangeBetween(-2, 0)
    return source.select("asset", "d", F.avg("x").over(window).alias("m"))


def content(df):
    return sorted(map(tuple, df.select("asset", "d", "m").collect()))


@pytest.fixture
def panel(spark):
    path = new_path(spark, "test-panel")

    def update(rows, **how):
        source = spark.createDataFrame(rows, ROWS)
        done = incremental.refresh(source, three_day_mean, path, lookback=2, **how)
        if rows:
            assert content(incremental.read(spark, path)) == content(three_day_mean(source))
        return done

    update.path = path
    return update


def files(spark, path):
    return {name: listed(spark, f"{path}/rows/{name}") for name in listed(spark, f"{path}/rows") if name.startswith("bucket=")}


def test_a_new_day_rewrites_only_its_partition(spark, panel):
    first = panel(rows_of(range(10)))
    assert first.first and first.changed == [day(n) for n in range(10)]
    before = files(spark, panel.path)
    done = panel(rows_of(range(11)))
    assert done.changed == [day(10)] and done.rebuilt == [day(10)]
    after = files(spark, panel.path)
    assert {k: v for k, v in after.items() if k in before} == before and len(after) == 11


def test_a_changed_day_reaches_those_that_look_back_on_it(spark, panel):
    panel(rows_of(range(10)))
    before = files(spark, panel.path)
    done = panel(rows_of(range(10), bump={(1, 4)}))
    assert done.changed == [day(4)] and done.rebuilt == [day(4), day(5), day(6)]
    after = files(spark, panel.path)
    assert {k for k in after if after[k] != before[k]} == {f"bucket={day(n)}" for n in (4, 5, 6)}


def test_days_that_vanish_and_repeat(spark, panel):
    panel(rows_of(range(8)))
    done = panel(rows_of([n for n in range(8) if n != 3]))
    assert done.changed == [day(3)] and f"bucket={day(3)}" not in files(spark, panel.path)
    again = panel(rows_of([n for n in range(8) if n != 3]))
    assert again.changed == [] and again.rebuilt == []
    twice = rows_of([0, 1, 2, 4, 5, 6, 7]) + [(0, day(7), 70.0)]  # a repeated row is a change
    assert panel(twice).changed == [day(7)]


def test_partitions_of_a_month(spark):
    path = new_path(spark, "test-months")
    source = lambda days: spark.createDataFrame(rows_of(days), ROWS)
    incremental.refresh(source(range(70)), three_day_mean, path, lookback=2, unit="month")
    before = files(spark, path)
    assert set(before) == {"bucket=2024-01-01", "bucket=2024-02-01", "bucket=2024-03-01"}
    done = incremental.refresh(source(n for n in range(70) if n != 59), three_day_mean, path, lookback=2, unit="month")  # the last of February
    assert done.changed == [day(59)] and done.rebuilt == incremental.whole_units([day(58), day(60)], "month")
    after = files(spark, path)
    assert {k for k in after if after[k] != before[k]} == {"bucket=2024-02-01", "bucket=2024-03-01"}
    assert content(incremental.read(spark, path)) == content(three_day_mean(source(n for n in range(70) if n != 59)))


def test_rows_that_swap_values_are_a_change(spark, panel):
    panel([(1, day(0), 5.0), (2, day(0), 7.0)])
    assert panel([(1, day(0), 7.0), (2, day(0), 5.0)]).changed == [day(0)]


def test_another_salt_rebuilds_everything(spark, panel):
    panel(rows_of(range(4)), salt="a")
    assert panel(rows_of(range(4)), salt="b").changed == [day(n) for n in range(4)]


def test_a_refresh_that_breaks_off_is_repeated(spark, panel, monkeypatch):
    panel(rows_of(range(6)))
    real = incremental._replace

    def broken(*args):
        real(*args)
        raise RuntimeError("lost after writing the rows")

    monkeypatch.setattr(incremental, "_replace", broken)
    with pytest.raises(RuntimeError):
        panel(rows_of(range(7)))
    monkeypatch.setattr(incremental, "_replace", real)
    assert panel(rows_of(range(7))).changed == [day(6)]


def test_an_empty_source_and_rows_without_a_day(spark, panel):
    assert panel([]).changed == []
    assert incremental.read(spark, panel.path, "asset long, m double, d date").count() == 0
    source = spark.createDataFrame(rows_of([0]) + [(1, None, 1.0)], ROWS)
    assert incremental.refresh(source, three_day_mean, panel.path, lookback=2).changed == [day(0)]
    assert incremental.read(spark, panel.path).count() == 3


def test_many_runs_of_days_become_few_ranges(spark):
    days = [day(3 * n) for n in range(200)]
    condition = incremental.within(F.col("d"), days)
    every = spark.createDataFrame([(day(n),) for n in range(-5, 610)], "d date")
    kept = {r.d for r in every.filter(condition).collect()}
    assert set(days) <= kept and min(kept) == day(0) and max(kept) == days[-1]
    assert incremental.runs([day(0), day(1), day(3)]) == [(day(0), day(1)), (day(3), day(3))]


# Streams -----------------------------------------------------------------


def event(i, minutes, user=1, kind="view", value=1.0):
    return (i, START + dt.timedelta(minutes=minutes), user, kind, value, "{}")


@pytest.fixture
def feed(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, schema_of("events")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))

    add.folder = str(tmp_path)
    return add


def events_of(session, feed, late_by="1 hour"):
    return live.with_event_time(load_stream(session, feed.folder, "events", files_per_trigger=1), late_by)


def hours(spark, feed):
    return live.bars(events_of(spark, feed), "1 hour", "user_id")


def test_bars_come_early_and_are_corrected(spark, feed, tmp_path):
    where = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "progress")}
    keys = ["bar_start", "user_id"]
    feed([event(1, 10, value=2.0)])
    first = versions.run_early(hours(spark, feed), keys, "e1", **where).collect()
    assert [(r.bar_start, r.n, r.version) for r in first] == [(START, 1, 0)]
    feed([event(2, 20, value=3.0), event(3, 70)])
    second = versions.run_early(hours(spark, feed), keys, "e2", **where).orderBy("bar_start").collect()
    assert [(r.n, r.total) for r in second] == [(2, 5.0), (1, 1.0)]
    assert second[0].version > first[0].version


def test_a_restart_in_mid_batch_doubles_nothing(spark, feed, tmp_path, monkeypatch):
    where = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "progress")}
    keys = ["bar_start", "user_id"]
    feed([event(1, 10)])
    versions.run_early(hours(spark, feed), keys, "r1", **where)
    feed([event(2, 20), event(3, 100)])
    real = versions.publish

    def broken(*args):
        real(*args)
        raise RuntimeError("lost before the batch was committed")

    monkeypatch.setattr(versions, "publish", broken)
    with pytest.raises(Exception, match="lost before"):
        versions.run_early(hours(spark, feed), keys, "r2", **where)
    monkeypatch.setattr(versions, "publish", real)
    got = versions.run_early(hours(spark, feed), keys, "r3", **where)
    assert sorted(r.n for r in got.collect()) == [1, 2]
    assert got.groupBy(*keys).count().filter("count > 1").isEmpty()


def test_compaction_keeps_what_is_current(spark, tmp_path):
    path, keys, want = str(tmp_path / "published"), ["k"], {}
    for number in range(9):
        rows = [(k, number * 10 + k) for k in range(number % 4, 6)]
        want |= dict(rows)
        versions.publish(spark.createDataFrame(rows, "k long, v long"), number, path, keys, compact_after=3)
        versions.publish(spark.createDataFrame(rows, "k long, v long"), number, path, keys, compact_after=3)  # run again
        assert {r.k: r.v for r in versions.current(spark, path, keys).collect()} == want
    assert {"base-8", "base-5", "batch-8"} <= set(listed(spark, path)) and "batch-2" not in listed(spark, path)
    assert versions.current(spark, str(tmp_path / "nothing"), keys, "k long, v long, version long").count() == 0


def brute_asof(rows, watermark, max_age=None):
    out = []
    for i, ts, user, kind, *_ in rows:
        if kind != "purchase" or ts > watermark:
            continue
        found = max(((t, j, v) for j, t, u, k, v, _ in rows if k == "view" and u == user and t <= ts), default=None)
        if found and max_age and ts - found[0] > max_age:
            found = None
        out.append((i, user, found[1] if found else None, found[2] if found else None))
    return sorted(out)


@pytest.mark.parametrize("max_age", [None, 1800])
def test_asof_join_of_streams_against_brute_force(spark, feed, tmp_path, max_age):
    rng = random.Random(5)
    rows = [event(i, rng.randrange(0, 3000) / 2, rng.randrange(4), rng.choice(["view", "view", "purchase", "click"]), float(i)) for i in range(300)]
    rows += [event(1000 + k, 100, 9, kind, float(k)) for k, kind in enumerate(["view", "view", "purchase"])]  # one instant
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(0, 50)))
    own, where = state_session(spark), {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "progress")}
    for lo in range(0, len(late), 60):  # a restart between any two batches
        feed(late[lo:lo + 60])
        events = events_of(own, feed)
        purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "event_time")
        views = events.filter("event_type = 'view'").select(
            "user_id", F.col("event_time").alias("at"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
        joined = asof_join_streams(purchases, views, "user_id", "event_time", "at", "view_id", ["view_id", "view_value"], max_age)
        got = run_to_table(joined, f"asof-{lo}", own_state=True, **where)
    watermark = max(r[1] for r in rows) - dt.timedelta(hours=1)
    found = sorted(((r.event_id, r.user_id, r.view_id, r.view_value) for r in got.collect()))
    assert found == brute_asof(rows, watermark, max_age and dt.timedelta(seconds=max_age))
    assert len(found) > 50 and any(f[2] is None for f in found)
