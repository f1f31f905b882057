import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.sources.tables import load_stream, schema_of
from panelsmith.session import STATE_STORE
from panelsmith.streaming import bars as live
from panelsmith.streaming.features import running_features
from panelsmith.streaming.jobs import run_to_table, state_session

START = dt.datetime(2024, 1, 1)


def event(i, minutes, user=1, value=1.0):
    return (i, START + dt.timedelta(minutes=minutes), user, "view", value, "{}")


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of event files; each call adds one file, which is one batch."""
    folder = tmp_path / "events.parquet"

    def add(rows):
        df = spark.createDataFrame(rows, schema_of("events")).coalesce(1)
        df.write.mode("append").parquet(str(folder))

    add.folder = str(tmp_path)
    return add


def stream(spark, feed, late_by="1 hour"):
    return live.with_event_time(load_stream(spark, feed.folder, "events", files_per_trigger=1), late_by)


def paths(tmp_path):
    return {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "progress")}


def test_bars_accept_disorder_and_drop_what_is_too_late(spark, feed, tmp_path):
    bars = lambda: live.bars(stream(spark, feed), "1 hour", "user_id")
    feed([event(1, 50), event(2, 10)])
    assert run_to_table(bars(), "b1", **paths(tmp_path)).count() == 0      # nothing is closed yet
    feed([event(3, 65), event(4, 5)])                                       # 4 comes late, in time
    run_to_table(bars(), "b2", **paths(tmp_path))
    feed([event(5, 300)])                                                   # closes the first hours
    got = run_to_table(bars(), "b3", **paths(tmp_path)).orderBy("bar_start").collect()
    assert [(r.bar_start, r.n) for r in got] == [(START, 3), (START + dt.timedelta(hours=1), 1)]
    assert (got[0].open, got[0].close, got[0].total) == (1.0, 1.0, 3.0)
    feed([event(6, 20), event(7, 600)])                                     # 6 is too late
    run_to_table(bars(), "b4", **paths(tmp_path))
    final = spark.read.parquet(paths(tmp_path)["path"])
    assert final.agg(F.sum("n")).first()[0] == 5                            # 1 to 4 and 5, not 6


def test_late_rows_are_counted(spark, feed, tmp_path):
    feed([event(1, 600)])
    feed([event(2, 700)])
    bars = live.bars(stream(spark, feed), "1 hour", "user_id")
    where = paths(tmp_path)
    run_to_table(bars, "c1", **where)
    feed([event(3, 5)])
    query = (
        live.bars(stream(spark, feed), "1 hour", "user_id").writeStream.format("parquet").outputMode("append")
        .option("path", where["path"]).option("checkpointLocation", where["checkpoint"]).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_bars_equal_their_batch_twin(spark, feed, tmp_path):
    rows = [event(i, (i * 37) % 500, user=i % 3, value=round(i * 0.37, 2)) for i in range(120)]
    for part in (rows[:40], rows[40:80], rows[80:], [event(999, 5000)]):
        feed(part)
    # The delay covers all the disorder, so nothing is dropped.
    got = run_to_table(live.bars(stream(spark, feed, "10 hours"), "1 hour", "user_id"), "d", **paths(tmp_path))
    batch = spark.read.parquet(feed.folder + "/events.parquet").filter("event_id < 999")
    want = live.bars(live.with_event_time(batch), "1 hour", "user_id")
    order = lambda df: df.toPandas().sort_values(["bar_start", "user_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want))


def test_sessions_grow_over_batches(spark, feed, tmp_path):
    where = paths(tmp_path)
    feed([event(1, 0), event(2, 10)])
    run_to_table(live.sessions(stream(spark, feed), "20 minutes", "user_id"), "s1", **where)
    feed([event(3, 25), event(4, 100), event(5, 1000, user=2)])
    got = run_to_table(live.sessions(stream(spark, feed), "20 minutes", "user_id"), "s2", **where)
    assert sorted((r.n, r.first_ts, r.last_ts) for r in got.collect()) == [
        (1, START + dt.timedelta(minutes=100), START + dt.timedelta(minutes=100)),
        (3, START, START + dt.timedelta(minutes=25)),
    ]


def test_repeats_within_and_across_batches(spark, feed, tmp_path):
    where = paths(tmp_path)
    once = lambda: live.drop_repeats(stream(spark, feed), ["event_id"]).drop("event_time")
    feed([event(1, 0)] * 50 + [event(2, 1)])
    run_to_table(once(), "r1", **where)
    feed([event(1, 0)] * 50 + [event(3, 2)])
    got = run_to_table(once(), "r2", **where)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3]


def test_running_features_keep_state_over_restarts(spark, feed, tmp_path):
    where = paths(tmp_path)
    own = state_session(spark)
    make = lambda: running_features(stream(own, feed), "1 hour", "user_id", "bigint", 0.5)
    feed([event(1, 5, value=2.0), event(2, 70, value=4.0), event(3, 200, value=1.0)])
    run_to_table(make(), "f1", own_state=True, **where)
    feed([event(4, 210, value=7.0), event(5, 500, value=9.0), event(6, 505, user=2, value=3.0)])
    got = run_to_table(make(), "f2", own_state=True, **where).orderBy("bar_end").collect()
    assert [(r.seen, r.total, r["mean"], r.change) for r in got] == [
        (1, 2.0, 2.0, None), (2, 4.0, 3.0, 2.0), (3, 8.0, 5.5, 4.0)
    ]


def test_own_state_leaves_the_settings_alone(spark, feed, tmp_path):
    before = spark.conf.get(STATE_STORE)
    feed([event(1, 5)])
    with pytest.raises(ValueError, match="state_session"):
        run_to_table(running_features(stream(spark, feed), "1 hour", "user_id", "bigint", 0.5), "f3", own_state=True, **paths(tmp_path))
    assert state_session(spark) is not spark and spark.conf.get(STATE_STORE) == before


def test_values_are_not_rounded(spark):
    rows = [event(i, i, value=v) for i, v in enumerate([0.004, 0.004, 0.004, 0.125])]
    df = live.with_event_time(spark.createDataFrame(rows, schema_of("events")))
    with pytest.raises(Exception, match="more than 2 decimal places"):
        live.bars(df, "1 day", "user_id").collect()
    assert live.bars(df, "1 day", "user_id", places=3).first().total == 0.137


def test_a_zone_with_daylight_saving_is_refused(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "America/New_York")
    with pytest.raises(ValueError, match="New_York"):
        live.with_event_time(own.createDataFrame([event(1, 0)], schema_of("events")))


def test_repeats_thinned_by_salts(spark, feed, tmp_path):
    feed([event(1, 0)] * 50 + [event(2, 1)])
    once = live.drop_repeats(stream(spark, feed), ["event_id"], salts=4).drop("event_time")
    assert sorted(r.event_id for r in run_to_table(once, "r3", **paths(tmp_path)).collect()) == [1, 2]


def test_one_file_is_a_stream_too(spark, tmp_path):
    df = load_stream(spark, "/root/testdata/sf0.001", "events").select("event_id")
    assert run_to_table(df, "one", **paths(tmp_path)).count() == 1000
