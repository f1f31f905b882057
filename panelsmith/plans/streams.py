"""Queries on the event stream, each with its batch twin where it has one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelsmith.functions.numeric import tidy
from panelsmith.operators.sessions import sessions
from panelsmith.operators.timejoin import micros
from panelsmith.plans.inputs import r
from panelsmith.plans.registry import query
from panelsmith.sources.tables import load, load_stream
from panelsmith.streaming import bars as live
from panelsmith.streaming.asof import asof_join_streams
from panelsmith.streaming.features import running_features
from panelsmith.storage import new_path
from panelsmith.streaming.jobs import run_to_table, state_session
from panelsmith.streaming.versions import run_early

EPOCH = dt.datetime(1970, 1, 1)
TOTAL = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"
WATERMARK = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"

BARS_SQL = f"""SELECT date_trunc('day', ts) AS bar_start, event_type, count(*) AS n, {TOTAL} AS total, min(value) AS low,
      max(value) AS high, arg_min(value, ts) AS open, arg_max(value, ts) AS close
    FROM events GROUP BY 1, 2"""

SESSIONS_SQL = f"""WITH steps AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev_ts FROM events),
    runs AS (SELECT *, sum(CASE WHEN prev_ts IS NULL OR ts > prev_ts + INTERVAL 6 HOURS THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts) AS run FROM steps)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, {TOTAL} AS total
    FROM runs GROUP BY user_id, run"""


@query(BARS_SQL)
def event_bars(spark, folder):
    return live.bars(live.with_event_time(load(spark, folder, "events")), "1 day", "event_type")


FEED_SLICES = 5  # at least
SLICE_ROWS = 50_000_000
FILE_ROWS = 1_000_000
LATE_SECONDS = 1800


def disordered_feed(spark, folder, name: str = "events") -> tuple[str, int]:
    """A folder with the events in slices, in which events come up to half an hour late, also across slices.

    Slices are written one after another, since the file source takes files by
    their age.  The files of a slice are written by as many tasks, each with
    rows of all its time, so that a batch of so many files is one slice.
    Returns the folder and the number of files of a slice.
    """
    late = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(LATE_SECONDS)))
    events = load(spark, folder, "events").withColumn("_seen", micros(F.col("ts") + late))
    rows = events.count()
    slices = max(FEED_SLICES, -(-rows // SLICE_ROWS))
    files = max(1, -(-rows // (slices * FILE_ROWS)))
    cuts = events.agg(F.percentile_approx("_seen", [k / slices for k in range(1, slices)], 100 * slices).alias("cuts")).first().cuts or []
    feed = new_path(spark, "feed")
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = events
        if lo is not None:  # the bound on the time itself lets the scan leave out row groups
            part = part.filter((F.col("_seen") >= lo) & (F.col("ts") >= F.lit(EPOCH + dt.timedelta(microseconds=lo) - dt.timedelta(seconds=LATE_SECONDS))))
        if hi is not None:
            part = part.filter((F.col("_seen") < hi) & (F.col("ts") < F.lit(EPOCH + dt.timedelta(microseconds=hi))))
        part.drop("_seen").repartition(files).write.mode("append").parquet(f"{feed}/{name}.parquet")
    return feed, files


def late_events(spark, folder, session=None):
    """The disordered feed as a stream, a slice in a batch."""
    feed, files = disordered_feed(spark, folder)
    return live.with_event_time(load_stream(session or spark, feed, "events", files_per_trigger=files))


@query(f"SELECT * FROM ({BARS_SQL}) WHERE bar_start + INTERVAL 1 DAY <= {WATERMARK}")
def stream_event_bars_disordered(spark, folder):
    """The same bars when events come late and in several batches."""
    return run_to_table(live.bars(late_events(spark, folder), "1 day", "event_type"), "late-event-bars")


@query(f"SELECT * FROM ({SESSIONS_SQL}) WHERE last_ts + INTERVAL 6 HOURS <= {WATERMARK}")
def stream_user_sessions_disordered(spark, folder):
    """The same sessions when events come late and in several batches."""
    return run_to_table(live.sessions(late_events(spark, folder), "6 hours", "user_id"), "late-user-sessions")


@query(BARS_SQL)
def stream_event_bars_early(spark, folder):
    """All bars, that of the last day too: each batch publishes the bars that it changed, and the newest version counts."""
    published = run_early(live.bars(late_events(spark, folder), "1 day", "event_type"), ["bar_start", "event_type"], "early-event-bars")
    return published.drop("version")


VIEWED_SQL = f"""SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase' AND ts <= {WATERMARK}) p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def purchases_and_views(events):
    """Both sides of the join, out of one stream of events."""
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "event_time")
    views = events.filter("event_type = 'view'").select(
        "user_id", F.col("event_time").alias("view_time"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return purchases, views


@query(VIEWED_SQL)
def stream_purchase_after_view(spark, folder):
    """Each purchase that the watermark has passed, with the user's latest view before it, over two late streams."""
    own = state_session(spark)
    purchases, views = purchases_and_views(late_events(spark, folder, own))
    joined = asof_join_streams(purchases, views, "user_id", "event_time", "view_time", "view_id", ["view_id", "view_value"])
    return run_to_table(joined, "purchase-after-view", own_state=True).drop("event_time")


HOUR = 3600


@query(f"""SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(view_ts) <= {HOUR}000000 THEN view_id END AS view_id,
      CASE WHEN epoch_us(ts) - epoch_us(view_ts) <= {HOUR}000000 THEN view_value END AS view_value
    FROM (SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.event_id AS view_id, v.value AS view_value
      FROM (SELECT * FROM events WHERE event_type = 'purchase' AND ts <= {WATERMARK}) p
      ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts)""")
def stream_purchase_within_hour(spark, folder):
    """The same with views of the last hour only: older ones are forgotten."""
    own = state_session(spark)
    purchases, views = purchases_and_views(late_events(spark, folder, own))
    joined = asof_join_streams(purchases, views, "user_id", "event_time", "view_time", "view_id", ["view_id", "view_value"], max_age_seconds=HOUR)
    return run_to_table(joined, "purchase-within-hour", own_state=True).drop("event_time")


@query(f"SELECT * FROM ({BARS_SQL}) WHERE bar_start + INTERVAL 1 DAY <= {WATERMARK}")
def stream_event_bars(spark, folder):
    """The bars whose day the watermark has passed."""
    stream = live.bars(live.with_event_time(load_stream(spark, folder, "events")), "1 day", "event_type")
    return run_to_table(stream, "event-bars")


@query(SESSIONS_SQL)
def user_sessions(spark, folder):
    return sessions(load(spark, folder, "events"), 6 * 3600, "user_id")


@query(SESSIONS_SQL)
def user_sessions_binned(spark, folder):
    """The same sessions by the way that keys too large for a task take."""
    return sessions(load(spark, folder, "events"), 6 * 3600, "user_id", bin_seconds=6 * 3600)


@query(f"SELECT * FROM ({SESSIONS_SQL}) WHERE last_ts + INTERVAL 6 HOURS <= {WATERMARK}")
def stream_user_sessions(spark, folder):
    """The sessions that can no longer grow."""
    stream = live.sessions(live.with_event_time(load_stream(spark, folder, "events")), "6 hours", "user_id")
    return run_to_table(stream, "user-sessions")


@query("SELECT event_id, user_id, event_type, ts, value, props FROM events")
def stream_without_repeats(spark, folder):
    """Every event delivered twice, taken in once."""
    twice = load_stream(spark, folder, "events").unionByName(load_stream(spark, folder, "events"))
    once = live.drop_repeats(live.with_event_time(twice), ["event_id"])
    return run_to_table(once.select("event_id", "user_id", "event_type", "ts", "value", "props"), "without-repeats")


@query(f"""WITH RECURSIVE daily AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS bar_end, {TOTAL} AS total
      FROM events GROUP BY 1, 2),
    closed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bar_end) AS seen,
      total - lag(total) OVER (PARTITION BY user_id ORDER BY bar_end) AS change
      FROM daily WHERE bar_end <= {WATERMARK}),
    run AS (SELECT *, total AS e FROM closed WHERE seen = 1
      UNION ALL SELECT c.*, 2e-1 * c.total + 8e-1 * run.e FROM run
      JOIN closed c ON c.user_id = run.user_id AND c.seen = run.seen + 1)
    SELECT user_id, bar_end, seen, total, {r('e', 4)} AS mean, {r('change', 4)} AS change FROM run""")
def stream_running_features(spark, folder):
    own = state_session(spark)
    stream = running_features(
        live.with_event_time(load_stream(own, folder, "events")), "1 day", "user_id", "bigint", 0.2
    )
    table = run_to_table(stream, "running-features", own_state=True)
    return table.select(
        "user_id", F.col("bar_end").cast("timestamp_ntz").alias("bar_end"), "seen", "total",
        tidy("mean", 4).alias("mean"), tidy("change", 4).alias("change"),
    )
