"""Bars and sessions of an event stream.

The transforms take a batch DataFrame as well as a stream.  On a stream they
emit a window once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.numeric import as_whole, from_whole


# Names of the zone without an offset or daylight saving.
UTC = {"UTC", "Etc/UTC", "UCT", "Etc/UCT", "GMT", "Etc/GMT", "Z", "Zulu", "Etc/Zulu", "Universal", "Etc/Universal", "+00:00"}


def require_utc(events: DataFrame) -> None:
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC:
        raise ValueError(f"the session's zone is {zone}: zone-less times would shift or merge; set spark.sql.session.timeZone to UTC")


def with_event_time(events: DataFrame, late_by: str = "1 hour") -> DataFrame:
    """Add ``event_time`` with a watermark; zone-less times are taken as UTC, which the session must be set to."""
    require_utc(events)
    return events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late_by)


def bars(events: DataFrame, width: str, key: str, places: int = 2) -> DataFrame:
    """Count, sum, low, high, open and close of ``value`` per key and window.

    Values have at most ``places`` decimal places; one with more is an error.
    """
    grouped = events.groupBy(F.window("event_time", width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(as_whole("value", places)).alias("_total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min_by("value", "event_time").alias("open"),
        F.max_by("value", "event_time").alias("close"),
    )
    return grouped.select(
        F.col("w.start").cast("timestamp_ntz").alias("bar_start"), key,
        "n", from_whole("_total", places).alias("total"), "low", "high", "open", "close",
    )


def sessions(events: DataFrame, gap: str, key: str, places: int = 2) -> DataFrame:
    """Runs of events of a key with pauses of at most ``gap``."""
    grouped = events.groupBy(F.session_window("event_time", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(as_whole("value", places)).alias("_total"), F.max("event_time").alias("_last")
    )
    return grouped.select(
        key, F.col("w.start").cast("timestamp_ntz").alias("first_ts"),
        F.col("_last").cast("timestamp_ntz").alias("last_ts"),
        "n", from_whole("_total", places).alias("total"),
    )


def drop_repeats(events: DataFrame, key: list[str], salts: int = 1) -> DataFrame:
    """One row of each key; repeats are recognised up to the watermark's delay.

    Where the copies of one key can be very many, ``salts`` tasks side by side
    first thin them out, so that the task that owns the key sees at most that
    many of them per spell of the watermark.  That costs a second pass over
    every event.
    """
    if salts > 1:
        salted = events.withColumn("_salt", F.floor(F.rand() * salts).cast("int"))
        events = salted.dropDuplicatesWithinWatermark([*key, "_salt"]).drop("_salt")
    return events.dropDuplicatesWithinWatermark(key)
