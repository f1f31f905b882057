"""As-of join of two streams: each left row with the latest right row of its key at or before it.

Row windows do not run on a stream, and a join of streams by an equal key gives
all pairs.  Here both sides wait as state of a bucket of keys.  A left row is answered
when the watermark has passed it: by then every right row that could be the
latest has come, in whatever order.  Of the right rows at or before the
watermark only the latest can still be wanted, so the others are let go.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels to the workers as code, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEFT, RIGHT = 1, 0
BUCKETS = 1024  # that keys are hashed to; a stream that goes on from a checkpoint must keep the number
FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class LatestBefore(StatefulProcessor):
    """State of a bucket of keys: left rows that wait, right rows that may still be wanted, both as (key, micros, tie, row).

    Every read of state and every timer is a call out of Python, so keys share
    them: a batch costs some calls for each bucket, not for each key.
    """

    def __init__(self, max_age: int | None):
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, at long, tie long, held string")
        self.latest = handle.getListState("latest", "key string, at long, tie long, held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asks, answers = [], []
        for part in rows:
            for side, *row in zip(*(part[c].tolist() for c in ("asof_side", "asof_key", "asof_at", "asof_tie", "asof_row"))):
                (asks if side == LEFT else answers).append(tuple(row))
        if asks:
            self.waiting.appendList(asks)
        if answers:
            self.latest.appendList(answers)
        self._wake(asks, answers)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        answers = sorted(self.latest.get(), key=lambda a: a[:3]) if self.latest.exists() else []
        of_key = {k: list(own) for k, own in groupby(answers, key=lambda a: a[0])}
        times = {k: [a[1] for a in own] for k, own in of_key.items()}
        due, later = [w for w in waiting if w[1] <= now], [w for w in waiting if w[1] > now]
        out = []
        for k, at, _, held in due:
            i = bisect_right(times.get(k, ()), at) - 1
            fits = i >= 0 and (self.max_age is None or at - times[k][i] <= self.max_age)
            out.append((held, of_key[k][i][3] if fits else None))
        if due:
            self._keep(self.waiting, later)
        wanted = []
        for k, own in of_key.items():
            passed = bisect_right(times[k], now)
            wanted += [a for a in own[max(0, passed - 1):passed] if self.max_age is None or a[1] + self.max_age > now] + own[passed:]
        if len(wanted) < len(answers):
            self._keep(self.latest, wanted)
        self._wake(later, wanted)
        if out:
            yield pd.DataFrame(out, columns=["asof_left", "asof_right"])

    def _wake(self, waiting: list, answers: list) -> None:
        """A timer for the first row that becomes due or too old."""
        ends = [w[1] for w in waiting]
        if self.max_age is not None:
            ends += [a[1] + self.max_age for a in answers]
        if ends:
            self.handle.registerTimer(_millis(min(ends)))

    @staticmethod
    def _keep(state, rows: list) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first millisecond that is not before it."""
    return -(-int(micros) // 1000)


def asof_join_streams(
    left: DataFrame, right: DataFrame, key: str, at: str, since: str, tie: str, take: list[str], max_age_seconds: int | None = None,
) -> DataFrame:
    """Each left row with columns ``take`` of the latest right row of its key at or before it, NULL where there is none.

    Both sides carry a watermark: ``at`` on the left, ``since`` on the right.
    Equal times on the right are settled by the largest ``tie``, a whole number.
    With ``max_age_seconds`` an older right row does not count, and its state is
    dropped when the watermark has passed it by so much, also for a key that is
    never heard of again; without it one right row a key stays for good.

    A left row comes out once the watermark is at or past its time.  Rows of
    either side that come later than the watermark are dropped, as everywhere.
    Rows without a key or a time take no part.  Columns of either side must be
    of simple types.  The session needs the RocksDB state store.
    """
    clash = set(left.columns) & set(take)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}; rename them first")
    # Rows travel as text, so that whole numbers and NULLs stay what they are; only one column carries the watermark.
    row = lambda columns, time: F.to_json(F.struct(*[
        (F.timestamp_micros(F.unix_micros(c)) if c == time else F.col(c)).alias(c) for c in columns]), FORMAT)
    tied = F.coalesce(F.col(tie).cast("long"), F.lit(-(2**63)))
    kind = left.schema[key].dataType.simpleString()
    name = (F.col(key) + F.lit(0.0) if kind in ("float", "double") else F.col(key)).cast("string")  # 0 and -0 are one key
    sides = [
        df.filter(F.col(key).isNotNull()).select(
            name.alias("asof_key"), F.col(time).alias("asof_time"), F.unix_micros(time).alias("asof_at"), F.lit(side).alias("asof_side"),
            order.alias("asof_tie"), row(columns, time).alias("asof_row"))
        for df, time, side, order, columns in ((left, at, LEFT, F.lit(0).cast("long"), left.columns), (right, since, RIGHT, tied, take))]
    both = sides[0].unionByName(sides[1]).filter(F.col("asof_at").isNotNull())
    bucketed = both.withColumn("asof_bucket", F.pmod(F.xxhash64("asof_key"), F.lit(BUCKETS)).cast("int"))
    joined = bucketed.groupBy("asof_bucket").transformWithStateInPandas(
        LatestBefore(None if max_age_seconds is None else max_age_seconds * 1_000_000),
        outputStructType="asof_left string, asof_right string", outputMode="Append", timeMode="EventTime")
    schema = lambda df, columns: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    read = joined.select(
        F.from_json("asof_left", schema(left, left.columns), FORMAT).alias("asof_left"), F.from_json("asof_right", schema(right, take), FORMAT).alias("asof_right"))
    return read.select(*[F.col("asof_left")[c].alias(c) for c in left.columns], *[F.col("asof_right")[c].alias(c) for c in take])
