"""Panels kept up to date by the day: only days that changed, and days that look back on them, are built anew.

A kept panel is a folder with two things: ``rows``, a Parquet table with one
partition a day (or a month, where days are small), and ``state-<n>``, a fingerprint of every day of the source as
of the last refresh.  A refresh reads the source once for its fingerprints,
compares them with the stored ones, and builds and overwrites the partitions of
the days that a difference can reach.

The state is written after the rows.  A refresh that breaks off leaves the old
state, so the next one finds the same differences and overwrites the same
partitions: it may repeat work but cannot lose or double any.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.storage import delete, listed, settle

DAY = "d"


def fingerprints(source: DataFrame, day: str = DAY, salt: str = "") -> DataFrame:
    """``(d, n, print)``: for each day the number of rows and a digest of them that does not depend on their order.

    Two sums of different hashes, so that a change of several rows does not
    cancel out.  ``salt`` stands for all else that the panel is made from.
    """
    columns = [F.col(c) for c in source.columns]
    one, other = F.xxhash64(F.lit(salt), *columns), F.xxhash64(F.lit(f"{salt}:again"), *columns)
    whole = "decimal(38,0)"
    return source.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias(DAY)).agg(
        F.count(F.lit(1)).alias("n"),
        F.concat_ws(":", F.sum(one.cast(whole)), F.sum(other.cast(whole))).alias("print"))


@dataclass(frozen=True)
class Refresh:
    """What a refresh did."""

    changed: list[dt.date]  # days of the source that differ from the last refresh
    rebuilt: list[dt.date]  # days of the panel that were written or removed
    first: bool


def spread(days: list[dt.date], back: int, ahead: int) -> list[dt.date]:
    """All days from ``back`` before to ``ahead`` after one of ``days``, in order."""
    return sorted({d + dt.timedelta(days=k) for d in days for k in range(-back, ahead + 1)})


def runs(days: list[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Days in order as runs from first to last."""
    out: list[tuple[dt.date, dt.date]] = []
    for d in days:
        if out and d - out[-1][1] <= dt.timedelta(days=1):
            out[-1] = out[-1][0], d
        else:
            out.append((d, d))
    return out


MOST_RUNS = 64  # of days named one by one in a filter; a few more days are read beyond that


def within(column: Column, days: list[dt.date]) -> Column:
    """A condition that holds on all of ``days`` and, if they lie in very many runs, on the gaps between the nearest ones too.

    Written as ranges of literals, so that it prunes partitions and row groups.
    """
    found = runs(days)
    while len(found) > MOST_RUNS:
        gaps = sorted(range(1, len(found)), key=lambda i: found[i][0] - found[i - 1][1])
        joined = set(gaps[:len(found) - MOST_RUNS])
        merged: list[tuple[dt.date, dt.date]] = []
        for i, (lo, hi) in enumerate(found):
            merged[-1:] = [(merged[-1][0], hi)] if i in joined else [*merged[-1:], (lo, hi)]
        found = merged
    condition = F.lit(False)
    for lo, hi in found:
        condition = condition | column.between(F.lit(lo), F.lit(hi))
    return condition


def _state(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The number and content of the last complete state."""
    numbers = sorted((int(name.removeprefix("state-")) for name in listed(spark, path) if name.startswith("state-")), reverse=True)
    for n in numbers:
        if "_SUCCESS" in listed(spark, f"{path}/state-{n}"):
            return n, spark.read.parquet(f"{path}/state-{n}")
    return 0, None


PART = "bucket"  # the partition column: the first day of a day, month or year
UNITS = ("day", "month", "year")


def whole_units(days: list[dt.date], unit: str) -> list[dt.date]:
    """All days of the units in which some day lies, in order."""
    if unit == "day":
        return sorted(set(days))
    starts = {(d.year, d.month if unit == "month" else 1) for d in days}
    out = []
    for year, month in sorted(starts):
        end = dt.date(year + 1, 1, 1) if unit == "year" or month == 12 else dt.date(year, month + 1, 1)
        start = dt.date(year, month, 1)
        out += [start + dt.timedelta(days=k) for k in range((end - start).days)]
    return out


def _write(built: DataFrame, rows: str, how: str, unit: str) -> None:
    placed = built.withColumn(PART, F.date_trunc(unit, DAY).cast("date")).repartition(PART)
    placed.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(PART).parquet(rows)


def _replace(built: DataFrame, path: str, reached: list[dt.date], unit: str) -> list[dt.date]:
    """Overwrite the partitions of the days ``reached``, whole units; one that has no rows now is removed.

    Returns the days that had or have rows, of partitions a day, else all days of the units.
    """
    spark, rows = built.sparkSession, f"{path}/rows"
    first = {d: d if unit == "day" else d.replace(day=1) if unit == "month" else d.replace(month=1, day=1) for d in reached}
    names = {f"{PART}={d.isoformat()}" for d in first.values()}
    before = {name for name in listed(spark, rows) if name in names}
    built = settle(built, "rebuilt-days")  # read twice: for its partitions and for its rows
    held = {f"{PART}={r[0].isoformat()}" for r in built.select(F.date_trunc(unit, DAY).cast("date")).distinct().collect()}
    _write(built, rows, "dynamic", unit)
    for name in before - held:
        delete(spark, f"{rows}/{name}")
    return [d for d in reached if f"{PART}={first[d].isoformat()}" in before | held]


def refresh(
    source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, day: str = DAY, lookback: int = 0, lookahead: int = 0, salt: str = "",
    unit: str = "day",
) -> Refresh:
    """Bring the panel in ``path`` up to date with ``source``.

    ``build`` makes panel rows, with a date column ``d``, from source rows.  A
    panel row of one day may depend on source rows of its own day, of
    ``lookback`` calendar days before and of ``lookahead`` after it, and on
    nothing else but what ``salt`` stands for: with another ``salt`` every day
    counts as changed.  Windows of a number of rows instead of days are bounded
    only if the calendar has no gaps.

    ``unit`` is what a partition holds, a day, month or year, the same for every
    refresh of a path; with larger ones a changed day rebuilds all of its unit.
    Rows without a day take no part.  A day that the source no longer has loses
    its partition.  The days, not their rows, come to the driver.  Two refreshes
    of one path must not run at once.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}, not {unit!r}")
    spark = source.sparkSession
    number, known = _state(spark, path)
    fresh = settle(fingerprints(source, day, salt), "fingerprints")
    if known is None:
        changed = [r[DAY] for r in fresh.select(DAY).collect()]
    else:
        old = known.select(F.col(DAY).alias("_d"), F.col("n").alias("_n"), F.col("print").alias("_print"))
        differs = ~(F.col("n").eqNullSafe(F.col("_n")) & F.col("print").eqNullSafe(F.col("_print")))
        both = fresh.join(old, F.col(DAY) == F.col("_d"), "full_outer")
        changed = [r[0] for r in both.filter(differs).select(F.coalesce(DAY, "_d")).collect()]
    changed.sort()
    rebuilt: list[dt.date] = []
    if changed or known is None:
        reached = whole_units(spread(changed, lookahead, lookback), unit)
        needed = spread(reached, lookback, lookahead)
        part = source if known is None else source.filter(within(F.col(day), needed))
        built = build(part)
        if known is not None:
            exact = spark.createDataFrame([(d,) for d in reached], f"{DAY} date")
            built = built.filter(within(F.col(DAY), reached)).join(exact, DAY, "left_semi")
        if known is None:
            _write(built, f"{path}/rows", "static", unit)
            rebuilt = changed
        else:
            rebuilt = _replace(built, path, reached, unit)
    fresh.write.mode("overwrite").parquet(f"{path}/state-{number + 1}")
    if number:
        delete(spark, f"{path}/state-{number}")
    return Refresh(changed, rebuilt, known is None)


def table_print(*tables: DataFrame) -> str:
    """One digest of whole tables, for the ``salt`` of a panel that is made from them too."""
    prints = [df.agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")))).first()[0] for df in tables]
    return "|".join(prints)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The panel's rows; ``schema`` is for a panel that may not have a day yet."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/rows").drop(PART)
