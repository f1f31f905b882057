"""Joins by time: as of a moment, and within a span of validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.operators.ordering import ONE_TASK_ROWS, attach, chunked, cut_width, cuts_below
from panelsmith.storage import settle


def micros(ts: Column) -> Column:
    """Microseconds since 1970, free of any time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def time_bin(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


CUT_ACCURACY = 10_000


def hot_cuts(moments: DataFrame, key: str, ts: str) -> DataFrame | None:
    """``(key, cuts, width)``: moments that cut each key too large for a task into parts of nearly equal size.

    Measured by one count per key; None if every key fits as it is.  The cuts
    follow the key's own times, so a burst is cut as finely as it is dense; only
    rows of one instant stay together.
    """
    counts = moments.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.filter(F.col("_n") > ONE_TASK_ROWS)
    most = large.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    parts = -(-2 * most // ONE_TASK_ROWS)
    spots = [i / parts for i in range(1, parts)]
    cuts = moments.join(large.select(key), key, "left_semi").groupBy(key).agg(
        F.array_distinct(F.percentile_approx(micros(F.col(ts)), spots, max(CUT_ACCURACY, 20 * parts))).alias("_cuts"))
    width = cut_width(parts)
    cuts = cuts.select(key, chunked(F.col("_cuts"), width).alias("_cuts"), F.lit(width).alias("_width"))
    return settle(cuts, "cuts")  # several passes must see the same cuts


def with_bin(rows: DataFrame, key: str, ts: str, bin_seconds: int | None, cuts: DataFrame | None) -> DataFrame:
    """Add ``_bin``, which rises with time within a key: of fixed width, or by the key's cuts (0 for keys without)."""
    if bin_seconds is not None:
        return rows.withColumn("_bin", time_bin(F.col(ts), bin_seconds))
    marked = attach(rows, cuts, [key]).withColumn("_at", micros(F.col(ts)))
    before = F.when(F.col("_cuts").isNotNull(), cuts_below("_cuts", F.col("_at"), F.col("_width")))
    return marked.withColumn("_bin", F.coalesce(before, F.lit(0)).cast("long")).drop("_cuts", "_width", "_at")


def asof_join(
    left: DataFrame, right: DataFrame, key: str, at: str, since: str, tie: str,
    take: list[str], bin_seconds: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it.

    Columns ``take`` of the right side are added, NULL where there is none.
    Equal times on the right side are settled by the largest ``tie``, of any
    type that has an order.  A left row without key or time finds none.

    Both sides are put in one order of time and the last right row is carried
    along; no pairs are formed.  If some key has too many rows for a task,
    time is cut into bins.  A row then first looks within its bin; failing
    that it takes the last right row of the earlier bins, which is carried
    over one row per bin and key.  Keys that are too large are cut where their
    rows are, unless ``bin_seconds`` gives bins of fixed width to all.
    """
    clash = set(left.columns) & set(take)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}; rename them first")
    asking = F.col(key).isNotNull() & F.col(at).isNotNull()
    answering = right.filter(F.col(key).isNotNull() & F.col(since).isNotNull())
    times = left.filter(asking).select(F.col(key).alias("key"), F.col(at).alias("ts"))
    times = times.unionByName(answering.select(F.col(key).alias("key"), F.col(since).alias("ts")))
    cuts = hot_cuts(times, "key", "ts") if bin_seconds is None else None
    binned = bin_seconds is not None or cuts is not None
    if binned:  # read twice below
        left = settle(left, "asof-left")
    fields = [f"_l{i}" for i in range(len(left.columns))]
    picked = F.struct(*[F.col(c).alias(c) for c in take])
    asks = left.filter(asking).select(
        F.col(key).alias("_key"), F.col(at).alias("_ts"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.schema[tie].dataType).alias("_tie"),
        *[F.col(c).alias(f) for c, f in zip(left.columns, fields)],
    )
    answers = answering.select(
        F.col(key).alias("_key"), F.col(since).alias("_ts"), F.lit(0).alias("_side"),
        F.col(tie).alias("_tie"), picked.alias("_right"),
    )
    moments = asks.unionByName(answers, allowMissingColumns=True)
    parts = ["_key"]
    if binned:
        named = cuts if cuts is None else cuts.withColumnRenamed("key", "_key")
        moments = with_bin(moments, "_key", "_ts", bin_seconds, named)
        parts = ["_key", "_bin"]
    within = (
        Window.partitionBy(*parts).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    )
    matched = moments.withColumn("_found", F.last("_right", ignorenulls=True).over(within)).filter("_side = 1")
    if binned:
        last_of_bin = F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_ts", "_tie")))
        earlier = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            moments.groupBy("_key", "_bin").agg(last_of_bin.alias("_last"))
            .select("_key", "_bin", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
            .filter(F.col("_carried").isNotNull())
        )
        matched = matched.drop("_right").join(carried, parts, "left")
        matched = matched.withColumn("_found", F.coalesce("_found", "_carried"))
    matched = matched.select(
        *[F.col(f).alias(c) for c, f in zip(left.columns, fields)],
        *[F.col("_found")[c].alias(c) for c in take],
    )
    none = left.filter(~asking).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    return matched.unionByName(none)


def point_in_time_join(
    facts: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, tie: str,
    take: list[str], bin_seconds: int | None = None,
) -> DataFrame:
    """Each fact with the span of its key that holds at its time: start <= time < end.

    The spans of a key must not overlap (``overlapping_spans`` finds those that
    do); an open span has a NULL end.  With disjoint spans only the latest
    start can hold, so this is an as-of join with one more condition.
    """
    wanted = [*dict.fromkeys([*take, end])]
    joined = asof_join(facts, spans, key, at, start, tie, wanted, bin_seconds)
    holds = F.col(end).isNull() | (F.col(at) < F.col(end))
    return joined.select(*facts.columns, *[F.when(holds, F.col(c)).alias(c) for c in take])


def spans_from_changes(
    changes: DataFrame, key: str, at: str, tie: str, bin_seconds: int | None = None
) -> DataFrame:
    """Turn dated changes into spans [valid_from, valid_to); of changes at one moment the largest ``tie`` counts.

    If some key has too many rows for a task, the next change is looked for
    within a bin of time, and else is the first one of the later bins.
    """
    cuts = hot_cuts(changes, key, at) if bin_seconds is None else None
    rest = [c for c in changes.columns if c not in (key, at)]
    one = changes.groupBy(key, at).agg(F.max_by(F.struct(*rest), F.col(tie)).alias("_row"))
    if bin_seconds is None and cuts is None:
        dated = one.withColumn("_until", F.lead(at).over(Window.partitionBy(key).orderBy(at)))
    else:
        dated = _next_over_bins(one, changes, key, at, bin_seconds, cuts)
    return dated.select(
        key, F.col(at).alias("valid_from"), F.col("_until").alias("valid_to"),
        *[F.col("_row")[c].alias(c) for c in rest],
    )


def _next_over_bins(
    one: DataFrame, changes: DataFrame, key: str, at: str, bin_seconds: int | None, cuts: DataFrame | None
) -> DataFrame:
    one = with_bin(one, key, at, bin_seconds, cuts)
    later = Window.partitionBy(key).orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    firsts = with_bin(changes.select(key, at), key, at, bin_seconds, cuts).groupBy(key, "_bin").agg(F.min(at).alias("_first"))
    firsts = firsts.select(key, "_bin", F.min("_first").over(later).alias("_later"))
    near = F.lead(at).over(Window.partitionBy(key, "_bin").orderBy(at))
    both = attach(one.withColumn("_near", near), firsts, [key, "_bin"])
    return both.withColumn("_until", F.coalesce("_near", "_later"))


def overlapping_spans(
    spans: DataFrame, key: str, start: str, end: str, bin_seconds: int | None = None
) -> DataFrame:
    """Spans that begin before an earlier span of the same key has ended."""
    cuts = hot_cuts(spans, key, start) if bin_seconds is None else None
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    ends = spans.withColumn("_until", F.coalesce(F.col(end).cast("timestamp_ntz"), far))
    if bin_seconds is None and cuts is None:
        before = Window.partitionBy(key).orderBy(start, "_until").rowsBetween(Window.unboundedPreceding, -1)
        latest = ends.withColumn("_latest", F.max("_until").over(before))
        return latest.filter(F.col(start) < F.col("_latest")).select(*spans.columns)
    ends = with_bin(ends, key, start, bin_seconds, cuts)
    earlier = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    lasts = ends.groupBy(key, "_bin").agg(F.max("_until").alias("_last"))
    lasts = lasts.select(key, "_bin", F.max("_last").over(earlier).alias("_before"))
    inside = Window.partitionBy(key, "_bin").orderBy(start, "_until").rowsBetween(Window.unboundedPreceding, -1)
    near = ends.withColumn("_near", F.max("_until").over(inside))
    open_until = F.greatest("_near", "_before")
    return attach(near, lasts, [key, "_bin"]).filter(F.col(start) < open_until).select(*spans.columns)
