"""Standard errors, resampling and corrections for many tests."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions.numeric import correlation, known, ratio, slope, tidy
from panelsmith.operators.evaluation import SIGNAL_DAY
from panelsmith.operators.gram import pair_moments
from panelsmith.operators.ordering import attach, positions, slice_in_order, slices_for
from panelsmith.storage import settle


def fama_macbeth(
    df: DataFrame, x: str = "x", target: str = "fwd_1", by: list[str] = SIGNAL_DAY,
    lags: int = 2, min_assets: int = 5,
) -> DataFrame:
    """Mean of the daily slopes with a Newey-West t value, per signal."""
    series = [c for c in by if c != "d"]
    complete = F.col(x).isNotNull() & F.col(target).isNotNull()
    slopes = (
        df.groupBy(*by)
        .agg(F.count(F.when(complete, 1)).alias("_n"), slope(target, x).alias("_b"))
        .filter((F.col("_n") >= min_assets) & F.col("_b").isNotNull())
    )
    of_series = Window.partitionBy(*series)
    errors = slopes.withColumn("_e", F.col("_b") - F.avg("_b").over(of_series))
    past = of_series.orderBy("d")
    errors = errors.select(
        *series, "_b", "_e", *[F.lag("_e", k).over(past).alias(f"_e{k}") for k in range(1, lags + 1)]
    )
    sums = errors.groupBy(*series).agg(
        F.count(F.lit(1)).alias("days"), F.avg("_b").alias("_mean"),
        F.sum(F.col("_e") * F.col("_e")).alias("_g0"),
        *[F.sum(F.col("_e") * F.col(f"_e{k}")).alias(f"_g{k}") for k in range(1, lags + 1)],
    )
    spread = F.col("_g0")
    for k in range(1, lags + 1):
        spread = spread + 2.0 * (1.0 - k / (lags + 1.0)) * F.coalesce(F.col(f"_g{k}"), F.lit(0.0))
    error = F.sqrt(F.when(spread > 0, spread)) / F.col("days")
    return sums.select(
        *series, "days", tidy("_mean", 9).alias("mean_slope"), tidy(ratio("_mean", error)).alias("t_value")
    )


def _poisson_steps(upto: int = 12) -> list[float]:
    """Distribution function of the Poisson law with mean 1 at 0, 1, ..., upto - 1.

    A draw of 32 bits is above the last step with probability 6e-11; it then counts ``upto`` times.
    """
    total, steps = 0.0, []
    for k in range(upto):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(total)
    return steps


def bootstrap_mean(
    df: DataFrame, value: str, row_id: str, by: list[str], replicas: int = 200, level: float = 0.95
) -> DataFrame:
    """Mean with a percentile interval from a Poisson bootstrap.

    In each replica a row counts Poisson(1) times, drawn from a hash of the
    replica and ``row_id``.  No row needs to know any other, so the sums are
    formed where the rows are read and only replicas reach the shuffle.
    """
    known = df.filter(F.col(value).isNotNull())
    # Few rows become many draws: place them in as many tasks as a shuffle has before they multiply.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = known.repartition(tasks, *by, row_id).select(
        *by, F.col(value).alias("_x"), F.col(row_id).cast("string").alias("_id"),
        F.explode(F.sequence(F.lit(0), F.lit(replicas))).alias("_replica"),
    )
    digest = F.md5(F.concat(F.col("_replica").cast("string"), F.lit(":"), F.col("_id")))
    draw = _share(digest, 1)
    drawn = sum(((F.col("_draw") >= F.lit(step)).cast("int") for step in _poisson_steps()), F.lit(0))
    # Replica 0 counts every row once and so gives the plain mean.
    means = (
        spread.withColumn("_draw", draw)  # a column of its own, so that the hash is taken once
        .withColumn("_times", F.when(F.col("_replica") == 0, 1).otherwise(drawn))
        .groupBy(*by, "_replica")
        .agg(ratio(F.sum(F.col("_times") * F.col("_x")), F.sum("_times").cast("double")).alias("_m"))
    )
    resampled = F.when(F.col("_replica") > 0, F.col("_m"))
    tail = (1.0 - level) / 2.0
    return means.groupBy(*by).agg(
        tidy(F.max(F.when(F.col("_replica") == 0, F.col("_m")))).alias("mean"),
        F.count(resampled).alias("replicas"),
        tidy(F.percentile(resampled, F.lit(tail))).alias("low"),
        tidy(F.percentile(resampled, F.lit(1.0 - tail))).alias("high"),
    )


def _share(digest: Column, place: int) -> Column:
    """Eight hexadecimal digits of a digest as a number from 0 to below 1."""
    return F.conv(F.substring(digest, place, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def stationary_draws(days: DataFrame, replicas: int = 200, mean_block: float = 20.0, seed: str = "") -> DataFrame:
    """``(replica, d, times)``: how often each replica of a stationary bootstrap draws each day.

    A replica is a walk over all days in order, beginning anew at the end.  At
    each step it jumps to a random day with probability 1 / ``mean_block`` and
    else goes on to the next day, so that blocks have geometric length and
    dependence from day to day is kept (Politis and Romano).  Jumps come from a
    hash of replica and step; one window per replica, of as many rows as there
    are days, carries the last jump on.  Replica 0 draws every day once.

    All series share the draws, so dependence between them is kept too.
    """
    calendar = days.select("d").distinct().filter("d is not null")
    # One row per date: numbering them in one task is bounded by the calendar.
    numbered = settle(calendar.select("d", (F.row_number().over(Window.orderBy("d")) - 1).alias("_i")), "bootstrap-days")
    n = numbered.count()
    tasks = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.md5(F.concat(F.lit(seed), F.col("replica").cast("string"), F.lit(":"), F.col("_i").cast("string")))
    steps = numbered.repartition(tasks, "_i").select("_i", F.explode(F.sequence(F.lit(1), F.lit(replicas))).alias("replica"))
    steps = steps.withColumn("_h", digest).withColumn(
        "_jump", F.when((F.col("_i") == 0) | (_share(F.col("_h"), 1) < F.lit(1.0 / mean_block)), F.floor(_share(F.col("_h"), 9) * F.lit(n)) - F.col("_i")))
    so_far = Window.partitionBy("replica").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    drawn = steps.select("replica", ((F.last("_jump", ignorenulls=True).over(so_far) + F.col("_i")) % F.lit(max(n, 1))).cast("int").alias("_i"))
    counts = drawn.groupBy("replica", "_i").agg(F.count(F.lit(1)).alias("times"))
    once = numbered.select(F.lit(0).alias("replica"), "d", F.lit(1).cast("long").alias("times"))
    return counts.join(numbered, "_i").select("replica", "d", "times").unionByName(once)


def replica_means(df: DataFrame, value: str, by: list[str], draws: DataFrame) -> DataFrame:
    """``(by, replica, mean)``: the mean of each series in each replica; a day without a value is left out."""
    known_rows = df.filter(known(value).isNotNull()).select(*by, "d", F.col(value).alias("_x"))
    drawn = known_rows.join(draws, "d")
    return drawn.groupBy(*by, "replica").agg(ratio(F.sum(F.col("times") * F.col("_x")), F.sum("times").cast("double")).alias("mean"))


def stationary_bootstrap(
    df: DataFrame, value: str, by: list[str], replicas: int = 200, mean_block: float = 20.0, level: float = 0.95, seed: str = ""
) -> DataFrame:
    """Mean of a daily series with standard error and percentile interval from a stationary bootstrap.

    Unlike ``bootstrap_mean`` it does not take days as independent: a series
    whose neighbours are alike gets a wider interval.
    """
    rows = settle(df.filter(known(value).isNotNull()).select(*by, "d", value), "bootstrap-rows")  # read three times
    means = replica_means(rows, value, by, stationary_draws(rows, replicas, mean_block, seed))
    resampled = F.when(F.col("replica") > 0, F.col("mean"))
    tail = (1.0 - level) / 2.0
    return means.groupBy(*by).agg(
        tidy(F.max(F.when(F.col("replica") == 0, F.col("mean")))).alias("mean"),
        F.count(resampled).alias("replicas"),
        tidy(F.stddev_samp(resampled)).alias("std_error"),
        tidy(F.percentile(resampled, F.lit(tail))).alias("low"),
        tidy(F.percentile(resampled, F.lit(1.0 - tail))).alias("high"),
    )


def step_down(
    df: DataFrame, value: str, series: str, replicas: int = 500, mean_block: float = 20.0, level: float = 0.05, seed: str = ""
) -> DataFrame:
    """Which series have a mean other than 0, tested together under dependence (Romano and Wolf).

    ``t_value`` is the mean over its bootstrap standard error; a replica's is
    that of its mean's distance from the mean.  Series are put in order of the
    size of their t value.  The p value of one compares it with the largest
    value that it and all series after it take within the same replica, so the
    dependence between series counts; p values then never fall along the order.

    The series of one replica meet in one task, two numbers each.  A series of
    no spread has no t value and is left out.
    """
    rows = settle(df.filter(known(value).isNotNull()).select(series, "d", value), "bootstrap-rows")  # read three times
    means = settle(replica_means(rows, value, [series], stationary_draws(rows, replicas, mean_block, seed)), "step-down-means")
    facts = means.groupBy(series).agg(
        F.max(F.when(F.col("replica") == 0, F.col("mean"))).alias("_mean"),
        F.stddev_samp(F.when(F.col("replica") > 0, F.col("mean"))).alias("_error"))
    # Two places more than is shown decide the order, so that noise of sums cannot.
    facts = facts.withColumn("_t", tidy(ratio("_mean", "_error"), 8)).filter("_error > 0")
    falling = Window.orderBy(F.abs("_t").desc(), series)
    facts = settle(facts.withColumn("_place", F.row_number().over(falling)), "step-down-facts")  # a row for each series
    away = means.filter("replica > 0").join(facts, series).select(
        series, "replica", "_place", F.abs("_t").alias("_size"), tidy(F.abs(F.col("mean") - F.col("_mean")) / F.col("_error"), 8).alias("_away"))
    onward = Window.partitionBy("replica").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    reached = away.withColumn("_largest", F.max("_away").over(onward)).groupBy(series).agg(
        F.count(F.when(F.col("_largest") >= F.col("_size"), 1)).alias("_reached"), F.count(F.lit(1)).alias("_replicas"))
    p = (F.col("_reached") + 1) / (F.col("_replicas") + 1)
    along = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    tested = facts.join(reached.withColumn("_p", p), series).withColumn("_p", F.max("_p").over(along))
    return tested.select(
        series, tidy("_mean", 9).alias("mean"), tidy("_t", 4).alias("t_value"), tidy("_p").alias("p_adjusted"), (F.col("_p") <= level).alias("kept"))


FEW_PAIRS = 100  # up to so many one aggregation is the shortest way


def signal_correlations(panel: DataFrame, signals: list[str]) -> DataFrame:
    """Correlation of every two signal columns over all assets and days, from one scan of the panel.

    No rows are paired.  A few signals take one aggregation; for many, all pairs
    are found at once by products of blocks of columns (``gram``).
    """
    pairs = list(combinations(signals, 2))
    if len(pairs) > FEW_PAIRS:
        names = F.array(*[F.lit(s) for s in signals])
        found = pair_moments(panel, signals)
        return found.select(F.get(names, F.col("a")).alias("signal_a"), F.get(names, F.col("b")).alias("signal_b"), tidy("correlation").alias("correlation"))
    terms = panel.agg(*[correlation(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), tidy(f"_c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])
    return terms.select(F.explode(rows).alias("_r")).select("_r.*")


def benjamini_hochberg(
    tests: DataFrame, p: str, tie: str, level: float = 0.1, rows: int | None = None, slices: int | None = None
) -> DataFrame:
    """Adjusted p value ``q`` of each test and whether it is ``kept`` at the false discovery rate ``level``.

    ``rows`` is the measured number of tests; left out, they are counted.
    Beyond what fits one task, or if ``slices`` are asked for, both the places
    and the running minimum from the end are found slice by slice.  Tests with
    a NULL p are left out.
    """
    one = tests.filter(F.col(p).isNotNull()).withColumn("_all", F.lit(0))
    slices = slices_for(one, ["_all"], rows, slices)
    rows = 0 if slices is None else rows  # measured once
    placed = positions(one, ["_all"], p, tie, rows, "_pos", "_n", slices)
    placed = placed.withColumn("_q", F.col(p) * F.col("_n") / F.col("_pos"))
    if slices is None:
        onward = Window.partitionBy("_all").orderBy("_pos").rowsBetween(0, Window.unboundedFollowing)
        least = placed.withColumn("_least", F.min("_q").over(onward))
    else:
        placed = slice_in_order(placed, ["_all"], p, tie, slices)
        keys = ["_all", "_major", "_minor"]
        later = Window.partitionBy("_all").orderBy("_major", "_minor").rowsBetween(1, Window.unboundedFollowing)
        lows = placed.groupBy(*keys).agg(F.min("_q").alias("_low"))
        lows = lows.select(*keys, F.min("_low").over(later).alias("_later"))
        inside = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(0, Window.unboundedFollowing)
        least = attach(placed.withColumn("_near", F.min("_q").over(inside)), lows, keys)
        least = least.withColumn("_least", F.least("_near", "_later")).drop("_near", "_later", "_major", "_minor")
    q = F.least(F.col("_least"), F.lit(1.0))
    return least.withColumn("q", q).withColumn("kept", q <= level).drop("_all", "_pos", "_n", "_q", "_least")
