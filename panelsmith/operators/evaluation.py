"""Tests of signals against forward returns.

Signals are evaluated in long form, ``(signal, asset, d, x)`` plus targets, so
that many are tested in one pass; see ``long_form``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions.numeric import correlation, known, ratio, tidy
from panelsmith.operators.ordering import PLACED_ROWS, attach, average_ranks, cut_groups, parted, place
from panelsmith.operators.crosssection import bucket
from panelsmith.operators.timeseries import past

# Places kept before values are ranked, so that summation noise cannot break ties.
RANK_PLACES = 9
MIN_ASSETS = 5
SIGNAL_DAY = ["signal", "d"]


def forward_returns(panel: DataFrame, horizons: list[int], px: str = "px") -> DataFrame:
    """Add ``fwd_<h>``, the return over the asset's next h rows.  Looks ahead by design: a target, not a signal."""
    return panel.select(
        "*", *[(ratio(F.lead(px, h).over(past()), px) - 1).alias(f"fwd_{h}") for h in horizons]
    )


def long_form(panel: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    """One row per signal, asset and day.

    ``stack`` leaves rows where they are, so a placing by day made before it
    still serves everything done per signal and day; ``unpivot`` would lose it.
    """
    pairs = [part for s in signals for part in (F.lit(s), F.col(s))]
    return panel.select(*keep, F.stack(F.lit(len(signals)), *pairs).alias("signal", "x"))


def daily_ic(
    df: DataFrame, x: str = "x", target: str = "fwd_1", by: list[str] = SIGNAL_DAY,
    min_assets: int = MIN_ASSETS, group_rows: int | None = None, slices: int | None = None, stored: bool = False,
) -> DataFrame:
    """Rank IC and Pearson IC of each day with enough complete pairs; NaN counts as missing.

    ``stored`` says that ``df`` only picks and spreads the columns of a written table, so slices read it again.
    """
    pairs = df.filter(known(x).isNotNull() & known(target).isNotNull()).select(
        *by, tidy(x, RANK_PLACES).alias("_x"), tidy(target, RANK_PLACES).alias("_y")
    )
    ranked = average_ranks(pairs, by, {"_x": "_rank_x", "_y": "_rank_y"}, group_rows, slices, stored)
    return (
        ranked.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("assets"),
            correlation("_rank_x", "_rank_y").alias("rank_ic"),
            correlation("_x", "_y").alias("ic"),
        )
        .filter(F.col("assets") >= min_assets)
    )


def daily_ic_in_slices(
    wide: DataFrame, spread: Callable[[DataFrame], DataFrame], rows: int, slices: int, **how
) -> DataFrame:
    """``daily_ic`` of what ``spread`` makes of a written wide table, ``rows`` of them, for days of any size.

    Days that lie whole in one range of rows are placed before they are spread, as wide rows take less
    room on disk.  Days that the end of a range cuts are spread first and ranked in slices.
    """
    days, _ = cut_groups(wide, ["d"], slices)
    whole, cut = parted(attach(wide, days, ["d"]))
    ics = daily_ic(spread(place(whole, ["d"], rows)), group_rows=PLACED_ROWS, **how)
    return ics if days.isEmpty() else ics.unionByName(daily_ic(spread(cut), slices=slices, stored=True, **how))


def ic_summary(
    ics: DataFrame, ic: str = "rank_ic", by: list[str] = ["signal"], span: str | None = None, longest: int = 1
) -> DataFrame:
    """Mean, deviation, ratio, t value and hit rate of a daily IC series.

    ``span`` names a column with the number of rows that targets look ahead,
    ``longest`` at most.  Such values overlap from day to day; ``t_overlap``
    allows for that by Newey-West with ``span - 1`` lags, ``t_value`` does not.
    It is NULL where the estimated variance is not positive.
    """
    known_ics, spread = ics.filter(F.col(ic).isNotNull()), F.count(F.lit(1))
    if span is not None:
        series = Window.partitionBy(*by)
        known_ics = known_ics.withColumn("_e", F.col(ic) - F.avg(ic).over(series))
        lags = range(1, longest)
        known_ics = known_ics.select("*", *[F.lag("_e", k).over(series.orderBy("d")).alias(f"_e{k}") for k in lags])
        spread = F.sum(F.col("_e") * F.col("_e"))
        for k in lags:
            weight = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(float(k)) / F.col(span))
            spread = spread + F.lit(2.0) * F.coalesce(F.sum(weight * F.col("_e") * F.col(f"_e{k}")), F.lit(0.0))
    stats = known_ics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(ic).alias("_mean"),
        F.stddev_samp(ic).alias("_std"),
        F.avg((tidy(ic, RANK_PLACES) > 0).cast("double")).alias("_hits"),
        spread.alias("_spread"),
    )
    per_day = ratio("_mean", "_std")
    error = F.sqrt(F.when(F.col("_spread") > 0, F.col("_spread"))) / F.col("days")
    return stats.select(
        *by, "days",
        tidy("_mean").alias("mean_ic"), tidy("_std").alias("std_ic"), tidy(per_day).alias("ic_ratio"),
        tidy(per_day * F.sqrt(F.col("days").cast("double"))).alias("t_value"), tidy("_hits").alias("hit_rate"),
        *([] if span is None else [tidy(ratio("_mean", error)).alias("t_overlap")]),
    )


def ic_decay(
    df: DataFrame, horizons: list[int], x: str = "x", by: list[str] = SIGNAL_DAY, group_rows: int | None = None
) -> DataFrame:
    """IC summary by horizon and the columns of ``by`` other than the day, from targets ``fwd_<h>`` in one pass."""
    targets = F.explode(
        F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons])
    )
    spread = df.select(*by, x, targets.alias("_t")).select(*by, x, "_t.horizon", "_t.fwd")
    ics = daily_ic(spread, x, "fwd", [*by, "horizon"], group_rows=group_rows)
    series = [*[c for c in by if c != "d"], "horizon"]
    return ic_summary(ics, by=series, span="horizon", longest=max(horizons))


def quantile_returns(
    df: DataFrame, buckets: int = 5, x: str = "x", target: str = "fwd_1",
    by: list[str] = SIGNAL_DAY, group_rows: int | None = None,
) -> DataFrame:
    """Mean forward return per day and bucket of the signal, one column per bucket."""
    complete = df.filter(known(target).isNotNull()).withColumn(x, tidy(known(x), RANK_PLACES))
    placed = bucket(complete, x, "_bucket", buckets, by, group_rows)
    return placed.groupBy(*by).agg(
        *[F.avg(F.when(F.col("_bucket") == b, F.col(target))).alias(f"q{b}") for b in range(1, buckets + 1)]
    )


def quantile_spread(daily: DataFrame, buckets: int = 5, by: list[str] = ["signal"]) -> DataFrame:
    """Top minus bottom bucket, and how monotone the bucket means are, over all days.

    Monotonicity is the share of neighbouring buckets whose means rise.
    """
    names = [f"q{b}" for b in range(1, buckets + 1)]
    top, bottom = F.col(names[-1]), F.col(names[0])
    means = daily.groupBy(*by).agg(
        F.count(top - bottom).alias("days"), F.avg(top - bottom).alias("_spread"),
        *[F.avg(n).alias(n) for n in names],
    )
    rises = sum(((F.col(b) > F.col(a)).cast("double") for a, b in zip(names, names[1:])), F.lit(0.0))
    return means.select(
        *by, "days", tidy("_spread").alias("spread"), *[tidy(n).alias(n) for n in names],
        tidy(rises / F.lit(float(buckets - 1))).alias("monotone"),
    )
