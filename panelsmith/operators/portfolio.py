"""Portfolio arithmetic on long-form signals, without event-by-event simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions.numeric import ratio, tidy
from panelsmith.operators.crosssection import demean, scale_to_gross
from panelsmith.operators.evaluation import SIGNAL_DAY
from panelsmith.operators.ordering import attach, place
from panelsmith.storage import settle

TRADING_DAYS, CALENDAR_DAYS = 252, 365


def weights(df: DataFrame, x: str = "x", by: list[str] = SIGNAL_DAY, group_rows: int | None = None) -> DataFrame:
    """Dollar-neutral weights ``w`` with unit gross exposure."""
    centred = demean(df.filter(F.col(x).isNotNull()), x, "_centred", by, group_rows)
    return scale_to_gross(centred, "_centred", "w", by, group_rows=group_rows).drop("_centred")


def turnover(held: DataFrame, book: str = "signal", rate: float = 0.001, days: DataFrame | None = None) -> DataFrame:
    """Sum of absolute weight changes per day, and its linear cost.

    Each change is against the previous day of the book.  A position that is
    gone on the book's next day is sold on that day, and is charged then; on a
    filled calendar that is the end of the asset and never a gap in the data.
    ``days``, the days of each book, spares a pass over ``held``.
    """
    days = held.select(book, "d").distinct() if days is None else days
    of_book = Window.partitionBy(book).orderBy("d")
    days = days.select(book, "d", F.lag("d").over(of_book).alias("_before"), F.lead("d").over(of_book).alias("_after"))
    mine = Window.partitionBy(book, "asset").orderBy("d")
    rows = attach(held.select(book, "asset", "d", F.coalesce("w", F.lit(0.0)).alias("w")), days, [book, "d"], null_keys=False).select(
        book, "d", "w", "_before", "_after",
        F.lag("d").over(mine).alias("_last"), F.lag("w").over(mine).alias("_held"), F.lead("d").over(mine).alias("_next"),
    )
    bought = F.abs(F.col("w") - F.when(F.col("_last") == F.col("_before"), F.col("_held")).otherwise(0.0))
    gone = F.col("_after").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("_after")))
    trades = F.array(
        F.struct(F.col("d").alias("d"), bought.alias("size")),
        F.when(gone, F.struct(F.col("_after").alias("d"), F.abs("w").alias("size"))),
    )
    return (
        rows.select(book, F.explode(trades).alias("_trade")).filter(F.col("_trade").isNotNull())
        .groupBy(book, F.col("_trade.d").alias("d"))
        .agg(F.sum("_trade.size").alias("turnover"))
        .withColumn("cost", F.col("turnover") * F.lit(rate))
    )


def day_stats(wide: DataFrame, books: list[str]) -> DataFrame:
    """``(d, _mean_<book>, _gross_<book>)``: each day's mean and the absolute sum around it, for many books at once.

    Two aggregations, partly formed where the rows are read; the result has one
    row a day and is written, so that it can be broadcast to rows wherever they lie.
    """
    means = settle(wide.groupBy("d").agg(*[F.avg(b).alias(f"_mean_{b}") for b in books]), "book-means")
    centred = attach(wide.select("d", *books), means, ["d"])
    gross = centred.groupBy("d").agg(*[F.sum(F.abs(F.col(b) - F.col(f"_mean_{b}"))).alias(f"_gross_{b}") for b in books])
    return settle(attach(means, gross, ["d"]), "book-stats")


def _weight(b: str) -> Column:
    """A book's weight from its signal and the day's numbers, NULL where there is no signal or nothing to scale by."""
    return ratio(F.col(b) - F.col(f"_mean_{b}"), f"_gross_{b}")


def weights_of_books(wide: DataFrame, books: list[str], keep: list[str]) -> DataFrame:
    """``(keep, signal, x, w)`` as ``weights`` gives them, for a signal column for each book; rows stay where they are."""
    rows = attach(wide.select(*dict.fromkeys([*keep, "d"]), *books), day_stats(wide, books), ["d"])
    parts = [part for b in books for part in (F.lit(b), F.col(b), _weight(b))]
    return rows.select(*keep, F.stack(F.lit(len(books)), *parts).alias("signal", "x", "w")).filter(F.col("x").isNotNull())


def returns_of_books(wide: DataFrame, books: list[str], target: str = "fwd_1") -> DataFrame:
    """``(signal, d, r)`` as ``daily_returns(weights(...))`` gives them; only sums by day are spread over the books."""
    rows = attach(wide.select("d", target, *books), day_stats(wide, books), ["d"])
    daily = rows.groupBy("d").agg(*[F.sum(_weight(b) * F.col(target)).alias(b) for b in books])
    parts = [part for b in books for part in (F.lit(b), F.col(b))]
    return daily.select("d", F.stack(F.lit(len(books)), *parts).alias("signal", "r")).filter(F.col("r").isNotNull()).select("signal", "d", "r")


def turnover_of_books(
    wide: DataFrame, books: list[str], rate: float = 0.001, group_rows: int | None = None, tie: str = "asset", rows: int | None = None,
) -> DataFrame:
    """Turnover and cost per book and day, as ``turnover(weights(...))`` gives them, for many books at once.

    ``wide`` has one row per asset and day and a signal column for each book,
    ``rows`` in all if that is known.  Rows stay wide: the asset's last weights
    are carried along once for all books, and only sums by day are spread over
    the books.  What is sold off is what was held on the book's day before less
    what of it is still held.

    Signals are moved, not weights: a signal kept over some days costs little
    to move, a weight differs every day.  ``group_rows`` decides nothing any
    more, as no day meets in a task.
    """
    signals = wide.select(tie, "d", *books)
    moved = signals.repartition(tie) if rows is None else place(signals, [tie], rows)
    held = attach(moved, day_stats(wide, books), ["d"])
    weight = lambda b: F.when(F.col(b).isNotNull(), F.coalesce(_weight(b), F.lit(0.0)))
    held = held.select(tie, "d", *[weight(b).alias(b) for b in books])

    # A row for each date: the last day before on which each book holds something.
    earlier = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    days = wide.groupBy("d").agg(*[F.max(F.col(b).isNotNull()).alias(b) for b in books])
    days = days.select("d", *[F.last(F.when(F.col(b), F.col("d")), ignorenulls=True).over(earlier).alias(f"_before_{b}") for b in books])
    days = settle(days, "book-days")

    before = Window.partitionBy(tie).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda b: F.last(F.when(F.col(b).isNotNull(), F.struct("d", F.col(b).alias("w"))), ignorenulls=True).over(before)
    rows = attach(held.select("d", *books, *[last(b).alias(f"_last_{b}") for b in books]), days, ["d"], null_keys=False)
    sums = []
    for b in books:
        kept = F.when(F.col(b).isNotNull() & (F.col(f"_last_{b}.d") == F.col(f"_before_{b}")), F.col(f"_last_{b}.w"))
        sums += [
            F.sum(F.abs(F.col(b) - F.coalesce(kept, F.lit(0.0)))).alias(f"_bought_{b}"),
            F.sum(F.abs(kept)).alias(f"_kept_{b}"), F.sum(F.abs(b)).alias(f"_gross_{b}"),
        ]
    daily = rows.groupBy("d").agg(*sums)
    parts = F.array(*[F.struct(
        F.lit(b).alias("signal"), *[F.col(f"_{name}_{b}").alias(name) for name in ("bought", "kept", "gross")]) for b in books])
    long = daily.select("d", F.explode(parts).alias("_b")).select("_b.*", "d").filter("bought IS NOT NULL")
    of_book = Window.partitionBy("signal").orderBy("d")
    sold = F.coalesce(F.lag("gross").over(of_book), F.lit(0.0)) - F.coalesce("kept", F.lit(0.0))
    return long.select("signal", "d", (F.col("bought") + sold).alias("turnover")).withColumn("cost", F.col("turnover") * F.lit(rate))


def daily_returns(held: DataFrame, target: str = "fwd_1", book: str = "signal") -> DataFrame:
    """Return of the book earned from each day to the next row of its assets: the next day on a filled calendar."""
    return (
        held.filter(F.col(target).isNotNull() & F.col("w").isNotNull())
        .groupBy(book, "d")
        .agg(F.sum(F.col("w") * F.col(target)).alias("r"))
    )


def performance(returns: DataFrame, book: str = "signal") -> DataFrame:
    """Compounded log wealth and drawdown of each book.

    A day that loses everything or more cannot be compounded; it is left out of
    the wealth and counted in ``wiped_days``.  One row per book and date, so a
    book's series is bounded by the calendar.
    """
    so_far = Window.partitionBy(book).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    usable = F.col("r") > -1
    wealth = returns.select(
        book, "d", "r",
        F.coalesce(F.sum(F.when(usable, F.log1p("r"))).over(so_far), F.lit(0.0)).alias("log_wealth"),
        F.count(F.when(~usable, 1)).over(so_far).alias("wiped_days"),
    )
    peak = F.greatest(F.max("log_wealth").over(so_far), F.lit(0.0))
    return wealth.withColumn("drawdown", F.exp(F.col("log_wealth") - peak) - 1)


def risk_summary(path: DataFrame, book: str = "signal", periods: int = TRADING_DAYS) -> DataFrame:
    """Annualised Sharpe ratio and volatility, skew, excess kurtosis and worst drawdown (population moments)."""
    stats = path.groupBy(book).agg(
        F.count("r").alias("days"), F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_std"),
        F.skewness("r").alias("_skew"), F.kurtosis("r").alias("_kurt"), F.min("drawdown").alias("_worst"),
    )
    year = F.sqrt(F.lit(float(periods)))
    return stats.select(
        book, "days", tidy("_mean").alias("mean_return"), tidy(F.col("_std") * year).alias("volatility"),
        tidy(ratio("_mean", "_std") * year).alias("sharpe"), tidy("_skew").alias("skew"),
        tidy("_kurt").alias("kurtosis"), tidy("_worst").alias("max_drawdown"),
    )
