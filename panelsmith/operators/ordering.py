"""Positions, ranks and quantiles within groups of any size.

A group that fits one task is ordered by a plain window; its size is measured
by one count if the caller does not know it.  A larger one is cut into slices
that are contiguous in the order; each slice is ordered by itself and shifted by
the total of the slices before it.  Ranks take ranges of (group, value) for slices,
which hold many small groups or a part of a large one.  Both ways give the same
numbers, and ``slices`` asks for the second whatever the size.  A group that
lies whole in one such range is ranked there by every column at once; only groups that
an end of a range cuts are placed by their values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelsmith.functions.numeric import ratio
from panelsmith.storage import settle

ONE_TASK_ROWS = 1_000_000
PLACED_ROWS = 500_000  # rows of a task where several groups are placed together
FEW_TASKS = 8  # at least, as far as a shuffle has as many
SLICES = 64  # at least; more where the largest group needs them
CUT_ACCURACY = 2_000
SEEN = 64  # rows that a sample is expected to hold of a value that fills a task
LANE_PIECES = 4  # ranges in a lane of groups laid end to end


def fits_one_task(group_rows: int | None) -> bool:
    """Whether the largest group, as measured by the caller, is small enough to sort in one task."""
    return group_rows is not None and group_rows <= ONE_TASK_ROWS


def place(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Bring rows of equal keys together, in as many tasks as ``rows``, what they are spread over, ask for.

    Without a number of tasks adaptive execution joins them by their compressed
    bytes, which says little of the rows that they are spread over and sorted.
    """
    few = min(FEW_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(few, -(-rows // PLACED_ROWS)), *keys)


def measured(df: DataFrame, by: list[str], group_rows: int | None) -> int:
    """The rows of the largest group: as given, else counted, partly where the rows are read."""
    if group_rows is not None:
        return group_rows
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def slice_count(df: DataFrame, by: list[str], group_rows: int | None) -> int:
    """Slices such that a slice of the largest group fits a task four times over; measured if its size is unknown."""
    return max(SLICES, -(-4 * measured(df, by, group_rows) // ONE_TASK_ROWS))


def slices_for(df: DataFrame, by: list[str], group_rows: int | None, slices: int | None) -> int | None:
    """How many slices to cut groups into: those asked for, None if the largest group fits one task."""
    if slices is not None:
        return slices
    group_rows = measured(df, by, group_rows)
    return None if fits_one_task(group_rows) else slice_count(df, by, group_rows)


def attach(df: DataFrame, facts: DataFrame, keys: list[str], null_keys: bool = True) -> DataFrame:
    """Add the columns of ``facts``, which has one row per key, NULL keys included.

    Where no key is NULL, ``null_keys=False`` lets the join use a placing by key that is there already.

    No hint is given: adaptive execution broadcasts ``facts`` when it is
    measured to be small, and otherwise splits the hot keys of ``df``.
    """
    if not null_keys:
        return df.join(facts, keys, "left")
    new = [c for c in facts.columns if c not in keys]
    renamed = facts.select([F.col(k).alias(f"_key_{k}") for k in keys] + new)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(renamed, match, "left").drop(*[f"_key_{k}" for k in keys])


def _cuts(x: str, slices: int) -> Column:
    spots = [i / slices for i in range(1, slices)]
    return F.coalesce(F.array_distinct(F.percentile_approx(x, spots, max(CUT_ACCURACY, 20 * slices))), F.expr("array()"))


def _with_cuts(df: DataFrame, by: list[str], values: dict[str, str], slices: int) -> DataFrame:
    """The cuts of each group for columns, under the names given."""
    found = df.groupBy(*by).agg(*[_cuts(v, slices).alias(name) for name, v in values.items()])
    return found.select(*by, *[chunked(F.col(name), cut_width(slices)).alias(name) for name in values])


def cut_width(cuts: int) -> int:
    """Cuts are looked up in two steps, in chunks of about the square root of their number."""
    return max(1, math.isqrt(cuts))


def chunked(cuts: Column, width: int) -> Column:
    """Sorted cuts as chunks of ``width``, so that a lookup need not look at all of them."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(cuts) / width).cast("int") - 1))
    chunks = F.transform(starts, lambda i: F.slice(cuts, i * width + 1, width))
    return F.struct(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1)).alias("lasts"), chunks.alias("chunks"), F.size(cuts).alias("n"))


def cuts_below(cuts: str, x: Column, width: int) -> Column:
    """How many cuts are smaller than ``x``: whole chunks first, then within one chunk."""
    whole = F.size(F.filter(F.col(cuts)["lasts"], lambda cut: cut < x))
    chunk = F.coalesce(F.get(F.col(cuts)["chunks"], whole), F.expr("array()"))
    return F.least(whole * width, F.col(cuts)["n"]) + F.size(F.filter(chunk, lambda cut: cut < x))  # the last chunk may be shorter


def _is_cut(cuts: str, x: Column) -> Column:
    whole = F.size(F.filter(F.col(cuts)["lasts"], lambda cut: cut < x))
    return F.coalesce(F.array_contains(F.get(F.col(cuts)["chunks"], whole), x), F.lit(False))


def _slice_number(cuts: str, x: Column, slices: int) -> Column:
    """Odd for a value that is itself a cut, even between cuts, largest for NULL."""
    number = 2 * cuts_below(cuts, x, cut_width(slices)) + _is_cut(cuts, x).cast("int")
    return F.when(x.isNull(), F.lit(2 * slices)).otherwise(number)


def slice_in_order(df: DataFrame, by: list[str], value: str, tie: str, slices: int) -> DataFrame:
    """Add ``_major`` and ``_minor``, whose order within a group follows (value, tie), NULL values last.

    A value that is itself a cut, and so may repeat very often, gets a slice
    of its own, which is cut again by ``tie``.  The result is written, because
    several passes must see the same cuts.
    """
    cuts = _with_cuts(df, by, {"_cuts": value, "_tie_cuts": tie}, slices)
    x = F.col(value)
    marked = attach(df, cuts, by).withColumn("_major", _slice_number("_cuts", x, slices))
    alone = x.isNull() | _is_cut("_cuts", x)
    marked = marked.withColumn("_minor", F.when(alone, cuts_below("_tie_cuts", F.col(tie), cut_width(slices))).otherwise(0))
    return settle(marked.drop("_cuts", "_tie_cuts"), "slices")


def _positions_by_slice(df: DataFrame, by: list[str], value: str, tie: str, out: str, total: str, slices: int) -> DataFrame:
    """Only the counts of the slices, a few thousand per group at most, meet in one task."""
    marked = slice_in_order(df, by, value, tie, slices)
    keys = [*by, "_major", "_minor"]
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_major", "_minor").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    shifts = counts.select(
        *keys,
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_count").over(group).alias(total),
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie))
    return (
        attach(marked.withColumn("_place", place), shifts, keys)
        .withColumn(out, F.col("_place") + F.col("_before"))
        .drop("_place", "_before", "_major", "_minor")
    )


def positions(
    df: DataFrame, by: list[str], value: str, tie: str, group_rows: int | None = None,
    out: str = "pos", total: str = "n", slices: int | None = None,
) -> DataFrame:
    """Place 1..n of each row in its group by (value, tie), NULL values last.

    ``tie`` must be numeric and tell the rows of a group apart.
    """
    slices = slices_for(df, by, group_rows, slices)
    if slices is not None:
        return _positions_by_slice(df, by, value, tie, out, total, slices)
    group = Window.partitionBy(*by)
    order = group.orderBy(F.col(value).asc_nulls_last(), tie)
    return df.withColumn(out, F.row_number().over(order).cast("long")).withColumn(
        total, F.count(F.lit(1)).over(group)
    )


def _mean_rank(order: WindowSpec) -> Column:
    """Mean of the first and the last place that equal values take."""
    through = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, 0))
    return (F.rank().over(order) + through) / F.lit(2.0)


def average_ranks(
    df: DataFrame, by: list[str], ranks: dict[str, str], group_rows: int | None = None, slices: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Rank each column of ``ranks`` within its group into the column it names.

    Equal values share their mean rank; NULL has none.  Slices make the rows once to count groups and once to
    write them.  ``stored`` says that they come straight from a written table; only rows of cut groups are written then.
    """
    slices = slices_for(df, by, group_rows, slices)
    if slices is None:
        return _ranks_by_window(df, by, ranks)
    groups, pieces = cut_groups(df, by, slices)
    marked = attach(df, groups, by)
    whole, cut = parted(marked if stored else settle(marked, "ranks"))
    ranked = _ranks_by_window(whole.repartition(pieces, *by), by, ranks)
    if groups.isEmpty():
        return ranked
    cut = cut.drop(*by)
    placed = _ranks_by_piece(settle(cut, "ranks") if stored else cut, ranks, slices)
    return ranked.unionByName(attach(placed, groups, ["_group"], null_keys=False).drop("_group"))


def _ranks_by_window(df: DataFrame, by: list[str], ranks: dict[str, str]) -> DataFrame:
    for value, out in ranks.items():
        order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
        df = df.withColumn(out, F.when(F.col(value).isNotNull(), _mean_rank(order)))
    return df


def cut_groups(df: DataFrame, by: list[str], slices: int) -> tuple[DataFrame, int]:
    """Groups that do not lie whole in one of many ranges of rows, numbered in ``_group``, and how many ranges there are.

    Groups are laid end to end and cut into ranges of equal size, ``slices`` at least and more where a task
    asks for it.  So a group larger than a range is among them, and they are no more than ranges.
    Groups lie in lanes of a few ranges, so that no task sees many of them.
    """
    sizes = settle(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    pieces = max(slices, -(-total // PLACED_ROWS))
    each = F.lit(max(1, -(-total // pieces)))
    lane = Window.partitionBy("_lane").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    laid = sizes.withColumn("_lane", F.pmod(F.hash(*by), F.lit(max(1, pieces // LANE_PIECES)))).withColumn("_end", F.sum("_n").over(lane))
    cut = laid.filter(F.floor((F.col("_end") - F.col("_n")) / each) < F.floor((F.col("_end") - 1) / each))
    return settle(cut.select(*by, F.row_number().over(Window.orderBy(*by)).alias("_group")), "groups-cut"), pieces


def parted(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose group has no number in ``_group``, and those whose group has one."""
    return marked.filter(F.col("_group").isNull()).drop("_group"), marked.filter(F.col("_group").isNotNull())


def _coarse(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises, nearly as fine as ``x``; NULL for NULL.

    A placing by it serves windows too, which one by doubles does not: windows normalise them.
    """
    x = x.cast("double")
    fine = F.floor(F.signum(x) * F.log1p(F.abs(x) * F.lit(1e12)) * F.lit(1e13))
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(fine)


def _sort_key(group: str, cell: str) -> Column:
    """A whole number of the group's number and the first digits of a cell: two rows are mostly told apart by it alone.

    It comes first in a task's order, as Spark compares the first eight bytes of a row's place before anything else.
    Rows of two groups never mix in that order.
    """
    digits = F.coalesce(F.shiftright(cell, 22) + F.lit(1 << 31), F.lit(0).cast("long"))
    return F.shiftleft(F.col(group).cast("long"), 32).bitwiseOR(F.greatest(F.lit(0), F.least(digits, F.lit((1 << 32) - 1))))


def _frequent(rows: DataFrame, value: str, cell: list[str], each: int) -> DataFrame | None:
    """Cells of one value alone that may fill a piece of ``each`` rows; None if there are none.

    A sample says where to look, and only there rows are counted.  What it
    overlooks or names in vain changes where rows lie, not what comes out.
    """
    share = min(1.0, SEEN / each)
    seen = rows.sample(share, 1).groupBy(*cell).agg(F.count(F.lit(1)).alias("_seen")).filter(F.col("_seen") >= max(2.0, share * each / 2))
    seen = settle(seen.select(*cell, F.lit(True).alias("_often")), "ranks-often")
    if seen.isEmpty():
        return None
    values = attach(rows, seen, cell).filter("_often").groupBy(*cell).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    alone = values.filter(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*cell, F.lit(True).alias("_often"))
    return settle(alone, "ranks-alone")


def _ranks_by_piece(source: DataFrame, ranks: dict[str, str], slices: int) -> DataFrame:
    """Ranks by one placing in order for each column, within the groups numbered in ``_group``, of written rows.

    Rows are placed by ranges of (group, value) and sorted, so a row's number in
    its task gives its rank but for the rows of its group in earlier tasks: one
    number for each task and group that lies in it.
    """
    rows, total = source, source.count()
    pieces = max(slices, -(-total // PLACED_ROWS))
    found = []
    for i, (value, out) in enumerate(ranks.items()):
        piece, near = f"_piece_{i}", f"_near_{i}"
        coarse = _coarse(F.col(value)).alias("_cell")
        cell = ["_group", "_cell"]
        often = _frequent(source.select("_group", value, coarse), value, cell, -(-total // pieces))
        rows, order = rows.select("*", coarse), cell
        if often is not None:
            rows = attach(rows, often, cell).withColumn("_salt", F.when(F.col("_often"), F.floor(F.rand(1) * pieces).cast("int")).otherwise(-1))
            order = [*order, "_salt"]
        dealt = rows.repartitionByRange(pieces, *order).withColumn("_key", _sort_key("_group", "_cell"))
        order = ["_key", *order]
        placed = dealt.sortWithinPartitions(*order, value).select(
            "*", F.spark_partition_id().alias(piece), (F.monotonically_increasing_id() % (1 << 33)).alias("_place"))
        same, known = Window.partitionBy(*order).orderBy(value), F.col(value).isNotNull()
        place = F.col("_place") + 1 - F.row_number().over(same) + _mean_rank(same)
        # Written, because several passes must see the same places.
        written = settle(placed.withColumn(near, F.when(known, place)).drop("_key", "_cell", "_salt"), "ranks")

        held = written.filter(known).groupBy("_group", piece).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
        earlier = Window.partitionBy("_group").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
        before = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_before")
        shifts = settle(held.select("_group", piece, before), "ranks-before")
        middle = None
        if often is not None:  # such a value's rows lie anywhere among its places
            spots = attach(written.filter(F.col("_often") & known), shifts, ["_group", piece]).withColumn("_spot", F.col("_before") + F.col("_place") + 1)
            middle = settle(spots.groupBy("_group", value).agg(((F.min("_spot") + F.max("_spot")) / F.lit(2.0)).alias("_middle")), "ranks-middle")
        found.append((value, out, piece, near, shifts, middle))
        rows = written.drop("_place", "_often")
    for value, out, piece, near, shifts, middle in found:
        rows = attach(rows, shifts, ["_group", piece]).withColumn(out, F.col("_before") + F.col(near)).drop("_before", piece, near)
        if middle is not None:
            rows = attach(rows, middle, ["_group", value]).withColumn(out, F.coalesce("_middle", out)).drop("_middle")
    return rows


def group_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float],
    tie: str, group_rows: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Exact quantiles of each group, linear between neighbours: one row per group."""
    known = df.filter(F.col(value).isNotNull())
    slices = slices_for(known, by, group_rows, slices)
    if slices is None:
        return known.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in probs.items()])
    placed = positions(known.select(*by, value, tie), by, value, tie, None, "_pos", "_n", slices)
    picks = []
    for name, p in probs.items():
        spot = (F.col("_n") - 1) * F.lit(float(p))
        picks += [
            F.max(F.when(F.col("_pos") == F.floor(spot) + 1, F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(F.col("_pos") == F.ceil(spot) + 1, F.col(value))).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_part_{name}"),
        ]
    found = placed.groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in probs
        ],
    )


def attach_group_stats(
    df: DataFrame, by: list[str], stats: dict[str, Column], group_rows: int | None = None
) -> DataFrame:
    """Add aggregates of the group to each of its rows: by a window if its known size fits one task, else by a join.

    An unknown size is not measured here, since the join costs little more than the count.
    The aggregates are written first: what is seen to be small is then broadcast, and no row is moved.
    """
    if fits_one_task(group_rows):
        group = Window.partitionBy(*by)
        return df.select("*", *[agg.over(group).alias(name) for name, agg in stats.items()])
    return attach(df, settle(df.groupBy(*by).agg(*[agg.alias(name) for name, agg in stats.items()]), "group-stats"), by)


def percent_rank_from(pos: Column, n: Column) -> Column:
    return F.when(n > 1, ratio((pos - 1).cast("double"), (n - 1).cast("double"))).otherwise(F.lit(0.0))


def bucket_from(pos: Column, n: Column, buckets: int) -> Column:
    """Bucket 1..buckets of a place, the first ``n % buckets`` ones holding one row more."""
    small = F.floor(n / F.lit(buckets))
    large_ones = n % buckets
    in_large = large_ones * (small + 1)
    late = large_ones + F.ceil(F.try_divide((pos - in_large).cast("double"), small.cast("double")))
    return F.when(pos <= in_large, F.ceil(pos / (small + 1))).otherwise(late).cast("int")
