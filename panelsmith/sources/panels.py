"""Panels built from the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.numeric import as_whole, from_whole, ratio

PANEL_COLUMNS = ["asset", "grp", "d", "px", "vol"]


def build_panel(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, asset: str = "supplier", places: int = 2) -> DataFrame:
    """Volume-weighted price and volume per asset and day.

    ``asset`` is "supplier" or "nation"; the group is the region.

    Amounts have at most ``places`` decimal places; one with more is an error.
    Sums run over whole numbers and do not depend on the order of the rows.
    They are partly formed where the lines are read and then meet by asset and
    day, so that an asset with a large share of all lines spreads over its days.
    """
    lines = lineitem.select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("d"),
        as_whole("l_extendedprice", places).alias("amount"),
        as_whole("l_quantity", places).alias("quantity"),
    )
    totals = [F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity")]
    homes = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", "n_nationkey", F.col("n_regionkey").alias("grp")
    )
    same_supplier = F.col("l_suppkey") == F.col("s_suppkey")
    if asset == "supplier":
        # Summed before the join: after it, the join's own partitioning by
        # supplier would be kept and hold a large supplier in one task.
        sums = lines.groupBy("l_suppkey", "d").agg(*totals).join(homes, same_supplier)
        sums = sums.withColumn("asset", F.col("l_suppkey"))
    elif asset == "nation":
        # Joined first: few nations, so the sums leave each task as few rows.
        placed = lines.join(homes, same_supplier)
        sums = placed.groupBy(F.col("n_nationkey").cast("long").alias("asset"), "grp", "d").agg(*totals)
    else:
        raise ValueError(f"asset must be 'supplier' or 'nation', not {asset!r}")
    vol = from_whole("quantity", places)
    return sums.select(
        "asset", "grp", "d", ratio(from_whole("amount", places), vol).alias("px"), vol.alias("vol")
    )
