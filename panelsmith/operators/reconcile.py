"""What differs between two versions of a panel, found by comparing hashes first and rows last.

A version has a tree of fingerprints: one for each day and range of assets, and
above them one for each day.  Versions are compared from the top; only rows of
branches that differ are read again and joined.  A tree can be kept with its
version, so that a version is scanned once however often it is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.incremental import within
from panelsmith.storage import settle

RANGES = 64  # branches of a day


def branch(asset: Column, ranges: int = RANGES) -> Column:
    return F.pmod(F.xxhash64(asset), F.lit(ranges)).cast("int")


def tree(panel: DataFrame, asset: str = "asset", day: str = "d", ranges: int = RANGES) -> DataFrame:
    """``(day, branch, n, one, other)``: the lowest level, written once; sums of it are the level above."""
    columns = [F.col(c) for c in sorted(panel.columns)]
    whole = "decimal(38,0)"
    leaves = panel.groupBy(F.col(day).alias("day"), branch(F.col(asset), ranges).alias("branch")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast(whole)).alias("one"), F.sum(F.xxhash64(F.lit(1), *columns).cast(whole)).alias("other"))
    return settle(leaves, "panel-tree")


def _differing(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    facts = ["n", "one", "other"]
    old = before.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in facts]).select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"_{c}" for c in facts])
    new = after.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in facts])
    match = [new[k].eqNullSafe(old[f"_{k}"]) for k in keys]
    both = new.withColumn("_new", F.lit(True)).join(old.withColumn("_old", F.lit(True)), match, "full_outer")
    same = F.col("_new") & F.col("_old")
    for c in facts:
        same = same & (F.col(c) == F.col(f"_{c}"))
    picked = [F.when(F.col("_new"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    return both.filter(~F.coalesce(same, F.lit(False))).select(*picked)


def differing_branches(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(day, branch)`` of two trees: days first, then the branches of days that differ."""
    days = settle(_differing(before, after, ["day"]), "differing-days")
    of = lambda leaves: leaves.join(days.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day")), "left_semi")
    return settle(_differing(of(before), of(after), ["day", "branch"]), "differing-branches")


def differences(
    before: DataFrame, after: DataFrame, columns: list[str], asset: str = "asset", day: str = "d", ranges: int = RANGES,
    trees: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``(asset, day, column, change, old, new)``: a row for each cell of ``columns`` that differs.

    ``change`` is "added" or "removed" for cells of rows that only one version
    has, else "changed".  NULL equals NULL, NaN equals NaN.  Both versions have
    at most one row per asset and day; a repeated one in a branch that differs
    is an error.  ``trees``, made by ``tree`` of the same columns and ranges,
    spare the scans of whole versions.
    """
    named = [asset, day, *columns]
    sides = [df.select(*named) for df in (before, after)]
    leaves = differing_branches(*(trees or [tree(df, asset, day, ranges) for df in sides]))
    days = [r[0] for r in leaves.select("day").distinct().collect()]  # at most one for each date
    near = within(F.col(day), sorted(d for d in days if d is not None))
    near = near | F.col(day).isNull() if None in days else near

    def rows(df: DataFrame, name: str) -> DataFrame:
        placed = df.filter(near).withColumn("_branch", branch(F.col(asset), ranges))
        placed = placed.join(leaves, placed[day].eqNullSafe(leaves["day"]) & (placed["_branch"] == leaves["branch"]), "left_semi")
        held = placed.groupBy(asset, day).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*columns)).alias("_row"))
        repeated = F.raise_error(F.concat(F.lit("repeated row: asset "), F.col(asset).cast("string"), F.lit(", "), F.col(day).cast("string")))
        checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(repeated.cast(held.schema["_row"].dataType))
        return held.select(F.col(asset).alias(f"_a_{name}"), F.col(day).alias(f"_d_{name}"), checked.alias(name))

    old, new = rows(sides[0], "old"), rows(sides[1], "new")
    both = old.join(new, F.col("_a_old").eqNullSafe(F.col("_a_new")) & F.col("_d_old").eqNullSafe(F.col("_d_new")), "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    kind = sides[1].select(*columns).schema
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"old.{c}").cast(kind[columns[0]].dataType).alias("old"), F.col(f"new.{c}").cast(kind[columns[0]].dataType).alias("new")) for c in columns])
    found = both.select(
        F.when(F.col("new").isNull(), F.col("_a_old")).otherwise(F.col("_a_new")).alias(asset),
        F.when(F.col("new").isNull(), F.col("_d_old")).otherwise(F.col("_d_new")).alias(day), change.alias("change"), F.explode(cells).alias("_c"))
    differs = (F.col("change") != "changed") | ~F.col("_c.old").eqNullSafe(F.col("_c.new"))
    return found.filter(differs).select(asset, day, F.col("_c.column").alias("column"), "change", F.col("_c.old").alias("old"), F.col("_c.new").alias("new"))
