"""Text columns that hold JSON: what is in them, where it is malformed, and how it changes.

A text is parsed once into a VARIANT.  Its paths are found level by level: the
children of all objects and arrays of one level are one exploded table, written
before the next level is read, so neither depth nor width needs to be known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.storage import settle

ROOT = "$"
CONTAINERS = ["object", "array"]


def kind_of(value: Column) -> Column:
    """object, array, null, boolean, integer, number, string, or the lower-case name of another type."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "VOID", "null")
        .when(name == "BIGINT", "integer").when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").otherwise(F.lower(name))
    )


def parsed(df: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    """Add the VARIANT of a JSON text; NULL for NULL and for text that is not JSON or repeats a key."""
    return df.withColumn(out, F.try_parse_json(column))


def typed(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Add columns by name from ``(path, type)`` in a JSON text; NULL where the path is missing or of another type."""
    both = parsed(df, column, "_parsed")
    return both.select(*df.columns, *[F.try_variant_get("_parsed", path, kind).alias(name) for name, (path, kind) in paths.items()])


def path_values(df: DataFrame, column: str, keep: list[str] = []) -> DataFrame:
    """``(keep, path, kind, value)``: every value at every path of every text, objects and arrays included.

    ``path`` is written $.key[*].key, with [*] for all elements of an array;
    ``value`` is the VARIANT.  A NULL text is one row of kind "missing" at $, one
    that is not JSON of kind "malformed".
    """
    spark = df.sparkSession
    held = df.select(*keep, F.col(column).isNotNull().alias("_given"), F.try_parse_json(column).alias("value"))
    kind = F.when(F.col("value").isNotNull(), kind_of(F.col("value"))).when(F.col("_given"), "malformed").otherwise("missing")
    level = settle(held.select(*keep, F.lit(ROOT).alias("path"), kind.alias("kind"), "value"), "json-level")
    levels = [level]
    while True:
        inner = level.filter(F.col("kind").isin(CONTAINERS))
        if inner.isEmpty():
            break
        outer = inner.withColumnRenamed("value", "_outer").withColumnRenamed("path", "_path").withColumnRenamed("kind", "_kind")
        children = outer.lateralJoin(spark.tvf.variant_explode(F.col("_outer").outer()))
        step = F.when(F.col("_kind") == "array", "[*]").otherwise(F.concat(F.lit("."), F.col("key")))
        level = children.select(*keep, F.concat("_path", step).alias("path"), kind_of(F.col("value")).alias("kind"), "value")
        level = settle(level, "json-level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def number(value: Column) -> Column:
    """The value as a double if it is a number."""
    return F.when(kind_of(value).isin("integer", "number"), F.try_variant_get(value, ROOT, "double"))


def path_statistics(df: DataFrame, column: str, by: list[str] = []) -> DataFrame:
    """How often each path holds a value of each kind, by ``by``, with the lowest and highest of its numbers."""
    values = path_values(df, column, by)
    return values.groupBy(*by, "path", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min(number(F.col("value"))).alias("lowest"), F.max(number(F.col("value"))).alias("highest"))


def drift(df: DataFrame, column: str, day: str) -> DataFrame:
    """``(day, path, kind, change, n)``: kinds of values that a path begins ("new") or ceases ("gone") to hold.

    A day is compared with the last day before it that has any rows; on the
    first day nothing is new.  A path that a day lacks is gone on that day, once.
    Only counts by day, path and kind are compared.
    """
    seen = settle(path_statistics(df, column, [day]), "json-paths")
    days = seen.select(day).distinct().filter(F.col(day).isNotNull())
    calendar = Window.orderBy(day)  # a row for each day
    days = settle(days.select(day, F.lag(day).over(calendar).alias("_before"), F.lead(day).over(calendar).alias("_after")), "json-days")
    of_path = Window.partitionBy("path", "kind").orderBy(day)
    placed = seen.join(days, day).select(
        "*", F.lag(day).over(of_path).alias("_last"), F.lead(day).over(of_path).alias("_next"))
    new = placed.filter("_before is not null and (_last is null or _last < _before)").select(day, "path", "kind", F.lit("new").alias("change"), "n")
    gone = placed.filter("_after is not null and (_next is null or _next > _after)").select(
        F.col("_after").alias(day), "path", "kind", F.lit("gone").alias("change"), F.lit(0).cast("long").alias("n"))
    return new.unionByName(gone)
