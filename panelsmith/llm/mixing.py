"""Mixing sources to target weights by budgets that flow down a tree.

Leaves are the combinations of the level columns (domain, language, source).
A node's budget is shared among its children in proportion to their weights,
but no child gets more than all its documents hold over the allowed epochs;
what it cannot use goes to its siblings in the same proportion.  A node is
given more than its subtree holds only when all its siblings are full too, so
shortages are made up among siblings first and among ancestors last.

The share of a child with capacity c and weight w is min(c, L w), where L is
the level at which the shares add up to the parent's budget.  With children
ordered by c / w, L is the largest of (budget - capacity before) / (weight from
here on), so one window per parent finds it.

Inside a leaf documents are ordered by a seeded hash, anew for each epoch, and
taken from the front until the budget is used.  The order is cut by the first
digits of the hash, so that a leaf that holds a third of all documents is
summed up in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.storage import settle

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # hexadecimal digits of the hash that cut a leaf into 4,096 stretches
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(values: dict[str, int], column: str) -> Column:
    given = F.lit(1)
    for value, weight in values.items():
        given = F.when(F.col(column) == value, weight).otherwise(given)
    return given.cast("long")


def shares(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` with ``budget``: their share of ``parent_budget`` by ``weight``, at most ``capacity``."""
    order = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rising = order.orderBy(F.try_divide(F.col("capacity"), F.col("weight")).asc_nulls_last(), "capacity")
    before = F.coalesce(F.sum("capacity").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide((F.col("parent_budget") - before).cast("double"), from_here.cast("double"))
    return (
        nodes.withColumn("_level", level).withColumn("_level", F.max("_level").over(order))
        .withColumn("budget", F.coalesce(F.least("capacity", F.floor(F.col("_level") * F.col("weight")).cast("long")), F.lit(0).cast("long")))
        .drop("_level")
    )


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with the ``budget`` of each.

    The root's budget is ``share`` (numerator, denominator) of all tokens.  A
    value without a weight has weight 1.
    """
    top, bottom = share
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast("long").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(weights.get(level, {}), level))
        if parent:
            nodes = nodes.join(budgets, parent)
        else:
            nodes = nodes.withColumn("parent_budget", F.expr(f"sum(capacity) over (partition by 0) div {epochs} * {top} div {bottom}"))
        budgets = shares(nodes, parent).select(*path, F.col("budget").alias("parent_budget"))
    return leaves.join(budgets.withColumnRenamed("parent_budget", "budget"), levels)


def choose(units: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int] = (3, 5),
           epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The documents taken in each epoch.

    ``units`` has ``doc``, ``version``, ``n_tokens`` and the level columns, which
    must not be null.  Result: those and ``epoch`` (from 0), ``leaf_budget``,
    ``tokens_before`` (of the leaf, over all epochs) and ``used_tokens``, fewer
    than the document's only for the last one of a leaf.  Documents without
    tokens are never taken.
    """
    units = settle(units, "mix-units")
    leaves = settle(units.groupBy(*levels).agg(F.sum("n_tokens").cast("long").alias("tokens")), "mix-leaves")
    budgets = settle(leaf_budgets(leaves, levels, weights, share, epochs), "mix-budgets").filter("budget > 0")
    rounds = budgets.withColumn("epoch", F.explode(F.expr("sequence(0, cast((budget - 1) div tokens as int))")))
    placed = (
        units.filter("n_tokens > 0").join(rounds, levels)
        .withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc").cast("string"), F.lit("")))))
        .withColumn("stretch", F.substring("place", 1, DIGITS))
    )
    keys = [*levels, "epoch", "stretch"]
    inside = Window.partitionBy(*keys).orderBy("place", "doc", "n_tokens", "version").rowsBetween(Window.unboundedPreceding, -1)
    stretches = placed.groupBy(*keys).agg(F.sum("n_tokens").alias("held"))
    earlier = Window.partitionBy(*levels, "epoch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(*keys, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("in_epoch"))
    counted = placed.withColumn("in_stretch", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    before = F.col("epoch") * F.col("tokens") + F.col("in_epoch") + F.col("in_stretch")
    return (
        counted.join(stretches, keys).withColumn("tokens_before", before.cast("long")).filter("tokens_before < budget")
        .select("doc", "version", *levels, "epoch", "n_tokens", F.col("budget").alias("leaf_budget"), "tokens_before",
                F.least(F.col("n_tokens"), F.col("budget") - F.col("tokens_before")).alias("used_tokens"))
    )


def units_of(docs: DataFrame, levels: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is mixed: one row per id and text; a null level value is a value of its own, a null text holds no tokens."""
    return _unit_rows(docs, levels, id_col, text_col).dropDuplicates(["doc", "version", *levels])


def _unit_rows(docs: DataFrame, levels: dict[str, Column], id_col: str, text_col: str, *more: Column) -> DataFrame:
    named = {name: F.coalesce(column, F.lit(NONE)) for name, column in levels.items()}
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), n_tokens(text).alias("n_tokens"),
        *[c.alias(name) for name, c in named.items()], *more,
    )


def domain_of(source: Column) -> Column:
    """The given sources have numbers; every fourth belongs to one domain, the rest to the first."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def levels() -> dict[str, Column]:
    """The tree of the given documents: domain, language, source."""
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


# Target weights of the production mix; what is not named weighs 1.
WEIGHTS = {"domain": {"d0": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 3}}


def mixed(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: tuple[int, int],
          id_col: str = "doc_id", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` taken in one epoch, whole: a leaf's last document is not cut.

    Rows that repeat id and text are one unit of as many tokens as all of them
    hold; of the last unit of a leaf only as many rows are returned as its budget
    reaches, the same ones each time.  Rows of null or empty texts are not taken.
    """
    keys = ["doc", "version", *levels]
    units = _unit_rows(docs, levels, id_col, text_col).groupBy(*keys).agg(
        F.first("n_tokens").alias("each"), F.count(F.lit(1)).alias("copies"))
    units = settle(units.withColumn("n_tokens", F.col("each") * F.col("copies")), "mix-copies")
    taken = choose(units.drop("each", "copies"), list(levels), weights, share, 1, seed).select(*keys, "used_tokens")
    named = {name: units[name].eqNullSafe(taken[name]) for name in keys}
    taken = settle(units.join(taken, list(named.values())).select(
        *[units[name] for name in keys], "copies", F.ceil(F.col("used_tokens") / F.col("each")).cast("long").alias("wanted")), "mix-taken")

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[
        c.alias(name) for name, c in {"doc": docs[id_col], "version": F.xxhash64(F.coalesce(docs[text_col], F.lit(""))),
                                      **{name: F.coalesce(column, F.lit(NONE)) for name, column in levels.items()}}.items()])
    met = held.join(taken, [held[name].eqNullSafe(taken[name]) for name in keys]).select(*[held[c] for c in held.columns], "copies", "wanted")
    one = met.filter("copies = 1").select("row")
    # Copies are counted before they meet: what remains are the variants that other columns make.
    variants = met.filter("copies > 1").groupBy("row", *keys, "wanted").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy(F.to_json("row")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("wanted") - F.coalesce(F.sum("n").over(before), F.lit(0))
    variants = variants.withColumn("n", F.least(F.col("n"), left)).filter("n > 0")
    several = variants.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_")).select("row")
    return one.unionByName(several).select("row.*")
