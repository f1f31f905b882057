"""Queries on panels that are refreshed by the day; their SQL builds them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith import incremental
from panelsmith.functions.numeric import ratio, tidy
from panelsmith.operators.changes import change_points
from panelsmith.operators.reconcile import differences
from panelsmith.operators.timeseries import trailing, trailing_days
from panelsmith.plans.inputs import PAST, panel, panel_sql, r
from panelsmith.plans.registry import query
from panelsmith.sources.panels import build_panel
from panelsmith.sources.tables import load
from panelsmith.storage import new_path, settle

LOOKBACK = 27  # days before today in a window of four weeks


def dated_lines(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    return load(spark, folder, "lineitem").select(*columns, F.to_date("l_shipdate").alias("d"))


def before_the_last_month(lines: DataFrame) -> DataFrame:
    """What an earlier day knew: nothing of the last month, and one day of the month before not yet delivered."""
    last = F.lit(lines.agg(F.max("d")).first()[0])
    return lines.filter((F.col("d") < F.date_sub(last, 30)) & (F.col("d") != F.date_sub(last, 45)))


def refreshed_twice(spark: SparkSession, folder: str, build, lookback: int = 0) -> DataFrame:
    """The panel as of an earlier day, then brought up to date with all that came since."""
    lines, supplier, nation = dated_lines(spark, folder), load(spark, folder, "supplier"), load(spark, folder, "nation")
    salt, path = incremental.table_print(supplier, nation), new_path(spark, "refreshed")
    for source in (before_the_last_month(lines), lines):
        incremental.refresh(source, lambda part: build(build_panel(part, supplier, nation)), path, lookback=lookback, salt=salt, unit="month")
    return incremental.read(spark, path)


@query(f"WITH {panel_sql()} SELECT asset, grp, d, {r('px')} AS px, vol FROM panel")
def panel_refreshed(spark, folder):
    """The supplier panel, most days built in a first refresh and the rest in a second."""
    return refreshed_twice(spark, folder, lambda panel: panel).select("asset", "grp", "d", tidy("px").alias("px"), "vol")


@query(f"""WITH {panel_sql()} SELECT asset, d, {r(f"avg(vol) OVER ({PAST} RANGE BETWEEN INTERVAL {LOOKBACK} DAYS PRECEDING AND CURRENT ROW)")} AS mean_vol,
    count(vol) OVER ({PAST} RANGE BETWEEN INTERVAL {LOOKBACK} DAYS PRECEDING AND CURRENT ROW) AS days FROM panel""")
def four_week_volume_refreshed(spark, folder):
    """Mean volume over four weeks: days after a change look back on it and are built anew too."""

    def build(panel: DataFrame) -> DataFrame:
        window = trailing_days(LOOKBACK + 1)
        return panel.select("asset", "d", F.avg("vol").over(window).alias("mean_vol"), F.count("vol").over(window).alias("days"))

    return refreshed_twice(spark, folder, build, LOOKBACK).select("asset", "d", tidy("mean_vol").alias("mean_vol"), "days")


@query(f"""WITH {panel_sql()},
    last_day AS (SELECT max(CAST(l_shipdate AS DATE)) AS last FROM lineitem),
    known_lines AS (SELECT lineitem.* FROM lineitem, last_day
      WHERE CAST(l_shipdate AS DATE) < last - 30 AND CAST(l_shipdate AS DATE) <> last - 45),
    {panel_sql().replace("panel AS (", "earlier AS (", 1).replace("FROM lineitem JOIN", "FROM known_lines lineitem JOIN", 1)},
    cells AS (SELECT asset, d, unnest(['px', 'vol']) AS name, unnest([px, vol]) AS v FROM panel),
    earlier_cells AS (SELECT asset, d, unnest(['px', 'vol']) AS name, unnest([px, vol]) AS v FROM earlier)
    SELECT coalesce(c.asset, e.asset) AS asset, coalesce(c.d, e.d) AS d, coalesce(c.name, e.name) AS "column",
      CASE WHEN e.asset IS NULL THEN 'added' WHEN c.asset IS NULL THEN 'removed' ELSE 'changed' END AS change,
      {r('e.v')} AS old, {r('c.v')} AS new
    FROM cells c FULL JOIN earlier_cells e ON c.asset = e.asset AND c.d = e.d AND c.name = e.name
    WHERE e.asset IS NULL OR c.asset IS NULL OR e.v IS DISTINCT FROM c.v""")
def panel_reconciled(spark, folder):
    """What an earlier version of the supplier panel lacks or holds otherwise."""
    lines, supplier, nation = dated_lines(spark, folder), load(spark, folder, "supplier"), load(spark, folder, "nation")
    earlier = settle(build_panel(before_the_last_month(lines), supplier, nation), "earlier-panel")
    found = differences(earlier, panel(spark, folder).df, ["px", "vol"])
    return found.withColumn("old", tidy("old")).withColumn("new", tidy("new"))


ALLOWANCE, LIMIT = 0.5, 5.0
SCORE = f"vol - avg(vol) OVER ({PAST} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
SPREAD = f"stddev_samp(vol) OVER ({PAST} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH RECURSIVE {panel_sql()},
    scored AS (SELECT asset, d, {r(f'({SCORE}) / nullif({SPREAD}, 0e0)', 3)} AS z FROM panel),
    steps AS (SELECT asset, d, z, row_number() OVER (PARTITION BY asset ORDER BY d) AS i FROM scored WHERE z IS NOT NULL),
    walk AS (
      SELECT asset, 0 AS i, 0e0 AS up, 0e0 AS down, CAST(NULL AS DATE) AS since_up, CAST(NULL AS DATE) AS since_down,
        CAST(NULL AS DATE) AS d FROM (SELECT DISTINCT asset FROM steps)
      UNION ALL
      SELECT asset, i, up, down, CASE WHEN up > 0 THEN coalesce(since_up, d) END, CASE WHEN down > 0 THEN coalesce(since_down, d) END, d
      FROM (SELECT s.asset, s.i, s.d,
          greatest(0e0, CASE WHEN greatest(w.up, w.down) > {LIMIT}e0 THEN 0e0 ELSE w.up END + s.z - {ALLOWANCE}e0) AS up,
          greatest(0e0, CASE WHEN greatest(w.up, w.down) > {LIMIT}e0 THEN 0e0 ELSE w.down END - s.z - {ALLOWANCE}e0) AS down,
          CASE WHEN greatest(w.up, w.down) <= {LIMIT}e0 THEN w.since_up END AS since_up,
          CASE WHEN greatest(w.up, w.down) <= {LIMIT}e0 THEN w.since_down END AS since_down
        FROM walk w JOIN steps s ON s.asset = w.asset AND s.i = w.i + 1))
    SELECT asset, CASE WHEN up >= down THEN since_up ELSE since_down END AS since, d, CASE WHEN up >= down THEN 'up' ELSE 'down' END AS side,
      {r('greatest(up, down)')} AS score FROM walk WHERE greatest(up, down) > {LIMIT}e0""")
def volume_change_points(spark, folder):
    """Days on which an asset's volume has moved away from its last twenty rows for some time."""
    before = trailing(20).rowsBetween(-20, -1)
    score = ratio(F.col("vol") - F.avg("vol").over(before), F.stddev_samp("vol").over(before))
    scored = panel(spark, folder).df.select("asset", "d", tidy(score, 3).alias("z"))
    return change_points(scored, "z", ALLOWANCE, LIMIT).withColumn("score", tidy("score"))
