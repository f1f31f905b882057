"""Queries that load, check, shape and align."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelsmith.functions.numeric import exact_sum, tidy
from panelsmith.operators import calendar, quality, timejoin
from panelsmith.plans.inputs import PAST, panel, panel_from_tables, panel_sql, r
from panelsmith.plans.registry import query
from panelsmith.sources.tables import SCHEMAS, load
from panelsmith.storage import settle


@query("\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SCHEMAS))
def tables_loaded(spark, folder):
    """Rows of each table after its schema was checked."""
    counts = [
        load(spark, folder, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t in SCHEMAS
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(f"WITH {panel_sql('n_nationkey')} SELECT * FROM panel")
def panel_by_nation(spark, folder):
    return panel_from_tables(spark, folder, "nation")


@query(f"WITH {panel_sql()} SELECT * FROM panel")
def panel_by_supplier(spark, folder):
    return panel_from_tables(spark, folder, "supplier")


LINE_COLUMNS = dict(part.split() for part in SCHEMAS["lineitem"].split(", "))


@query("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls, CAST(0 AS BIGINT) AS nans,
      CAST(min({c}){zero} AS VARCHAR) AS least, CAST(max({c}){zero} AS VARCHAR) AS greatest FROM lineitem"""
    for c, kind in LINE_COLUMNS.items() for zero in [" + 0e0" if kind == "double" else ""]
))
def quality_columns(spark, folder):
    return quality.column_report(load(spark, folder, "lineitem"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1""")
def quality_repeated_keys(spark, folder):
    return quality.repeated_keys(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {panel_sql()},
    steps AS (SELECT asset, date_diff('day', lag(d) OVER ({PAST}), d) AS step FROM panel)
    SELECT asset, count(*) AS days, count(*) FILTER (WHERE step > 1) AS gaps,
      CAST(max(step) AS INTEGER) AS longest, CAST(coalesce(sum(step - 1), 0) AS BIGINT) AS missed
    FROM steps GROUP BY asset""")
def quality_gaps(spark, folder):
    return quality.gaps(panel(spark, folder).df)


@query(f"""WITH {panel_sql()},
    stats AS (SELECT asset, avg(px) AS m, stddev_samp(px) AS s FROM panel GROUP BY asset)
    SELECT asset, d, px, {r('(px - m) / nullif(s, 0e0)')} AS score
    FROM panel JOIN stats USING (asset) WHERE abs((px - m) / nullif(s, 0e0)) > 3""")
def quality_outliers(spark, folder):
    found = quality.outliers(panel(spark, folder).df, "px", 3.0)
    return found.select("asset", "d", "px", tidy("score").alias("score"))


@query(f"""WITH {panel_sql()},
    ahead AS (SELECT *, lead(d) OVER ({PAST}) AS next_d FROM panel),
    days AS (SELECT asset, grp, px, vol, d,
        unnest(generate_series(d, coalesce(next_d - 1, d), INTERVAL 1 DAY)) AS day FROM ahead)
    SELECT asset, grp, CAST(day AS DATE) AS d, px, vol, CAST(day AS DATE) > d AS filled FROM days""")
def calendar_filled(spark, folder):
    return calendar.fill_calendar(panel(spark, folder).df, ["px", "vol"])


@query(f"""WITH {panel_sql()}
    SELECT asset, CAST(date_trunc('week', d) AS DATE) AS bar, arg_min(px, d) AS open,
      max(px) AS high, min(px) AS low, arg_max(px, d) AS close,
      sum(vol) AS volume, count(*) AS days
    FROM panel GROUP BY 1, 2""")
def weekly_bars(spark, folder):
    return calendar.resample(panel(spark, folder).df, "week")


VIEWS_SQL = """SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts"""


def _views(spark, folder, bin_seconds=None):
    events = load(spark, folder, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"), F.col("event_id").alias("view_id")
    )
    return timejoin.asof_join(
        purchases, views, "user_id", "ts", "view_ts", "view_id", ["view_ts", "view_value"], bin_seconds
    )


@query(VIEWS_SQL)
def purchase_after_view(spark, folder):
    """Each purchase with the user's latest view at or before it."""
    return _views(spark, folder)


@query(VIEWS_SQL)
def purchase_after_view_binned(spark, folder):
    """The same by the way that keys too large for a task take."""
    return _views(spark, folder, bin_seconds=6 * 3600)


@query("""WITH changes AS (
      SELECT o_custkey, o_orderdate, arg_max(o_orderpriority, o_orderkey) AS priority
      FROM orders GROUP BY 1, 2),
    spans AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM changes)
    SELECT s.priority, CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS line_count,
      CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey
    LEFT JOIN spans s ON s.o_custkey = o.o_custkey AND l_shipdate >= s.o_orderdate
      AND (s.valid_to IS NULL OR l_shipdate < s.valid_to)
    GROUP BY 1, 2""")
def priority_at_shipment(spark, folder):
    """Lines by the priority their customer's latest order had on the day of shipment."""
    orders = load(spark, folder, "orders")
    changes = orders.select(
        "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("change_id")
    )
    spans = settle(timejoin.spans_from_changes(changes, "o_custkey", "o_orderdate", "change_id"), "spans")
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    shipped = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("o_custkey", "l_shipdate", "l_quantity")
    held = timejoin.point_in_time_join(
        shipped, spans, "o_custkey", "l_shipdate", "valid_from", "valid_to", "change_id", ["priority"]
    )
    return held.groupBy("priority", F.year("l_shipdate").alias("ship_year")).agg(
        F.count(F.lit(1)).alias("line_count"), exact_sum("l_quantity").alias("quantity")
    )
