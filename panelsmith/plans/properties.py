"""Queries on the JSON texts of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelsmith.operators import semistructured as js
from panelsmith.plans.registry import query
from panelsmith.sources.tables import load

# The given texts are flat objects, which is all that the SQL looks into.
KIND_SQL = """CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'number' WHEN type = 'VARCHAR' THEN 'string'
      ELSE lower(type) END"""


@query(f"""WITH inner_values AS (SELECT '$.' || key AS path, {KIND_SQL} AS kind, CAST(value AS DOUBLE) AS v FROM (SELECT props FROM events), json_each(props))
    SELECT path, kind, count(*) AS n, min(v) AS lowest, max(v) AS highest FROM inner_values GROUP BY path, kind
    UNION ALL SELECT '$', 'object', count(*), NULL, NULL FROM events""")
def event_property_paths(spark, folder):
    """What paths the events' properties hold, and of which kinds."""
    return js.path_statistics(load(spark, folder, "events"), "props")


@query("""SELECT event_type, CAST(ts AS DATE) AS d, count(k) AS n, CAST(sum(k) AS BIGINT) AS total
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2""")
def event_property_totals(spark, folder):
    """A property as a typed column, summed by type of event and day."""
    events = js.typed(load(spark, folder, "events"), "props", {"k": ("$.k", "bigint")})
    return events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("k").alias("n"), F.sum("k").alias("total"))


@query("""WITH marked AS (SELECT CAST(ts AS DATE) AS d, 'u' || CAST(user_id AS VARCHAR) AS name FROM events),
    seen AS (SELECT d, name, count(*) AS n FROM marked GROUP BY 1, 2),
    days AS (SELECT d, lag(d) OVER (ORDER BY d) AS prev_d, lead(d) OVER (ORDER BY d) AS next_d FROM (SELECT DISTINCT d FROM seen)),
    placed AS (SELECT seen.*, prev_d, next_d, lag(seen.d) OVER (PARTITION BY name ORDER BY seen.d) AS last_d,
      lead(seen.d) OVER (PARTITION BY name ORDER BY seen.d) AS later_d FROM seen JOIN days USING (d))
    SELECT d, '$.' || name AS path, 'integer' AS kind, 'new' AS change, n FROM placed
      WHERE prev_d IS NOT NULL AND (last_d IS NULL OR last_d < prev_d)
    UNION ALL SELECT next_d, '$.' || name, 'integer', 'gone', 0 FROM placed WHERE next_d IS NOT NULL AND (later_d IS NULL OR later_d > next_d)""")
def event_property_drift(spark, folder):
    """Paths that begin and cease to occur from day to day, when each event's property is named by its user."""
    events = js.typed(load(spark, folder, "events"), "props", {"k": ("$.k", "bigint")})
    named = events.select(F.to_date("ts").alias("d"), F.to_json(F.create_map(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("k"))).alias("named"))
    return js.drift(named, "named", "d")
