"""Event log questions over the fixture tables."""

from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import history as ops
from strandline.operators import versions
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


@query(with_tables(["fx_event"], """
SELECT node AS about, seq, event FROM fx_event
UNION ALL SELECT 'U' || (CAST(substring(node, 2) AS BIGINT) + 1), seq, event FROM fx_event WHERE event = 'purchase'"""))
def event_history(fx):
    """Each user's events, and purchases also under the next user."""
    other = F.concat(F.lit("U"), F.substring("node", 2, 20).cast("long") + 1)
    events = fx.events().withColumn("nodes", F.when(F.col("event") == "purchase", F.array(F.col("node"), other)))
    return ops.events_by_node(events).select("about", "seq", "event")


@query(with_tables(["fx_event"], """
SELECT ts, seq, CAST(ts AS DATE) AS day, event, actor, node FROM fx_event
WHERE actor = 'user' AND event = 'error' AND contains(detail, '7') ORDER BY ts DESC, seq DESC LIMIT 600"""))
def timeline(fx):
    """The newest errors of users with a 7 in their detail; the operator's limit is per project, the question's over all."""
    hits = ops.timeline(fx.events(), actor="user", event="error", text="7", fields=["detail"], limit=600)
    return hits.orderBy(F.desc("ts"), F.desc("seq")).limit(600).select("ts", "seq", "day", "event", "actor", "node")


@query(with_tables(["fx_event"], """
SELECT DISTINCT project_id, 'actor' AS facet, actor AS value FROM fx_event
UNION SELECT DISTINCT project_id, 'event', event FROM fx_event"""))
def event_facets(fx):
    return ops.event_facets(fx.events())


@query(with_tables(["fx_version"], """
SELECT day, CAST(sum(sum(n)) OVER (ORDER BY day) AS BIGINT) AS nodes, CAST(sum(sum(v)) OVER (ORDER BY day) AS BIGINT) AS versions
FROM (SELECT CAST(min(ts) AS DATE) AS day, 1 AS n, 0 AS v FROM fx_version GROUP BY node_id
      UNION ALL SELECT CAST(ts AS DATE), 0, 1 FROM fx_version) GROUP BY day"""))
def growth_series(fx):
    saved = versions.assign_versions(fx.snapshots(), F.date_trunc("day", "ts"))
    nodes = fx.snapshots().groupBy("project_id", "node_id").agg(F.min("ts").alias("created"))
    return ops.growth_series(nodes, saved).select("day", "nodes", "versions")


@query(with_tables(["fx_event"], "SELECT project_id, max(ts) AS last_activity FROM fx_event GROUP BY project_id"))
def last_activity(fx):
    return ops.last_activity(fx.events())


@query(with_tables(["fx_event"], """
SELECT node, CASE WHEN age < 86400 THEN 'updated today' WHEN age < 604800 THEN 'this week'
                  WHEN age < 2678400 THEN 'this month' ELSE 'older' END AS recency
FROM (SELECT node, epoch(TIMESTAMP '2024-01-31 00:00:00' - date_trunc('second', max(ts))) AS age FROM fx_event GROUP BY node)"""))
def recency_buckets(fx):
    last = fx.events().groupBy("node").agg(F.max("ts").alias("ts"))
    return last.select("node", ops.recency(F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")).alias("recency"))


@query(with_tables(["fx_event"], """
SELECT CAST(ts AS DATE) AS day, actor, event, count(*) AS n FROM fx_event GROUP BY ROLLUP (CAST(ts AS DATE), actor, event)"""))
def activity_rollup(fx):
    return ops.activity_rollup(fx.events())


@query(with_tables(["fx_event"], """
SELECT CAST(ts AS DATE) AS day, actor, event, count(*) AS n FROM fx_event GROUP BY ALL"""))
def activity_daily(fx):
    return ops.activity_daily(fx.events())


_STATES = "CASE event_type WHEN 'error' THEN 'missing' WHEN 'purchase' THEN 'modified' ELSE 'ok' END"


@query(f"""
SELECT node_id, ts, state FROM (
  SELECT 'U' || user_id AS node_id, ts, {_STATES} AS state,
         lag({_STATES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE (before IS NULL AND state <> 'ok') OR before <> state""")
def state_change_events(fx):
    states = fx.table("events").selectExpr("'p0' AS project_id", "concat('U', user_id) AS node_id", "ts",
                                           "event_id AS seq", f"{_STATES} AS state")
    return ops.state_changes(states, F.date_trunc("day", "ts")).select("node_id", "ts", "state")


@query(with_tables(["fx_version"], """
SELECT node_id, CAST(v AS INT) AS v, ts, why FROM fx_version WHERE why <> '' ORDER BY ts DESC, node_id DESC, v DESC LIMIT 12"""))
def recent_updates(fx):
    saved = versions.assign_versions(fx.snapshots(), F.date_trunc("day", "ts"))
    return ops.recent_updates(saved).select("node_id", "v", "ts", "why")
