"""Staleness questions over the fixture tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import staleness, versions
from strandline.operators.staleness import Staleness
from strandline.plans import cut
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


def stored(fx):
    return fx.nodes(), fx.edges(), fx.version_parents()


def evaluate(fx) -> Staleness:
    return Staleness(*stored(fx))


@query(with_tables(["st_all"], "SELECT node_id FROM st_all"))
def stale_nodes(fx):
    return evaluate(fx).stale_nodes().select("node_id")


@query(with_tables(["st_direct", "st_placed", "fx_edge"], """
SELECT edge_id FROM fx_edge WHERE rel IN ('feeds', 'produces', 'derives')
  AND (source, target) IN (SELECT parent_id, node_id FROM st_direct WHERE node_id NOT LIKE 'O%')
UNION ALL SELECT DISTINCT e.edge_id FROM fx_edge e JOIN st_direct d ON d.parent_id = e.source
  AND d.node_id LIKE 'O%' AND e.target = 'PL' || substring(d.node_id, 2)
UNION ALL SELECT edge_id FROM st_placed"""))
def stale_edges(fx):
    return evaluate(fx).stale_links().select("edge_id")


@query(with_tables(["st_placed"], "SELECT edge_id, placed_version AS from_v, CAST(wanted AS INT) AS to_v FROM st_placed"))
def stale_placements(fx):
    return evaluate(fx).stale_placements().select("edge_id", "from_v", "to_v")


@query(with_tables(["st_all", "st_direct", "st_placed", "st_feed", "fx_edge", "fx_node", "st_pl", "st_t"], """
SELECT node_id, 'input_moved' AS kind, parent_id AS src, recorded AS from_v, parent_current AS to_v FROM st_direct
UNION ALL
SELECT node_id, 'upstream_stale', src, NULL, NULL FROM (
  SELECT target AS node_id, source AS src FROM fx_edge WHERE rel = 'derives'
  UNION SELECT 'O' || o_orderkey, source FROM st_feed) p
WHERE src IN (SELECT node_id FROM st_all) AND (node_id, src) NOT IN (SELECT node_id, parent_id FROM st_direct)
UNION ALL SELECT target, 'component_newer', source, placed_version, wanted FROM st_placed
UNION ALL SELECT target, 'component_stale', source, NULL, NULL FROM fx_edge
WHERE rel = 'part_of' AND source IN (SELECT node_id FROM st_t) AND edge_id NOT IN (SELECT edge_id FROM st_placed)
UNION ALL SELECT 'PL' || o_orderkey, CASE WHEN d.node_id IS NOT NULL THEN 'rerun_needed' ELSE 'upstream_stale' END,
       source, NULL, NULL
FROM st_feed f LEFT JOIN st_direct d ON d.parent_id = f.source AND d.node_id = 'O' || f.o_orderkey
WHERE d.node_id IS NOT NULL OR f.source IN (SELECT node_id FROM st_all)"""))
def stale_reasons(fx):
    return evaluate(fx).reasons().select("node_id", "kind", "src", "from_v", "to_v")


# files of customers in debt are gone, results of urgent orders have other content
_DISK = "FROM fx_node n LEFT JOIN customer ON n.node_id = 'C' || c_custkey LEFT JOIN orders ON n.node_id = 'O' || o_orderkey"


@query(with_tables(["fx_node"], f"""
SELECT n.node_id, coalesce(c_acctbal < 0, false) AS missing, coalesce(o_orderpriority = '1-URGENT', false) AS modified
{_DISK} WHERE n.path IS NOT NULL"""))
def disk_state(fx):
    return staleness.disk_state(fx.node_versions(), fx.disk()).select(
        "node_id", "missing", "modified")


@query(with_tables(["fx_node", "st_all"], f"""
SELECT n.node_id, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN s.node_id IS NOT NULL THEN 'stale'
       WHEN o_orderpriority = '1-URGENT' THEN 'modified' ELSE 'ok' END AS state
{_DISK} LEFT JOIN (SELECT DISTINCT node_id FROM st_all) s ON s.node_id = n.node_id"""))
def node_state(fx):
    disk = staleness.disk_state(fx.node_versions(), fx.disk())
    return staleness.node_state(fx.nodes(), evaluate(fx).stale_nodes(), disk).select("node_id", "state")


_AFTER_SAVE = """
moved2 AS (SELECT node_id, parent_id FROM fx_recorded WHERE recorded IS NOT NULL AND recorded <>
           parent_current + CASE WHEN parent_id LIKE 'P%' AND parent_id NOT LIKE 'PL%' THEN 1 ELSE 0 END),
o2 AS (SELECT DISTINCT node_id FROM moved2 WHERE node_id LIKE 'O%' UNION SELECT node_id FROM st_o),
pl2 AS (SELECT DISTINCT 'PL' || substring(node_id, 2) AS node_id FROM moved2 WHERE parent_id LIKE 'P%' AND node_id LIKE 'O%'
        AND parent_id NOT LIKE 'PL%' UNION SELECT node_id FROM st_pl),
t2 AS (SELECT DISTINCT 'T' || o_custkey AS node_id FROM orders WHERE 'O' || o_orderkey IN (SELECT node_id FROM o2)
       UNION SELECT node_id FROM st_t),
a2 AS (SELECT DISTINCT target AS node_id FROM fx_edge WHERE rel = 'part_of' AND source IN (SELECT node_id FROM t2)
       UNION SELECT node_id FROM st_a)"""


@query(with_tables(["st_all", "fx_recorded", "fx_edge"], """
SELECT node_id FROM (SELECT node_id FROM o2 UNION SELECT node_id FROM pl2 UNION SELECT node_id FROM t2
                     UNION SELECT node_id FROM a2) WHERE node_id NOT IN (SELECT node_id FROM st_all)""", _AFTER_SAVE))
def impact_of_change(fx):
    """What becomes stale when every part gets a new version."""
    nodes, edges, recorded = stored(fx)
    parts = fx.table("part").selectExpr("concat('P', p_partkey) AS node_id").join(nodes, "node_id").select(
        "project_id", "node_id", (F.col("current_version") + 1).alias("new_version"))
    before = Staleness(nodes, edges, recorded).stale_nodes()
    after = Staleness(staleness.with_current(nodes, parts), edges, recorded).stale_nodes()
    return staleness.impact_of(before, after).select("node_id")


_CONFIRMED = """
d2 AS (SELECT * FROM st_direct WHERE node_id NOT LIKE 'O%'),
o3 AS (SELECT 'O' || o_orderkey AS node_id FROM st_feed
       WHERE source IN (SELECT node_id FROM st_c UNION SELECT node_id FROM st_su)),
pl3 AS (SELECT DISTINCT 'PL' || o_orderkey AS node_id FROM st_feed
        WHERE source IN (SELECT node_id FROM st_c UNION SELECT node_id FROM st_su)),
t3 AS (SELECT node_id FROM d2 WHERE node_id LIKE 'T%'
       UNION SELECT 'T' || o_custkey FROM orders WHERE 'O' || o_orderkey IN (SELECT node_id FROM o3)),
a3 AS (SELECT target AS node_id FROM st_placed UNION
       SELECT target FROM fx_edge WHERE rel = 'part_of' AND source IN (SELECT node_id FROM t3))"""


@query(with_tables(["st_n", "st_c", "st_su", "st_feed", "st_direct", "st_placed", "fx_edge"], """
SELECT node_id FROM st_n UNION SELECT node_id FROM st_c UNION SELECT node_id FROM st_su UNION SELECT node_id FROM o3
UNION SELECT node_id FROM pl3 UNION SELECT node_id FROM t3 UNION SELECT node_id FROM a3""", _CONFIRMED))
def stale_after_confirm(fx):
    """What is still stale after every result was checked and confirmed."""
    nodes, edges, recorded = stored(fx)
    asked = nodes.where("type = 'result'").select(
        "project_id", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit("checked").alias("why"))
    after, _ = staleness.apply_confirmations(nodes, edges, recorded, asked)
    return Staleness(nodes, edges, after).stale_nodes().select("node_id")


@query(with_tables(["fx_node", "fx_edge", "fx_recorded"], """
SELECT DISTINCT 'R' || c_nationkey AS node_id, 'N' || c_nationkey AS parent_id, CAST(1 + c_nationkey % 3 AS INT) AS recorded
FROM customer WHERE c_nationkey IN (SELECT r_regionkey FROM region)
UNION SELECT 'SU' || s_suppkey, 'C' || c_custkey, CAST(1 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS INT)
FROM supplier JOIN customer ON c_custkey = s_suppkey"""))
def adopted_parents(fx):
    """Inputs that enter the records when nations are linked to regions and customers to suppliers of the same number."""
    nodes, edges, recorded = stored(fx)
    regions = fx.table("customer").join(fx.table("region"), F.expr("c_nationkey = r_regionkey")).selectExpr(
        "'p0' AS project_id", "concat('N', c_nationkey) AS source", "concat('R', c_nationkey) AS target").distinct()
    pairs = fx.table("supplier").join(fx.table("customer"), F.expr("s_suppkey = c_custkey")).selectExpr(
        "'p0' AS project_id", "concat('C', c_custkey) AS source", "concat('SU', s_suppkey) AS target")
    new = regions.unionByName(pairs).withColumn("rel", F.lit("derives"))
    both = edges.select("project_id", "source", "target", "rel").unionByName(new)
    touched = new.select("project_id", F.col("target").alias("node_id")).distinct()
    after = staleness.adopt_parents(nodes, both, recorded, touched)
    return after.join(recorded, ["project_id", "node_id", "parent_id"], "left_anti").select(
        "node_id", "parent_id", F.col("recorded").cast("int").alias("recorded"))


@query(with_tables(["fx_node", "fx_edge", "st_all"], """
SELECT node_id, CAST(dense_rank() OVER (ORDER BY depth) AS INT) AS place FROM stale_depth""", """
walk(node_id, depth) AS (
  SELECT node_id, 0 FROM fx_node WHERE node_id NOT IN (SELECT target FROM fx_edge)
  UNION SELECT e.target, depth + 1 FROM walk JOIN fx_edge e ON e.source = node_id),
stale_depth AS (SELECT node_id, max(depth) AS depth FROM walk WHERE node_id IN (SELECT node_id FROM st_all)
                GROUP BY node_id)""", True))
def rebuild_order(fx):
    """Stale artifacts in the order to rebuild them: those with the same place do not wait for each other."""
    nodes, edges, recorded = stored(fx)
    stale = Staleness(nodes, edges, recorded).stale_nodes()
    return staleness.rebuild_order(nodes, edges, stale).select("node_id", "place")


def asof(fx):
    """Staleness at a past moment: each user's page was built from an even version of the user before it."""
    saved = versions.assign_versions(fx.snapshots(), F.date_trunc("day", "ts"))
    then = staleness.version_asof(saved, F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"))
    users = fx.snapshots().select("project_id", "node_id").distinct()
    nodes = (users.join(then, ["project_id", "node_id"], "left")
             .withColumn("type", F.lit("result")).withColumn("final_version", F.lit(None).cast("int")))
    before = F.concat(F.lit("U"), F.substring("node_id", 2, 20).cast("long") - 1)
    links = users.select("project_id", before.alias("source"), F.col("node_id").alias("target")).join(
        users.select("project_id", F.col("node_id").alias("source")), ["project_id", "source"], "left_semi")
    edges = links.select("project_id", "source", "target", F.lit("derives").alias("rel"),
                         F.concat("source", F.lit(">"), "target").alias("edge_id"),
                         F.lit(None).cast("int").alias("placed_version"))
    now = then.select("project_id", F.col("node_id").alias("source"), F.col("current_version").alias("now"))
    recorded = links.join(now, ["project_id", "source"]).select(
        "project_id", F.col("target").alias("node_id"), F.col("source").alias("parent_id"),
        (F.col("now") - F.col("now") % 2).alias("recorded"))
    return Staleness(nodes, edges, recorded)


@query(with_tables(["fx_snapshot", "fx_version"], """
SELECT DISTINCT 'U' || (1 + CAST(substring(v.node_id, 2) AS BIGINT)) AS node_id
FROM (SELECT node_id, max(v) AS now FROM fx_version WHERE ts <= TIMESTAMP '2024-01-05 00:00:00' GROUP BY node_id) v
WHERE now % 2 = 1 AND 'U' || (1 + CAST(substring(v.node_id, 2) AS BIGINT)) IN (SELECT node_id FROM fx_snapshot)"""))
def stale_asof(fx):
    """Direct staleness at a past moment."""
    return asof(fx).direct().select("node_id").distinct()


@query()
def stale_asof_all(fx):
    """All that was out of date at a past moment, directly or behind a stale page."""
    return asof(fx).stale_nodes().select("node_id").distinct()


_MOMENTS = ("2024-01-03 12:00:00", "2024-01-10 00:00:00", "2024-01-25 06:30:00")


@query(with_tables(["fx_version"], f"""
SELECT moment, node_id FROM reach""", f"""
moments AS (SELECT CAST(m AS TIMESTAMP) AS moment FROM (VALUES {', '.join(f"('{m}')" for m in _MOMENTS)}) t(m)),
users AS (SELECT DISTINCT node_id FROM fx_version),
newest AS (SELECT moment, node_id, max(v) AS now FROM fx_version, moments WHERE ts <= moment GROUP BY moment, node_id),
reach(moment, node_id) AS (
  SELECT c.moment, c.node_id FROM newest c JOIN newest p ON p.moment = c.moment AND p.node_id = 'U' || (CAST(substring(c.node_id, 2) AS BIGINT) - 1)
  WHERE c.now >= 2 AND p.now <> c.now - c.now % 2 AND CAST(substring(c.node_id, 2) AS BIGINT) % 8 <> 0
  UNION SELECT r.moment, u.node_id FROM reach r JOIN users u ON u.node_id = 'U' || (CAST(substring(r.node_id, 2) AS BIGINT) + 1)
  WHERE CAST(substring(u.node_id, 2) AS BIGINT) % 8 <> 0)""", True))
def stale_moments(fx):
    """What was out of date at several moments, from one run over all times: version v of a user's page was built from version
    v - v % 2 of the page of the user before, in rows of eight users."""
    saved, _ = cut(versions.assign_versions(fx.snapshots(), F.date_trunc("day", "ts")), "versions")
    users = saved.select("project_id", "node_id").distinct()
    nodes = users.withColumn("type", F.lit("result")).withColumn("final_version", F.lit(None).cast("int"))
    before = F.concat(F.lit("U"), F.substring("node_id", 2, 20).cast("long") - 1)
    links = users.where(F.substring("node_id", 2, 20).cast("long") % 8 != 0).select("project_id", before.alias("source"), F.col("node_id").alias("target")).join(
        users.select("project_id", F.col("node_id").alias("source")), ["project_id", "source"], "left_semi")
    edges = links.select("project_id", "source", "target", F.lit("derives").alias("rel"), F.concat("source", F.lit(">"), "target").alias("edge_id"),
                         F.lit(None).cast("int").alias("placed_version"))
    recorded = saved.where("v >= 2").join(edges.select("project_id", F.col("target").alias("node_id")), ["project_id", "node_id"], "left_semi").select("project_id", "node_id", "v", before.alias("parent_id"), (F.col("v") - F.col("v") % 2).alias("recorded"))
    spans, _ = cut(staleness.staleness_spans(nodes, edges, saved, recorded), "spans")
    at = lambda m: F.expr(f"TIMESTAMP_NTZ '{m}'")
    return reduce(DataFrame.unionByName, [staleness.staleness_asof(spans, at(m)).select(at(m).alias("moment"), "node_id") for m in _MOMENTS])
