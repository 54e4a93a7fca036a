"""Version histories over the fixture tables."""

from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import versions as ops
from strandline.plans import cut
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


def day():
    return F.date_trunc("day", "ts")


def saved(fx):
    return ops.assign_versions(fx.snapshots(), day())


@query(with_tables(["fx_version"], "SELECT node_id, CAST(v AS INT) AS v, ts, hash FROM fx_version"))
def version_history(fx):
    return saved(fx).select("node_id", "v", "ts", "hash")


_CHANGES = """
par AS (SELECT node_id, v, hash AS parent_id, parent_version AS version FROM fx_version
        UNION ALL SELECT node_id, v, 'base', parent_version FROM fx_version),
prm AS (SELECT node_id, v, 'E1' AS edge_id, 'k' AS key, k AS value FROM fx_version
        UNION ALL SELECT node_id, v, 'E' || hash, 'kind', k FROM fx_version)"""


@query(with_tables(["fx_version"], """
SELECT node_id, CAST(v AS INT) AS v, kind, subject, key, before, after FROM (
  SELECT coalesce(n.node_id, o.node_id) AS node_id, coalesce(n.v, o.v + 1) AS v,
         CASE WHEN n.node_id IS NULL THEN 'dropped_input'
              WHEN o.node_id IS NULL THEN 'added_' || CASE WHEN n.parent_id = 'base' THEN 'script' ELSE 'input' END
              WHEN n.parent_id = 'base' THEN 'script' ELSE 'input' END AS kind,
         coalesce(n.parent_id, o.parent_id) AS subject, NULL AS key, CAST(o.version AS VARCHAR) AS before,
         CAST(n.version AS VARCHAR) AS after
  FROM par n FULL JOIN par o ON o.node_id = n.node_id AND o.v = n.v - 1 AND o.parent_id = n.parent_id
  WHERE n.node_id IS NULL OR o.node_id IS NULL OR n.version <> o.version
  UNION ALL
  SELECT n.node_id, n.v, 'param', n.edge_id, n.key, o.value, n.value
  FROM prm n LEFT JOIN prm o ON o.node_id = n.node_id AND o.v = n.v - 1 AND o.edge_id = n.edge_id AND o.key = n.key
  WHERE o.value IS DISTINCT FROM n.value
  UNION ALL
  SELECT n.node_id, n.v, 'content', NULL, NULL, CAST(o.size AS VARCHAR), CAST(n.size AS VARCHAR)
  FROM fx_version n JOIN fx_version o ON o.node_id = n.node_id AND o.v = n.v - 1 WHERE o.size <> n.size
) c JOIN (SELECT node_id AS nid, max(v) AS last FROM fx_version GROUP BY 1) m ON nid = node_id
WHERE v > 1 AND v <= last""", _CHANGES))
def version_changes(fx):
    versions, _ = cut(saved(fx), "versions")  # a stored table, read by each kind of change
    at = ["project_id", "node_id", "v"]
    parents = versions.select(*at, F.explode(F.array(F.col("hash"), F.lit("base"))).alias("parent_id"),
                              F.col("parent_version").alias("version"))
    pairs = F.array(F.struct(F.lit("E1").alias("edge_id"), F.lit("k").alias("key")),
                    F.struct(F.concat(F.lit("E"), "hash").alias("edge_id"), F.lit("kind").alias("key")))
    params = versions.select(*at, F.explode(pairs).alias("p"), F.col("k").alias("value")).select(*at, "p.edge_id", "p.key", "value")
    kinds = fx.spark.range(1).selectExpr("'p0' AS project_id", "'base' AS node_id", "'script' AS type")
    return ops.version_changes(versions, parents, params, kinds).drop("project_id")


def order_links(fx):
    return fx.edges().where("rel = 'produces'")


@query("""
SELECT 'PL' || o_orderkey || '>O' || o_orderkey || ':produces' AS edge_id, key, before, after FROM (
  SELECT o_orderkey, 'priority' AS key, o_orderpriority AS before, '1-URGENT' AS after FROM orders
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'checked', NULL, 'true' FROM orders) WHERE before IS DISTINCT FROM after""")
def param_changes(fx):
    edits = fx.table("orders").selectExpr(
        "'p0' AS project_id", "concat('PL', o_orderkey, '>O', o_orderkey, ':produces') AS edge_id", "'rush' AS why",
        "map('priority', '1-URGENT', 'status', o_orderstatus, 'checked', 'true') AS params")
    return ops.edge_param_changes(order_links(fx), edits).select("edge_id", "key", "before", "after")


def kept_versions(fx):
    """Versions on record: every one up to the current, but customers in debt only keep the current one."""
    debt = fx.table("customer").where("c_acctbal < 0").selectExpr("concat('C', c_custkey) AS node_id", "true AS debt")
    rows = fx.nodes().join(debt, "node_id", "left").selectExpr(
        "*", "explode(CASE WHEN debt THEN array(current_version) ELSE sequence(1, current_version) END) AS v")
    return rows.selectExpr(
        "project_id", "node_id", "v", "mode", "concat('h', node_id, '.', v) AS hash", "'file' AS kind",
        "type <> 'raw' AS exact", "CASE WHEN node_id LIKE 'SU%' AND key > 50 THEN 300000000 ELSE 1000 + key END AS size")


# customers in debt keep their newest version only
_KEEPS = "FROM fx_node LEFT JOIN customer ON node_id = 'C' || c_custkey"


@query(with_tables(["fx_node"], f"""
SELECT node_id, coalesce(final_version, current_version) AS effective,
       coalesce(final_version, current_version) BETWEEN CASE WHEN c_acctbal < 0 THEN current_version ELSE 1 END AND current_version AS valid
{_KEEPS}"""))
def effective_version(fx):
    return ops.effective_version(fx.nodes(), kept_versions(fx)).select("node_id", "effective", "valid")


@query(with_tables(["fx_node"], f"""
SELECT node_id, CAST(1 AS INT) AS v, CASE WHEN c_acctbal < 0 AND current_version > 1 THEN 'no such version'
  WHEN mode <> 'managed' OR type = 'raw' OR (node_id LIKE 'SU%' AND key > 50) THEN 'not stored'
  WHEN node_id LIKE 'T%' AND current_version = 2 THEN 'unsaved changes' END AS problem
{_KEEPS}"""))
def restorable(fx):
    """Can version 1 of everything be restored, while tables in version 2 have unsaved changes?"""
    asked = fx.nodes().select("project_id", "node_id", F.lit(1).alias("v"))
    dirty = fx.nodes().where("type = 'table' AND current_version = 2")
    return ops.restorable(asked, kept_versions(fx), dirty).select("node_id", "v", "problem")


@query(with_tables(["fx_version", "fx_snapshot"], """
SELECT node_id, ts, 'version' AS kind, 'v' || v AS detail, why, v > 1 AND why = '' AS unexplained FROM fx_version
UNION ALL SELECT node_id, ts, 'parameters', 'X>' || node_id || ' k', why, false FROM fx_snapshot WHERE hash = 'error'"""))
def update_timeline(fx):
    edits = fx.snapshots().where("hash = 'error'").select(
        "project_id", F.concat(F.lit("X>"), "node_id").alias("edge_id"), "ts", F.lit("k").alias("key"), "why")
    links = fx.snapshots().select("project_id", F.concat(F.lit("X>"), "node_id").alias("edge_id"),
                                  F.col("node_id").alias("target")).distinct()
    return ops.update_timeline(saved(fx), edits, links).drop("project_id")


@query(with_tables(["fx_version"], """
SELECT node_id, CAST(v AS INT) AS v, hash FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY v DESC) AS r FROM fx_version) WHERE r <= 3"""))
def latest_versions(fx):
    return ops.latest_versions(saved(fx), 3).select("node_id", "v", "hash")


@query("""
SELECT 'PL' || o_orderkey AS source, 'B' || o_orderkey AS target, 'produces' AS rel,
       'priority=9-TRIAL;status=' || o_orderstatus AS params FROM orders
UNION ALL SELECT 'O' || o_orderkey, 'B' || o_orderkey, 'variant', '' FROM orders
UNION ALL SELECT 'O' || o_orderkey, 'BT' || o_custkey, 'derives',
       CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
            THEN 'p=1' ELSE '' END FROM orders
UNION ALL SELECT DISTINCT 'T' || o_custkey, 'BT' || o_custkey, 'variant', '' FROM orders""")
def branch_edges(fx):
    """Links of a trial alternative of every result and of every table."""
    results = fx.table("orders").selectExpr("'p0' AS project_id", "concat('O', o_orderkey) AS node_id",
                                            "concat('B', o_orderkey) AS new_id", "map('priority', '9-TRIAL') AS params")
    tables = fx.table("orders").select("o_custkey").distinct().selectExpr(
        "'p0' AS project_id", "concat('T', o_custkey) AS node_id", "concat('BT', o_custkey) AS new_id",
        "map('p', '1') AS params")
    text = F.array_join(F.array_sort(F.transform(F.map_entries("params"),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return ops.derive_branch(results.unionByName(tables), fx.edges()).select("source", "target", "rel",
                                                                             text.alias("params"))


@query(with_tables(["fx_branch"], """
SELECT node_id, root, CASE WHEN status = 'main' AND node_id <> (
  arg_max(node_id, {'d': decided, 'n': node_id}) FILTER (status = 'main') OVER (PARTITION BY root))
  THEN 'alternative' ELSE status END AS status FROM fx_branch"""))
def branch_main(fx):
    return ops.branch_main(fx.branches()).select("node_id", "root", "status")


@query(with_tables(["fx_edge", "fx_node"], """
SELECT edge_id, placed_version, coalesce(final_version, current_version) AS wanted
FROM fx_edge e JOIN fx_node n ON n.node_id = e.source WHERE rel = 'part_of'
  AND placed_version IS DISTINCT FROM coalesce(final_version, current_version)"""))
def placements_to_sync(fx):
    return ops.placement_refresh(fx.nodes(), fx.edges()).select("edge_id", "placed_version", "wanted")


@query(with_tables(["fx_version"], """
SELECT node_id, arg_max(parent_version, v) AS version FROM fx_version WHERE hash <> 'view' OR v = 1 GROUP BY node_id"""))
def cosmetic_save(fx):
    """Inputs the newest version stands on when `view` saves only changed the looks."""
    versions = saved(fx).withColumn("cosmetic", F.col("hash") == "view")
    parents = versions.select("project_id", "node_id", "v", F.lit("base").alias("parent_id"),
                              F.col("parent_version").alias("version"))
    return ops.cosmetic_parents(versions, parents).select("node_id", "version")


@query(with_tables(["fx_snapshot"], """
SELECT node_id, seq, hash, CAST(row_number() OVER (PARTITION BY node_id ORDER BY last, seq) AS INT) AS v FROM (
  SELECT *, lag(hash) OVER (PARTITION BY node_id ORDER BY last, seq) AS before FROM (
    SELECT node_id, seq, hash, 0 AS last FROM fx_snapshot WHERE hash IN ('view', 'click')
    UNION ALL SELECT node_id, 1000000000 AS seq, arg_max(hash, seq), 1 FROM fx_snapshot GROUP BY node_id))
WHERE before IS NULL OR before <> hash"""))
def backfilled_versions(fx):
    """Views and clicks imported as older copies in front of the newest snapshot."""
    shots = fx.snapshots()
    older = shots.where("hash IN ('view', 'click')").select("project_id", "node_id", "seq", "hash")
    now = shots.groupBy("project_id", "node_id").agg(F.max_by("hash", "seq").alias("hash")).select(
        "project_id", "node_id", F.lit(1000000000).cast("long").alias("seq"), "hash")
    return ops.backfill_versions(older, now, F.expr("seq div 1000")).select("node_id", "seq", "hash", "v")
