"""Organised copies over the fixture tables."""

from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import layout
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


def steps(fx):
    """Three defined steps; the writing step has no folder of its own."""
    rows = fx.nodes().select("project_id", "step").distinct()
    number = F.when(F.col("step") == "sources", 1).when(F.col("step") == "process", 2).when(F.col("step") == "outputs", 3)
    label = F.when(F.col("step") == "sources", "All sources!").when(F.col("step") == "process", " Process ").when(
        F.col("step") == "outputs", "Données: results")
    return rows.select("project_id", "step", number.alias("ord"), label.alias("step_label")).where("ord IS NOT NULL")


def named_nodes(fx):
    """Parts named after their product, so that names clash inside a brand."""
    named = fx.table("part").selectExpr("concat('P', p_partkey) AS node_id", "concat('raw/', p_name, '.tsv') AS other")
    return fx.nodes().join(named, "node_id", "left").withColumn("path", F.coalesce("other", "path")).drop("other")


_FOLDER = """folder AS (SELECT node_id, CASE step WHEN 'sources' THEN '01_All_sources' WHEN 'process' THEN '02_Process'
  WHEN 'outputs' THEN '03_Données_results' ELSE '00_No_step' END || CASE WHEN grp IS NULL THEN ''
  ELSE '/' || replace(grp, '#', '_') END AS folder FROM fx_node)"""


@query(with_tables(["fx_node"], "SELECT node_id, folder FROM folder", _FOLDER))
def layout_folder(fx):
    return layout.layout_folder(fx.nodes(), steps(fx)).select("node_id", "folder")


@query(with_tables(["fx_node"], """
SELECT p.node_id, folder, CASE WHEN count(*) OVER (PARTITION BY folder, base) > 1 OR c.at IS NOT NULL THEN p.node_id || '_' || base
       ELSE base END AS name FROM placed p LEFT JOIN (SELECT '03_Données_results/T' || (o_orderkey + 7) || '.tsv' AS at,
       'O' || o_orderkey AS owner FROM orders) c ON c.at = folder || '/' || base AND c.owner <> p.node_id""", _FOLDER + """,
placed AS (SELECT n.node_id, folder, CASE WHEN n.node_id LIKE 'P%' AND n.type = 'raw' THEN p_name || '.tsv'
                  ELSE regexp_extract(path, '([^/]*)$', 1) END AS base
           FROM fx_node n JOIN folder f USING (node_id) LEFT JOIN part ON n.node_id = 'P' || p_partkey WHERE path IS NOT NULL)"""))
def layout_name(fx):
    copies = fx.table("orders").selectExpr("'p0' AS project_id", "concat('O', o_orderkey) AS node_id",
                                           "concat('03_Données_results/T', o_orderkey + 7, '.tsv') AS copy_path")
    nodes = named_nodes(fx)
    return layout.layout_name(nodes, layout.layout_folder(nodes, steps(fx)), copies).select("node_id", "folder", "name")


def copies(fx):
    """Recorded copies of results: paid ones lie in an old folder, low-priority ones share a place per customer."""
    return fx.table("orders").selectExpr(
        "'p0' AS project_id", "concat('O', o_orderkey) AS node_id",
        "CASE WHEN o_orderpriority = '5-LOW' THEN concat('low', o_custkey, '.tsv') ELSE concat('O', o_orderkey, '.tsv') END AS name",
        "concat(IF(o_orderstatus = 'P', '02_Old', '03_Données_results'), '/', CASE WHEN o_orderpriority = '5-LOW' THEN"
        " concat('low', o_custkey, '.tsv') ELSE concat('O', o_orderkey, '.tsv') END) AS copy_path",
        "concat(IF(o_orderpriority = '2-HIGH', 'lost/O', 'results/O'), o_orderkey, '.tsv') AS source",
        "concat('hO', o_orderkey) AS source_hash", "1000 + o_orderkey AS size", "o_orderkey AS source_mtime",
        "o_totalprice < 20000 AS gone")


_COPIES = """copies AS (SELECT *, 'O' || o_orderkey AS node_id,
  CASE WHEN o_orderstatus = 'P' THEN '02_Old' ELSE '03_Données_results' END || '/' ||
  CASE WHEN o_orderpriority = '5-LOW' THEN 'low' || o_custkey ELSE 'O' || o_orderkey END || '.tsv' AS copy_path FROM orders)"""


@query("WITH " + _COPIES + """
SELECT node_id, copy_path AS old, replace(copy_path, '02_Old', '03_Données_results') AS new FROM copies WHERE o_orderstatus = 'P'""")
def layout_moves(fx):
    return layout.layout_moves(layout.layout_folder(fx.nodes(), steps(fx)), copies(fx)).select("node_id", "old", "new")


@query("WITH " + _COPIES + " SELECT copy_path, count(*) AS claims FROM copies GROUP BY copy_path HAVING count(*) > 1")
def copy_conflicts(fx):
    return layout.copy_conflicts(copies(fx)).select("copy_path", "claims")


@query("WITH " + _COPIES + """
SELECT node_id, CASE WHEN bool_and(o_totalprice < 20000) OVER (PARTITION BY copy_path) THEN 'copy_missing'
  WHEN count(*) OVER (PARTITION BY copy_path) > 1 THEN 'copy_conflict' WHEN o_orderpriority = '2-HIGH' THEN 'source_missing'
  WHEN o_orderpriority = '1-URGENT' THEN 'source_changed' ELSE 'ok' END AS state FROM copies""")
def copy_state(fx):
    records = copies(fx)
    destination = records.where("NOT gone").select("project_id", F.col("copy_path").alias("path")).distinct()
    return layout.copy_state(records, destination, fx.disk()).select("node_id", "state")


@query(with_tables(["fx_inventory", "fx_copies"], """
SELECT owner, CAST(sum(s) AS BIGINT) AS source_size, CAST(sum(c) AS BIGINT) AS copy_size, CAST(sum(sn) AS BIGINT) AS source_files,
       CAST(sum(cn) AS BIGINT) AS copy_files, sum(s) = sum(c) AND sum(sn) = sum(cn) AS up_to_date FROM (
  SELECT folder AS owner, size AS s, 0 AS c, 1 AS sn, 0 AS cn FROM fx_inventory
  UNION ALL SELECT i.folder, 0, k.size, 0, 1 FROM fx_copies k JOIN fx_inventory i ON i.owner = k.owner AND i.name = k.name
) GROUP BY owner"""))
def copy_check(fx):
    files = fx.inventory()
    copied = fx.copies().join(files.select("project_id", "owner", "name", "folder"), ["project_id", "owner", "name"])
    by_folder = copied.select("project_id", F.col("folder").alias("owner"), "size")
    return layout.copy_check(files.select("project_id", F.col("folder").alias("owner"), "size"), by_folder).drop("project_id")


@query(with_tables(["fx_inventory", "fx_copies"], """
SELECT i.owner, i.name, CASE WHEN c.hash IS NULL THEN 'missing' WHEN c.hash = i.hash THEN 'ok' ELSE 'bad' END AS verdict
FROM fx_inventory i LEFT JOIN fx_copies c ON c.owner = i.owner AND c.name = i.name"""))
def manifest_verify(fx):
    return layout.manifest_verify(fx.manifest(), fx.copies()).drop("project_id")


@query(with_tables(["fx_inventory", "fx_copies"], """
SELECT i.owner, count(c.hash) AS checked, count(*) FILTER (c.hash <> i.hash) AS bad, count(*) FILTER (c.hash IS NULL) AS missing,
       bool_and(coalesce(c.hash = i.hash, false)) AS ok
FROM fx_inventory i LEFT JOIN fx_copies c ON c.owner = i.owner AND c.name = i.name GROUP BY i.owner"""))
def manifest_summary(fx):
    return layout.manifest_summary(layout.manifest_verify(fx.manifest(), fx.copies())).drop("project_id")


@query(with_tables(["fx_inventory"], """
SELECT path FROM fx_inventory WHERE folder = 'src1/en' OR owner = 'src2' OR (owner LIKE 'src1_' AND path LIKE '%.tsv')"""))
def selected_files(fx):
    return layout.selected_files(fx.inventory(), ["src1/en", "src2", "src1?/*/*.tsv", "absent"])[0].select("path")


@query(with_tables(["fx_inventory"], "SELECT entry FROM (VALUES ('absent'), ('src2/*.tsv')) t(entry)"))
def empty_patterns(fx):
    return layout.selected_files(fx.inventory(), ["src1/en", "absent", "src2/*.tsv"])[1]


@query(with_tables(["fx_node"], """
SELECT 'C' || c_custkey AS node_id, 'skipped' AS reason FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'O' || o_orderkey, 'large' FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) * 10000 > 4294967296"""))
def held_back(fx):
    debt = fx.table("customer").where("c_acctbal < 0").selectExpr("concat('C', c_custkey) AS node_id", "true AS organize_skip")
    sizes = fx.table("orders").selectExpr("'p0' AS project_id", "concat('O', o_orderkey) AS node_id",
                                          "CAST(floor(o_totalprice) AS BIGINT) * 10000 AS size")
    return layout.held_back(fx.nodes().join(debt, "node_id", "left"), sizes).select("node_id", "reason")


@query(with_tables(["fx_inventory"], """
SELECT path AS before, 'archive/one' || substring(path, 5) AS after FROM fx_inventory WHERE owner = 'src1'"""))
def relocated_paths(fx):
    return layout.relocated(fx.inventory(), "path", "src1/", "archive\\one").select("before", "after")


_JOB = """job AS (SELECT 'J' || user_id AS job_id, 'U' || user_id AS node_id, min(ts) AS started, max(ts) AS heartbeat,
  arg_max(event_type, (ts, event_id)) AS last, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes_done,
  count(*) * 100 AS bytes_total FROM events GROUP BY user_id)"""


def jobs(fx):
    """Each user's events as heartbeats of one copy job."""
    return fx.table("events").groupBy("user_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("heartbeat"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last"),
        F.sum(F.floor("value").cast("long")).alias("bytes_done"), (F.count(F.lit(1)) * 100).alias("bytes_total")).selectExpr(
        "'p0' AS project_id", "concat('J', user_id) AS job_id", "concat('U', user_id) AS node_id", "started", "heartbeat",
        "CASE last WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'copying' END AS state", "'copy' AS kind",
        "started AS created", "bytes_done", "bytes_total")


@query("WITH " + _JOB + """
SELECT job_id, CAST(floor(least(100.0, 100 * bytes_done / bytes_total)) AS BIGINT) AS percent,
       CAST(floor(1000000 * CASE WHEN s > 1 THEN bytes_done / s ELSE 0 END) AS BIGINT) AS rate
FROM (SELECT *, epoch(date_trunc('second', heartbeat)) - epoch(date_trunc('second', started)) AS s FROM job)""")
def job_progress(fx):
    done = layout.job_progress(jobs(fx))
    return done.select("job_id", F.floor("percent").alias("percent"), F.floor(1000000 * F.col("rate")).alias("rate"))


@query("WITH " + _JOB + """,
st AS (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', heartbeat)) AS silent,
              CASE last WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'copying' END AS state0 FROM job),
st2 AS (SELECT *, CASE WHEN state0 = 'copying' AND silent > 7200 THEN 'interrupted' ELSE state0 END AS state FROM st)
SELECT job_id, state FROM st2 WHERE NOT (state IN ('interrupted', 'error') AND bytes_done > 3400)
  AND NOT (state IN ('done', 'error') AND silent > 36000)""")
def job_states(fx):
    """Jobs at the end of the month; busy ones were copied again later."""
    again = jobs(fx).where("bytes_done > 3400").selectExpr("project_id", "node_id", "heartbeat AS copied")
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    return layout.job_states(jobs(fx), again, now, timeout=7200, keep=36000).select("job_id", "state")
