"""Counts, groupings and registers over the fixture tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.functions.words import common_label as label_of
from strandline.operators import graph, staleness, summary
from strandline.operators.staleness import Staleness
from strandline.queries.register import Registry
from strandline.queries.staleness import stored
from strandline.sources.catalog import catalog_sections

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


@query(with_tables(["fx_node", "fx_edge"], """
SELECT a.step AS from_step, b.step AS to_step, count(*) AS links FROM fx_edge e JOIN fx_node a ON a.node_id = e.source
JOIN fx_node b ON b.node_id = e.target GROUP BY ALL"""))
def step_flows(fx):
    return summary.step_flows(fx.nodes(), fx.edges()).drop("project_id")


@query(with_tables(["fx_node"], "SELECT step, type, count(*) AS members FROM fx_node GROUP BY ALL"))
def step_members(fx):
    return summary.step_members(fx.nodes()).drop("project_id")


@query(with_tables(["fx_node"], """
SELECT CASE WHEN type IN ('raw', 'input') THEN 'sources' WHEN type = 'pipeline' THEN 'process'
            WHEN type = 'article' THEN 'writing' ELSE 'outputs' END AS category, type, count(*) AS n
FROM fx_node GROUP BY ALL"""))
def category_counts(fx):
    return summary.category_counts(fx.nodes()).drop("project_id")


@query("""
SELECT p.project_id, n.nodes, n.sources, n.outputs, l.links, s.stale, s.missing_files, a.last_activity,
       n.nodes IS NULL AS missing, k.copies, g.analyses, g.organized, w.steps,
       row_number() OVER (ORDER BY a.last_activity DESC NULLS LAST, p.project_id) AS place
FROM (SELECT 'p' || n_nationkey AS project_id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region) p
LEFT JOIN (SELECT 'p' || nk AS project_id, count(*) AS nodes, count(*) FILTER (kind = 'input') AS sources,
                  count(*) FILTER (kind = 'result') AS outputs
           FROM (SELECT c_nationkey AS nk, 'input' AS kind FROM customer UNION ALL SELECT s_nationkey, 'result' FROM supplier)
           GROUP BY 1) n USING (project_id)
LEFT JOIN (SELECT 'p' || c_nationkey AS project_id, count(*) AS links FROM orders JOIN customer ON c_custkey = o_custkey
           GROUP BY 1) l USING (project_id)
LEFT JOIN (SELECT 'p' || nk AS project_id, count(*) FILTER (st = 'stale') AS stale, count(*) FILTER (st = 'missing') AS missing_files
           FROM (SELECT c_nationkey AS nk, CASE WHEN c_acctbal < 0 THEN 'missing' ELSE 'ok' END AS st FROM customer
                 UNION ALL SELECT s_nationkey, CASE WHEN s_acctbal < 0 THEN 'stale' ELSE 'ok' END FROM supplier)
           GROUP BY 1) s USING (project_id)
LEFT JOIN (SELECT 'p' || (user_id % 10) AS project_id, max(ts) AS last_activity FROM events GROUP BY 1) a USING (project_id)
LEFT JOIN (SELECT 'p' || s_nationkey AS project_id, count(*) AS copies FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) k USING (project_id)
LEFT JOIN (SELECT 'p' || c_nationkey AS project_id, count(*) AS analyses, count(*) FILTER (c_acctbal > 0) AS organized FROM customer
           GROUP BY 1) g USING (project_id)
LEFT JOIN (SELECT project_id, list(c_mktsegment ORDER BY n DESC, c_mktsegment) AS steps FROM (
             SELECT 'p' || c_nationkey AS project_id, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1) w USING (project_id)""")
def project_summary(fx):
    """One project per nation: customers as inputs, suppliers as results, rich suppliers have copies, customers' segments are the steps;
    regions are registered without a catalog."""
    t = fx.table
    projects = t("nation").selectExpr("concat('p', n_nationkey) AS project_id").unionByName(
        t("region").selectExpr("concat('r', r_regionkey) AS project_id"))
    nodes = t("customer").selectExpr("concat('p', c_nationkey) AS project_id", "concat('C', c_custkey) AS node_id",
                                     "'input' AS type", "IF(c_acctbal < 0, 'missing', 'ok') AS state").unionByName(
        t("supplier").selectExpr("concat('p', s_nationkey) AS project_id", "concat('S', s_suppkey) AS node_id",
                                 "'result' AS type", "IF(s_acctbal < 0, 'stale', 'ok') AS state"))
    links = t("orders").join(t("customer"), F.expr("c_custkey = o_custkey")).selectExpr(
        "concat('p', c_nationkey) AS project_id")
    analyses = t("customer").selectExpr("concat('p', c_nationkey) AS project_id", "c_acctbal > 0 AS organized")
    steps = t("customer").groupBy("c_nationkey", "c_mktsegment").count().selectExpr(
        "concat('p', c_nationkey) AS project_id", "c_mktsegment AS step", "-count AS ord", "c_mktsegment AS step_label")
    copies = t("supplier").where("s_acctbal > 5000").selectExpr("concat('p', s_nationkey) AS project_id", "concat('S', s_suppkey) AS node_id")
    return summary.project_summary(projects, nodes, links, nodes, fx.events(), analyses, steps, copies).select(
        "project_id", "nodes", "sources", "outputs", "links", "stale", "missing_files", "last_activity", "missing", "copies", "analyses",
        "organized", "steps", "place")


@query(with_tables(["fx_node", "fx_edge", "fx_branch", "fx_analysis", "st_all"], """
SELECT 'stale' AS section, node_id AS item, '' AS detail FROM st_all
UNION ALL SELECT 'tables', node_id, CASE WHEN type IN ('raw', 'input') THEN 'sources' WHEN type = 'pipeline' THEN 'process'
  WHEN type = 'article' THEN 'writing' ELSE 'outputs' END FROM fx_node
UNION ALL SELECT 'links', edge_id, CASE WHEN edge_id LIKE '%:produces' THEN 'red' ELSE 'green' END FROM fx_edge
UNION ALL SELECT 'branches', node_id, root || ' ' || status FROM fx_branch
UNION ALL SELECT 'groups', node_id, grp FROM fx_node WHERE grp IS NOT NULL
UNION ALL SELECT 'analyses', key, CASE WHEN key IN (SELECT key FROM hid) THEN 'hidden' ELSE '' END FROM fx_analysis
UNION ALL SELECT 'steps', step, CAST(count(*) AS VARCHAR) FROM fx_node GROUP BY step""", """
hid(key) AS (SELECT key FROM fx_analysis WHERE hidden UNION SELECT a.key FROM fx_analysis a JOIN hid ON hid.key = a.parent)""", True))
def report_sections(fx):
    """The sections of the written report as one list; an artifact with several reasons is listed once."""
    nodes, edges, recorded = stored(fx)
    groups = nodes.where("grp IS NOT NULL").select("project_id", "node_id", "grp")
    versions = fx.snapshots().selectExpr("project_id", "node_id", "ts", "seq AS v", "why")
    made = catalog_sections(nodes, edges, recorded, fx.analyses(), fx.branches(), groups, versions)
    pick = lambda name, item, detail: made[name].selectExpr(f"'{name}' AS section", f"{item} AS item", f"{detail} AS detail")
    steps = made["steps"].groupBy("step").agg(F.sum("members").alias("members")).selectExpr(
        "'steps' AS section", "step AS item", "CAST(members AS STRING) AS detail")
    return reduce(DataFrame.unionByName, [
        pick("stale", "node_id", "''").distinct(), pick("tables", "node_id", "category"), pick("links", "edge_id", "IF(with_params, 'red', 'green')"),
        pick("branches", "node_id", "concat(root, ' ', status)"), pick("groups", "node_id", "grp"),
        pick("analyses", "key", "IF(out_of_view, 'hidden', '')"), steps])


@query(with_tables(["fx_node", "fx_edge", "st_all"], """
SELECT node_id, 'type' AS by, type AS grp FROM fx_node UNION ALL SELECT node_id, 'step', step FROM fx_node
UNION ALL SELECT node_id, 'group', coalesce(grp, '(ungrouped)') FROM fx_node
UNION ALL SELECT node_id, 'category', CASE WHEN type IN ('raw', 'input') THEN 'sources' WHEN type = 'pipeline' THEN 'process'
  WHEN type = 'article' THEN 'writing' ELSE 'outputs' END FROM fx_node
UNION ALL SELECT n.node_id, 'article', coalesce('article ' || substring(b.article, 2), '(no article)') FROM fx_node n LEFT JOIN best b USING (node_id)
UNION ALL SELECT node_id, 'state', CASE WHEN node_id IN (SELECT node_id FROM st_all) THEN 'stale' ELSE 'ok' END FROM fx_node
UNION ALL SELECT node_id, 'recency', CASE WHEN age < 86400 THEN 'updated today' WHEN age < 604800 THEN 'this week' WHEN age < 2678400 THEN 'this month'
  ELSE 'older' END FROM (SELECT node_id, epoch(TIMESTAMP '1998-08-02 12:00:00' - created) AS age FROM fx_node)""", """
up(node_id, article) AS (
  SELECT node_id, node_id FROM fx_node WHERE type = 'article'
  UNION SELECT e.source, article FROM up JOIN fx_edge e ON e.target = node_id AND e.rel NOT IN ('documents', 'related', 'variant')),
best AS (SELECT node_id, min(article) AS article FROM up GROUP BY node_id)""", True))
def group_nodes(fx):
    """All ways to group the view; what is out of date has the state stale."""
    nodes, edges, recorded = stored(fx)
    verdict = Staleness(nodes, edges, recorded)
    states = verdict.stale_nodes().withColumn("state", F.lit("stale"))
    return summary.group_nodes(nodes.withColumnRenamed("created", "updated"), F.expr("TIMESTAMP_NTZ '1998-08-02 12:00:00'"),
                               graph.article_of(nodes, edges, verdict.typed), states).select("node_id", "by", "grp")


@query(with_tables(["fx_node"], """
SELECT grp, node_id, count(*) OVER (PARTITION BY grp) AS size FROM fx_node WHERE grp IS NOT NULL"""))
def group_members(fx):
    groups = fx.nodes().where("grp IS NOT NULL").select("project_id", "node_id", "grp")
    return summary.group_members(fx.nodes(), groups).select("grp", "node_id", "size")


@query(with_tables(["fx_edge"], """
SELECT 'sources' AS step, 'input' AS type, 'tsv' AS kind, 'feed' AS way, target AS process_id, source AS node_id FROM fx_edge
WHERE rel = 'feeds' AND source LIKE 'SU%'
UNION ALL SELECT 'outputs', 'result', 'tsv', 'made by', source, target FROM fx_edge WHERE rel = 'produces'"""))
def group_candidates(fx):
    return summary.group_candidates(fx.nodes(), fx.edges()).drop("project_id")


@query()
def group_suggestions(fx):
    """Greedy packing: checked against a sequential computation in the tests."""
    return summary.group_suggestions(fx.nodes(), fx.edges()).drop("project_id")


@query(with_tables(["fx_edge", "fx_node", "st_all", "st_placed", "fx_disk"], """
SELECT e.target AS article, e.source AS node_id, e.label, e.placed_version, n.current_version, n.final_version,
       CASE WHEN s.node_id IS NOT NULL THEN 'stale' ELSE 'ok' END AS state, p.edge_id IS NOT NULL AS stale_link,
       row_number() OVER (PARTITION BY e.target ORDER BY e.label, e.source) AS place
FROM fx_edge e JOIN fx_node n ON n.node_id = e.source LEFT JOIN st_all s ON s.node_id = e.source
LEFT JOIN st_placed p ON p.edge_id = e.edge_id WHERE e.rel = 'part_of'"""))
def article_components(fx):
    nodes, edges, recorded = stored(fx)
    verdict = Staleness(nodes, edges, recorded)
    disk = staleness.disk_state(fx.node_versions(), fx.disk())
    states = staleness.node_state(nodes, verdict.stale_nodes(), disk)
    return summary.article_components(nodes, edges, states, verdict.stale_links()).select(
        "article", "node_id", "label", "placed_version", "current_version", "final_version", "state", "stale_link", "place")


@query("""
SELECT 'd' || (doc_id + k) AS node_id, 'PN' || doc_id AS note_id, CASE WHEN toxic = 1 THEN 'issue' ELSE 'note' END AS kind,
       CAST(CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS INT) AS rank
FROM labels, (SELECT 0 AS k UNION ALL SELECT 1) WHERE quality = 1""")
def open_issues(fx):
    notes = fx.table("labels").selectExpr(
        "'p0' AS project_id", "concat('PN', doc_id) AS note_id", "IF(toxic = 1, 'issue', 'note') AS kind",
        "IF(quality = 1, 'open', 'resolved') AS status", "array(concat('d', doc_id), concat('d', doc_id + 1)) AS nodes")
    return summary.notes_of(notes).select("node_id", "note_id", "kind", "rank")


@query("""
SELECT 'p' || p_partkey AS project_id, replace(p_name, ' ', '-') || CASE WHEN r = 1 THEN '' ELSE '-' || r END AS slug
FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)""")
def project_slugs(fx):
    projects = fx.table("part").selectExpr("concat('p', p_partkey) AS project_id", "concat(' ', p_name, '!') AS name",
                                           "p_partkey AS seq")
    return summary.project_slugs(projects, F.expr("seq div 1000")).select("project_id", "slug")


@query("""
SELECT first, p_brand, CASE WHEN count(DISTINCT p_name) = 1 THEN min(p_name) ELSE first END AS label
FROM (SELECT split_part(p_name, ' ', 1) AS first, * FROM part) GROUP BY first, p_brand
HAVING count(DISTINCT substring(split_part(p_name, ' ', 2), 1, 1)) > 1 OR count(DISTINCT p_name) = 1""")
def common_label(fx):
    """Labels of parts by first word and brand, where the second words do not start alike."""
    words = fx.table("part").withColumn("first", F.split("p_name", " ")[0]).withColumn("second", F.split("p_name", " ")[1])
    sets = words.groupBy("first", "p_brand").agg(
        F.min("p_name").alias("a"), F.max("p_name").alias("b"),
        F.min(F.left("second", F.lit(1))).alias("x"), F.max(F.left("second", F.lit(1))).alias("y"))
    return sets.where("x <> y OR a = b").select("first", "p_brand", label_of(F.col("a"), F.col("b")).alias("label"))


@query()
def common_label_all(fx):
    """Labels of parts by first word and brand, also where the second words start alike."""
    sets = fx.table("part").withColumn("first", F.split("p_name", " ")[0]).groupBy("first", "p_brand").agg(
        F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    return sets.select("first", "p_brand", label_of(F.col("a"), F.col("b")).alias("label"))
