"""Network questions over the fixture tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.fixtures.tables import PROJECT
from strandline.operators import graph
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


def seeds_of(fx, kind):
    return fx.nodes().where(F.col("type") == kind).select("project_id", F.col("node_id").alias("seed"))


def nation_seeds(fx):
    return fx.table("nation").selectExpr(f"'{PROJECT}' AS project_id", "concat('N', n_nationkey) AS seed")


@query(with_tables(["fx_node", "fx_edge"], """
SELECT node_id, (SELECT count(*) FROM fx_edge e WHERE e.target = n.node_id) AS n_in,
       (SELECT count(*) FROM fx_edge e WHERE e.source = n.node_id) AS n_out FROM fx_node n"""))
def node_degree(fx):
    return graph.node_degree(fx.nodes(), fx.edges()).select("node_id", "n_in", "n_out")


_WALK = """walk(seed, node_id) AS (
  SELECT node_id, node_id FROM {seeds}
  UNION SELECT w.seed, e.{far} FROM walk w JOIN fx_edge e ON e.{near} = w.node_id {rels})"""


@query(with_tables(["fx_node", "fx_edge"], "SELECT seed, node_id FROM walk WHERE seed <> node_id",
                   _WALK.format(seeds="fx_node WHERE type = 'article'", near="target", far="source", rels=""), True))
def upstream_set(fx):
    return graph.reachable(fx.edges(), seeds_of(fx, "article"), "up").select("seed", "node_id")


@query(with_tables(["fx_node", "fx_edge"], "SELECT seed, node_id FROM walk WHERE seed <> node_id",
                   _WALK.format(seeds="fx_node WHERE step = 'sources' AND node_id LIKE 'N%'", near="source", far="target",
                                rels=""), True))
def downstream_set(fx):
    return graph.reachable(fx.edges(), nation_seeds(fx), "down").select("seed", "node_id")


_TRACE = """walk(seed, node_id, depth) AS (
  SELECT node_id, node_id, 0 FROM {seeds}
  UNION SELECT w.seed, e.{far}, w.depth + 1 FROM walk w JOIN fx_edge e ON e.{near} = w.node_id {rels}),
met AS (SELECT seed, node_id, min(depth) AS depth FROM walk GROUP BY ALL)"""
_TRACED = """SELECT seed, CAST(m.depth AS INT) AS depth, edge_id, source, target, rel
FROM met m JOIN fx_edge e ON e.{near} = m.node_id {rels}"""
_NOT_SOFT = "AND e.rel NOT IN ('documents', 'related', 'variant')"


@query(with_tables(["fx_node", "fx_edge"], _TRACED.format(near="target", rels=_NOT_SOFT),
                   _TRACE.format(seeds="fx_node WHERE type = 'article'", near="target", far="source", rels=_NOT_SOFT),
                   True))
def trace_up(fx):
    return graph.traced_edges(fx.edges(), seeds_of(fx, "article"), "up").drop("project_id")


@query(with_tables(["fx_node", "fx_edge"], _TRACED.format(near="source", rels=""),
                   _TRACE.format(seeds="fx_node WHERE type = 'raw' AND node_id LIKE 'R%'", near="source", far="target",
                                 rels=""), True))
def trace_down(fx):
    regions = fx.table("region").selectExpr(f"'{PROJECT}' AS project_id", "concat('R', r_regionkey) AS seed")
    return graph.traced_edges(fx.edges(), regions, "down").drop("project_id")


@query(with_tables(["fx_edge", "st_feed"], """
SELECT target AS node_id, source AS parent_id FROM fx_edge WHERE rel IN ('feeds', 'produces', 'derives', 'code')
UNION SELECT 'O' || o_orderkey, source FROM st_feed"""))
def effective_parents(fx):
    return graph.effective_parents(fx.nodes(), fx.edges()).select("node_id", "parent_id")


@query("SELECT 'PL' || o_orderkey AS process_id, 'O' || o_orderkey AS node_id FROM orders")
def process_outputs(fx):
    return graph.process_outputs(fx.nodes(), fx.edges()).select("process_id", "node_id")


@query(with_tables(["fx_node", "fx_edge"], """
SELECT w.node_id FROM (SELECT DISTINCT node_id FROM walk WHERE seed IN (SELECT nation FROM cyclic)) w
WHERE node_id IN (SELECT node_id FROM back WHERE seed IN (SELECT nation FROM cyclic))""", """
links AS (SELECT source, target FROM fx_edge UNION SELECT node_id, 'N' || substring(node_id, 2) FROM fx_node WHERE type = 'article'),
walk(seed, node_id) AS (
  SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation
  UNION SELECT seed, target FROM walk JOIN fx_edge ON source = node_id),
back(seed, node_id) AS (
  SELECT 'N' || substring(node_id, 2), node_id FROM fx_node WHERE type = 'article'
  UNION SELECT seed, source FROM back JOIN fx_edge ON target = node_id),
hop AS (SELECT DISTINCT seed AS a, 'N' || substring(node_id, 2) AS b FROM walk WHERE node_id LIKE 'A%'),
hops(a, b) AS (SELECT a, b FROM hop UNION SELECT hops.a, hop.b FROM hops JOIN hop ON hop.a = hops.b),
cyclic AS (SELECT DISTINCT a AS nation FROM hops WHERE a = b)""", True))
def has_cycle(fx):
    """Artifacts caught in cycles once every article also fed the nation it is about."""
    edges = fx.edges().select("project_id", "source", "target")
    planned = fx.nodes().where("type = 'article'").select(
        "project_id", F.col("node_id").alias("source"), F.concat(F.lit("N"), "key").alias("target"))
    return graph.find_cycles(edges.unionByName(planned)).select("node_id")


@query(with_tables(["fx_node", "fx_edge"], """
SELECT p.source || '>' || p.target AS edge_id FROM planned p JOIN walk w ON w.seed = p.target AND w.node_id = p.source""", """
planned AS (SELECT 'A' || c_nationkey AS source, 'C' || c_custkey AS target FROM customer
            WHERE 'A' || c_nationkey IN (SELECT node_id FROM fx_node)),
walk(seed, node_id) AS (
  SELECT DISTINCT target, target FROM planned
  UNION SELECT seed, e.target FROM walk JOIN fx_edge e ON e.source = node_id)""", True))
def cycle_violations(fx):
    """Planned links from each article back to its nation's customers that would close a cycle."""
    papers = fx.nodes().where("type = 'article'").select("project_id", F.col("node_id").alias("source"))
    planned = (fx.table("customer").selectExpr(f"'{PROJECT}' AS project_id", "concat('A', c_nationkey) AS source",
                                               "concat('C', c_custkey) AS target")
               .join(papers, ["project_id", "source"], "left_semi")
               .withColumn("edge_id", F.concat("source", F.lit(">"), "target")))
    return graph.cycle_violations(fx.edges(), planned).select("edge_id")


_DEPTH = with_tables(["fx_node", "fx_edge"], """
SELECT n.node_id, CAST(CASE WHEN i.target IS NULL AND o.first IS NOT NULL THEN greatest(0, o.first - 1) ELSE n.depth END AS INT)
       AS depth
FROM long n LEFT JOIN (SELECT DISTINCT target FROM fx_edge) i ON i.target = n.node_id
LEFT JOIN (SELECT source, min(depth) AS first FROM fx_edge JOIN long ON long.node_id = target GROUP BY source) o
  ON o.source = n.node_id""", """
walk(node_id, depth) AS (
  SELECT node_id, 0 FROM fx_node WHERE node_id NOT IN (SELECT target FROM fx_edge)
  UNION SELECT e.target, depth + 1 FROM walk JOIN fx_edge e ON e.source = node_id),
long AS (SELECT node_id, max(depth) AS depth FROM walk GROUP BY node_id)""", True)


@query(_DEPTH)
def lineage_depth(fx):
    return graph.layers(fx.nodes(), fx.edges()).select("node_id", "depth")


@query(with_tables(["fx_node", "fx_edge"], """
SELECT n.node_id, coalesce('article ' || substring(b.article, 2), '(no article)') AS article
FROM fx_node n LEFT JOIN best b ON b.node_id = n.node_id""", """
up(node_id, article) AS (
  SELECT node_id, node_id FROM fx_node WHERE type = 'article'
  UNION SELECT e.source, article FROM up JOIN fx_edge e ON e.target = node_id AND e.rel NOT IN ('documents', 'related', 'variant')),
best AS (SELECT node_id, min(article) AS article FROM up GROUP BY node_id)""", True))
def article_of(fx):
    return graph.article_of(fx.nodes(), fx.edges()).select("node_id", "article")


@query(with_tables(["fx_branch"], "SELECT node_id, root FROM fx_branch"))
def branch_family(fx):
    return graph.branch_family(fx.branches().select("project_id", "node_id", "of")).select("node_id", "root")


_CASCADE = """
made AS (SELECT * FROM fx_edge WHERE rel NOT IN ('part_of', 'documents')),
nb AS (SELECT a, b, max(into_b) AS into_b FROM (
         SELECT source AS a, target AS b, 1 AS into_b FROM made UNION ALL SELECT target, source, 0 FROM made)
       GROUP BY a, b),
deg AS (SELECT b, count(*) AS degree FROM nb GROUP BY b),
w0 AS (SELECT node_id AS seed, node_id, 0 AS wave FROM fx_node WHERE type <> 'article'
       UNION ALL SELECT 'all of ' || o_custkey, 'O' || o_orderkey, 0 FROM orders),
w1 AS (SELECT seed, node_id, 1 AS wave FROM (
         SELECT g.seed, nb.b AS node_id, count(*) AS lost, max(into_b) AS hit FROM w0 g JOIN nb ON nb.a = g.node_id
         GROUP BY ALL) JOIN deg ON deg.b = node_id WHERE lost = degree AND hit = 1 AND node_id <> seed),
g1 AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1),
w2 AS (SELECT seed, node_id, 2 AS wave FROM (
         SELECT g.seed, nb.b AS node_id, count(*) AS lost, max(into_b) AS hit FROM g1 g JOIN nb ON nb.a = g.node_id
         WHERE g.seed IN (SELECT seed FROM w1) GROUP BY ALL) JOIN deg ON deg.b = node_id
       WHERE lost = degree AND hit = 1 AND (seed, node_id) NOT IN (SELECT seed, node_id FROM g1)),
g2 AS (SELECT * FROM g1 UNION ALL SELECT * FROM w2),
w3 AS (SELECT seed, node_id, 3 AS wave FROM (
         SELECT g.seed, nb.b AS node_id, count(*) AS lost, max(into_b) AS hit FROM g2 g JOIN nb ON nb.a = g.node_id
         WHERE g.seed IN (SELECT seed FROM w2) GROUP BY ALL) JOIN deg ON deg.b = node_id
       WHERE lost = degree AND hit = 1 AND (seed, node_id) NOT IN (SELECT seed, node_id FROM g2)),
cascade AS (SELECT * FROM g2 UNION ALL SELECT * FROM w3)"""


@query(with_tables(["fx_node", "fx_edge"], "SELECT seed, node_id, CAST(wave AS INT) AS wave FROM cascade", _CASCADE))
def removal_cascade(fx):
    """What follows the removal of each artifact, and of all results of a customer, before articles are written."""
    single = fx.nodes().where("type <> 'article'").select("project_id", F.col("node_id").alias("seed"), "node_id")
    together = fx.table("orders").selectExpr(f"'{PROJECT}' AS project_id", "concat('all of ', o_custkey) AS seed",
                                             "concat('O', o_orderkey) AS node_id")
    made = fx.edges().where("rel NOT IN ('part_of', 'documents')")
    return graph.removal_plan(made, single.unionByName(together)).select("seed", "node_id", "wave")


@query()
def removal_cascade_all(fx):
    """What follows over all links: the removal of each artifact and article, of all results of a customer, of an article with
    all results of its customers, and of a nation with all tables of its article."""
    orders = fx.table("orders").join(fx.table("customer").selectExpr("c_custkey AS o_custkey", "c_nationkey"), "o_custkey")
    seeds = [fx.nodes().selectExpr("project_id", "node_id AS seed", "node_id")]
    for rows, seed, node in ((fx.table("orders"), "concat('all of ', o_custkey)", "concat('O', o_orderkey)"),
                             (orders, "concat('article of ', c_nationkey)", "concat('O', o_orderkey)"),
                             (orders, "concat('article of ', c_nationkey)", "concat('A', c_nationkey)"),
                             (orders, "concat('tables of ', c_nationkey)", "concat('T', o_custkey)"),
                             (orders, "concat('tables of ', c_nationkey)", "concat('N', c_nationkey)")):
        seeds.append(rows.selectExpr(f"'{PROJECT}' AS project_id", f"{seed} AS seed", f"{node} AS node_id"))
    return graph.removal_plan(fx.edges(), reduce(DataFrame.unionByName, seeds)).select("seed", "node_id", "wave")


_NATION_GONE = """gone AS (
  SELECT 'N' || n_nationkey AS node_id FROM nation
  UNION SELECT 'C' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION SELECT 'SU' || s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem))"""


def nations_gone(fx):
    """The plans for each nation, taken together."""
    return graph.removal_plan(fx.edges(), nation_seeds(fx).withColumn("node_id", F.col("seed")))


@query(with_tables(["fx_edge"], """
SELECT edge_id, source, target, rel FROM fx_edge
WHERE source NOT IN (SELECT node_id FROM gone) AND target NOT IN (SELECT node_id FROM gone)""", _NATION_GONE))
def after_removal(fx):
    return graph.apply_removal(fx.edges(), nations_gone(fx), ["source", "target"]).select(
        "edge_id", "source", "target", "rel")


@query(with_tables(["fx_node", "fx_edge"], """
SELECT edge_id FROM fx_edge e JOIN fx_node a ON a.node_id = e.source JOIN fx_node b ON b.node_id = e.target
WHERE a.type <> 'raw' AND b.type <> 'raw' AND NOT (a.mode = 'ref' AND a.type = 'result')
  AND NOT (b.mode = 'ref' AND b.type = 'result') AND e.rel <> 'code'"""))
def visible_graph(fx):
    _, links = graph.visible_graph(fx.nodes(), fx.edges(), hidden_types=["raw"], show_refs=False, show_code=False)
    return links.select("edge_id")
