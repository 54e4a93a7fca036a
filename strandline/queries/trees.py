"""The tree of analyses over the fixture tables."""

from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import trees
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql

_NUMBERS = """
placed AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord, start, key)
                     - CASE WHEN min(ord) OVER (PARTITION BY parent) = 0 THEN 1 ELSE 0 END AS n FROM fx_analysis),
num(key, number, depth) AS (
  SELECT key, CAST(n AS VARCHAR), 0 FROM placed WHERE parent IS NULL
  UNION ALL SELECT p.key, num.number || '.' || p.n, depth + 1 FROM placed p JOIN num ON num.key = p.parent)"""
_HIDDEN = """
hid(key) AS (SELECT key FROM fx_analysis WHERE hidden
             UNION SELECT a.key FROM fx_analysis a JOIN hid ON hid.key = a.parent)"""


@query(with_tables(["fx_analysis"], "SELECT key, number, CAST(depth AS INT) AS depth FROM num", _NUMBERS, True))
def analysis_numbers(fx):
    return trees.analysis_numbers(fx.analyses()).select("key", "number", "depth")


@query(with_tables(["fx_analysis"], "SELECT key FROM hid", _HIDDEN, True))
def hidden_analyses(fx):
    return trees.hidden_analyses(fx.analyses()).select("key")


@query(with_tables(["fx_analysis", "fx_edge", "fx_node"], """
SELECT node_id, 'hidden' AS reason FROM by_hand
UNION ALL SELECT node_id, 'part of hidden analysis ' || key FROM by_analysis
UNION ALL SELECT node_id, 'only used by hidden items' FROM pl
UNION ALL SELECT node_id, 'only used by hidden items' FROM src
UNION ALL SELECT node_id, 'only used by hidden items' FROM nat
UNION ALL SELECT node_id, 'only used by hidden items' FROM reg""", _HIDDEN + """,
by_hand AS (SELECT 'T' || o_custkey AS node_id FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey
            WHERE c_mktsegment = 'BUILDING'
            UNION SELECT 'O' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'),
listing AS (SELECT 'C' || regexp_extract(key, 'c([0-9]+)$', 1) AS node_id, key FROM fx_analysis WHERE key LIKE '%.c%'),
by_analysis AS (SELECT node_id, key FROM listing WHERE key IN (SELECT key FROM hid)),
pl AS (SELECT 'PL' || o_orderkey AS node_id FROM orders WHERE 'O' || o_orderkey IN (SELECT node_id FROM by_hand)),
src AS (SELECT source AS node_id FROM fx_edge WHERE rel = 'feeds' AND source NOT LIKE 'C%' GROUP BY source
        HAVING bool_and(target IN (SELECT node_id FROM pl))),
nat AS (SELECT source AS node_id FROM fx_edge WHERE rel = 'derives' AND source LIKE 'N%' GROUP BY source
        HAVING bool_and(target IN (SELECT node_id FROM by_analysis UNION SELECT node_id FROM src))),
reg AS (SELECT source AS node_id FROM fx_edge WHERE rel = 'derives' AND source LIKE 'R%' GROUP BY source
        HAVING bool_and(target IN (SELECT node_id FROM nat)))""", True))
def hidden_nodes(fx):
    """Customers of hidden analyses, and everything made for the building trade, which is hidden by hand."""
    trade = fx.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = fx.table("orders").join(trade, "o_custkey", "left_semi")
    marks = (orders.selectExpr("concat('T', o_custkey) AS node_id").unionByName(
        orders.selectExpr("concat('O', o_orderkey) AS node_id")).distinct().withColumn("hidden", F.lit(True)))
    nodes = fx.nodes().join(marks, "node_id", "left")
    return trees.hidden_nodes(nodes, fx.edges(), fx.analyses(), fx.analysis_nodes()).select("node_id", "reason")


@query(with_tables(["fx_analysis"], """
SELECT key, (SELECT count(*) FROM pairs WHERE above = f.key) AS below FROM fx_analysis f""", """
pairs(key, above) AS (SELECT key, parent FROM fx_analysis WHERE parent IS NOT NULL
  UNION ALL SELECT p.key, a.parent FROM pairs p JOIN fx_analysis a ON a.key = p.above WHERE a.parent IS NOT NULL)""", True))
def subtree_sizes(fx):
    return trees.subtree_sizes(fx.analyses()).select("key", "below")


@query(with_tables(["fx_analysis"], """
SELECT c_custkey AS id, 'after ' || n.number || ' “' || a.title || '”. Not @x' || c_custkey || ', ' || m.number || ' “' || c_name
       || '”' AS text
FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN fx_analysis a ON a.key = 'r' || n_regionkey || '.n' || n_nationkey JOIN num n ON n.key = a.key
JOIN num m ON m.key = a.key || '.c' || c_custkey""", _NUMBERS, True))
def expanded_refs(fx):
    texts = fx.table("customer").join(fx.table("nation"), F.expr("n_nationkey = c_nationkey")).selectExpr(
        "'p0' AS project_id", "c_custkey AS id",
        "concat('after @r', n_regionkey, '.n', n_nationkey, '. Not @x', c_custkey, ', @r', n_regionkey, '.n', n_nationkey,"
        " '.c', c_custkey) AS text")
    return trees.expand_refs(texts, fx.analyses()).select("id", "text")


@query("""
SELECT 'c' || c_custkey AS key, CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE row_number() OVER (
  PARTITION BY c_nationkey ORDER BY c_custkey) END AS INT) AS ord FROM customer""")
def analysis_order(fx):
    """Customers as a flat list below nations; those in debt bring an order of their own."""
    rows = fx.table("customer").selectExpr(
        "'p0' AS project_id", "concat('c', c_custkey) AS key", "concat('n', c_nationkey) AS parent",
        "c_custkey AS seq", "IF(c_acctbal < 0, 0, NULL) AS ord")
    return trees.default_order(rows, F.expr("seq div 1000")).select("key", "ord")


@query("""
WITH kids AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer)
SELECT 'p' || n_nationkey AS project_id, 'old' AS key, NULL AS parent, 5 AS ord, 'Old' AS title FROM nation
UNION ALL SELECT 'p' || n_nationkey, 'n', NULL, 1, CASE WHEN n_nationkey % 5 = 0 THEN 'Kept' ELSE n_name END FROM nation
UNION ALL SELECT 'p' || c_nationkey, 'c' || c_custkey, 'n', CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE place END AS INT), c_name FROM kids
WHERE c_nationkey % 5 <> 0
UNION ALL SELECT 'p' || n_nationkey, 'late', 'old', 1, 'Late' FROM nation WHERE n_nationkey % 5 <> 0""")
def loaded_tree(fx):
    """A guide for each nation: its customers below it, those in debt with an order of their own, and a flat entry below a known one.
    Every fifth guide names a parent that is nowhere, and changes nothing."""
    child = F.struct(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("title"),
                     F.when(F.col("c_acctbal") < 0, "0").alias("order"))
    guides = fx.table("customer").groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", child.alias(
        "entry")))), lambda c: c["entry"]).alias("children")).join(fx.table("nation"), F.expr("c_nationkey = n_nationkey"), "right")
    late = F.struct(F.lit("late").alias("key"), F.lit("Late").alias("title"), F.when(F.col("n_nationkey") % 5 == 0, "nowhere").otherwise("old").alias("parent"))
    guide = F.concat(F.lit("["), F.to_json(F.struct(F.lit("n").alias("key"), F.col("n_name").alias("title"), "children")), F.lit(","),
                     F.to_json(late), F.lit("]"))
    documents = guides.select(F.concat(F.lit("p"), "n_nationkey").alias("project_id"), F.lit(1).alias("id"), guide.alias("json"))
    known = fx.table("nation").selectExpr("concat('p', n_nationkey) AS project_id", "inline(array(struct('old' AS key, 'Old' AS title, 5 AS ord),"
                                          " struct('n' AS key, 'Kept' AS title, 1 AS ord)))")
    known = known.selectExpr("project_id", "key", "CAST(NULL AS STRING) AS parent", "ord", "'' AS start", "title", "false AS hidden")
    return trees.load_analysis_tree(documents, known)[1].select("project_id", "key", "parent", "ord", "title")


@query(with_tables(["fx_analysis"], """
SELECT key, CASE WHEN key LIKE '%.c%' THEN split_part(key, '.', 1) ELSE parent END AS parent FROM fx_analysis
WHERE key LIKE '%.c%' OR key NOT LIKE '%.n%'"""))
def removed_analyses(fx):
    """The tree after all nations were taken out: customers move up to their region."""
    tree = fx.analyses()
    nations = fx.table("nation").selectExpr("'p0' AS project_id",
                                            "concat('r', n_regionkey, '.n', n_nationkey) AS key")
    return trees.remove_analysis(tree, nations).select("key", "parent")
