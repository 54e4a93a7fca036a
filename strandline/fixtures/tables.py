"""Lineage tables derived from the generated business tables, for tests, checks and timing.

Customers, suppliers and parts feed an order (a process), the order makes a result, results make a
table per customer, and tables are placed in one article per nation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import with_previous

PROJECT = "p0"


def _case(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            scan = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            self._opened[name] = scan
        return self._opened[name]

    # ------------------------------------------------------------ network
    def _nodes_of(self, rows: DataFrame, prefix: str, key: str, kind: str, step: str, label: str, version: str,
                  group: str = "CAST(NULL AS STRING)", created: str = "TIMESTAMP_NTZ '1990-01-01 00:00:00'",
                  path: str = "CAST(NULL AS STRING)", mode: str = "managed") -> DataFrame:
        version = f"CAST({version} AS INT)"
        return rows.selectExpr(
            f"'{PROJECT}' AS project_id", f"concat('{prefix}', {key}) AS node_id", f"'{kind}' AS type",
            f"{label} AS label", f"'{step}' AS step", f"{group} AS grp",
            f"{version} AS current_version",
            f"CASE WHEN {version} = 2 AND {key} % 2 = 0 THEN 1 END AS final_version",
            f"{created} AS created", f"{path} AS path", f"'{mode}' AS mode", f"CAST({key} AS BIGINT) AS key")

    def nodes(self) -> DataFrame:
        t = self.table
        orders = t("orders")
        papers = (orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
                  .join(t("customer"), "c_custkey").select("c_nationkey").distinct())
        parts = [
            self._nodes_of(t("region"), "R", "r_regionkey", "raw", "sources", "r_name", "1 + r_regionkey % 2"),
            self._nodes_of(t("nation"), "N", "n_nationkey", "input", "sources", "n_name", "1 + n_nationkey % 3"),
            self._nodes_of(t("customer"), "C", "c_custkey", "input", "sources", "c_name",
                           f"1 + {_case('c_custkey % 7 = 0')}", "c_mktsegment",
                           path="concat('data/customers/C', c_custkey, '.tsv')"),
            self._nodes_of(t("supplier"), "SU", "s_suppkey", "input", "sources", "s_name",
                           f"1 + {_case('s_suppkey % 5 = 0')}", path="concat('data/suppliers/SU', s_suppkey, '.tsv')"),
            self._nodes_of(t("part"), "P", "p_partkey", "raw", "sources", "p_name",
                           f"1 + {_case('p_partkey % 11 = 0')}", "p_brand",
                           path="concat('data/parts/P', p_partkey, '.tsv')"),
            self._nodes_of(orders, "PL", "o_orderkey", "pipeline", "process", "concat('order ', o_orderkey)", "1",
                           created="o_orderdate", path="concat('pipelines/PL', o_orderkey, '.smk')"),
            self._nodes_of(orders, "O", "o_orderkey", "result", "outputs", "concat('result ', o_orderkey)",
                           f"1 + {_case('o_orderkey % 13 = 0')}", created="o_orderdate",
                           path="concat('results/O', o_orderkey, '.tsv')", mode="ref"),
            self._nodes_of(orders.select("o_custkey").distinct(), "T", "o_custkey", "table", "outputs",
                           "concat('table ', o_custkey)", f"1 + {_case('o_custkey % 9 = 0')}",
                           path="concat('results/tables/T', o_custkey, '.tsv')"),
            self._nodes_of(papers, "A", "c_nationkey", "article", "writing", "concat('article ', c_nationkey)", "1",
                           path="concat('articles/A', c_nationkey, '.tex')"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def _edges_of(self, rows: DataFrame, source: str, target: str, rel: str, label: str = "CAST(NULL AS STRING)",
                  params: str = "CAST(map() AS MAP<STRING,STRING>)", placed: str = "CAST(NULL AS INT)") -> DataFrame:
        return rows.selectExpr(
            f"'{PROJECT}' AS project_id", f"{source} AS source", f"{target} AS target", f"'{rel}' AS rel",
            f"{params} AS params", f"CAST({placed} AS INT) AS placed_version", f"{label} AS label")

    def edges(self) -> DataFrame:
        t = self.table
        orders, items, customer = t("orders"), t("lineitem"), t("customer")
        places = (orders.select(F.col("o_custkey").alias("c_custkey")).distinct().join(customer, "c_custkey")
                  .select("c_custkey", "c_nationkey"))
        papers = places.select("c_nationkey").distinct()
        parts = [
            self._edges_of(t("nation"), "concat('R', n_regionkey)", "concat('N', n_nationkey)", "derives"),
            self._edges_of(customer, "concat('N', c_nationkey)", "concat('C', c_custkey)", "derives"),
            self._edges_of(t("supplier"), "concat('N', s_nationkey)", "concat('SU', s_suppkey)", "derives"),
            self._edges_of(orders, "concat('C', o_custkey)", "concat('PL', o_orderkey)", "feeds"),
            self._edges_of(items.select("l_suppkey", "l_orderkey").distinct(), "concat('SU', l_suppkey)",
                           "concat('PL', l_orderkey)", "feeds"),
            self._edges_of(items.select("l_partkey", "l_orderkey").distinct(), "concat('P', l_partkey)",
                           "concat('PL', l_orderkey)", "feeds"),
            self._edges_of(orders, "concat('PL', o_orderkey)", "concat('O', o_orderkey)", "produces",
                           params="map('priority', o_orderpriority, 'status', o_orderstatus)"),
            self._edges_of(orders, "concat('O', o_orderkey)", "concat('T', o_custkey)", "derives"),
            self._edges_of(places, "concat('T', c_custkey)", "concat('A', c_nationkey)", "part_of",
                           label="concat('Table ', c_custkey)",
                           placed="CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 1 END"),
            self._edges_of(papers, "concat('N', c_nationkey)", "concat('A', c_nationkey)", "documents"),
        ]
        out = reduce(DataFrame.unionByName, parts)
        return out.withColumn("edge_id", F.concat("source", F.lit(">"), "target", F.lit(":"), "rel"))

    def version_parents(self) -> DataFrame:
        """What the newest version of each data artifact recorded about its effective parents."""
        t = self.table
        orders, items = t("orders"), t("lineitem")
        # (parent prefix, parent key, parent's current version, child prefix, child key)
        pairs = [
            (t("nation"), "R", "n_regionkey", "1 + n_regionkey % 2", "N", "n_nationkey"),
            (t("customer"), "N", "c_nationkey", "1 + c_nationkey % 3", "C", "c_custkey"),
            (t("supplier"), "N", "s_nationkey", "1 + s_nationkey % 3", "SU", "s_suppkey"),
            (orders, "C", "o_custkey", f"1 + {_case('o_custkey % 7 = 0')}", "O", "o_orderkey"),
            (items.select("l_suppkey", "l_orderkey").distinct(), "SU", "l_suppkey",
             f"1 + {_case('l_suppkey % 5 = 0')}", "O", "l_orderkey"),
            (items.select("l_partkey", "l_orderkey").distinct(), "P", "l_partkey",
             f"1 + {_case('l_partkey % 11 = 0')}", "O", "l_orderkey"),
            (orders, "PL", "o_orderkey", "1", "O", "o_orderkey"),
            (orders, "O", "o_orderkey", f"1 + {_case('o_orderkey % 13 = 0')}", "T", "o_custkey"),
        ]
        out = [rows.selectExpr(
            f"'{PROJECT}' AS project_id", f"concat('{cp}', {ck}) AS node_id", f"concat('{pp}', {pk}) AS parent_id",
            f"CASE WHEN ({pk} + {ck}) % 17 = 0 THEN CAST(NULL AS INT) ELSE CAST(greatest({cur} - "
            f"{_case(f'(7 * {pk} + {ck}) % 97 = 0')}, 1) AS INT) END AS recorded")
            for rows, pp, pk, cur, cp, ck in pairs]
        return reduce(DataFrame.unionByName, out)

    def node_versions(self) -> DataFrame:
        """Size, time and content hash recorded with the newest version of each artifact that has a file."""
        return self.nodes().where("path IS NOT NULL").selectExpr(
            "project_id", "node_id", "path", "1000 + key AS size", "key AS mtime", "concat('h', node_id) AS hash")

    def disk(self) -> DataFrame:
        """A later listing: customers in debt lost their file, urgent orders' results were rewritten."""
        nodes = self.nodes().where("path IS NOT NULL")
        lost = self.table("customer").where("c_acctbal < 0").selectExpr("concat('C', c_custkey) AS node_id")
        touched = self.table("orders").selectExpr("concat('O', o_orderkey) AS node_id", "o_orderpriority AS priority")
        return (nodes.join(lost, "node_id", "left_anti").join(touched, "node_id", "left").selectExpr(
            "project_id", "path", "1000 + key AS size",
            "key + CASE WHEN priority IN ('1-URGENT', '5-LOW') THEN 1 ELSE 0 END AS mtime",
            "concat('h', node_id, CASE WHEN priority = '1-URGENT' THEN 'x' ELSE '' END) AS hash"))

    # ----------------------------------------------------------- histories
    def snapshots(self) -> DataFrame:
        return self.table("events").selectExpr(
            f"'{PROJECT}' AS project_id", "concat('U', user_id) AS node_id", "ts", "event_id AS seq",
            "event_type AS hash", "CAST(floor(value) AS BIGINT) AS size",
            "CAST(event_id % 4 AS INT) AS parent_version", "get_json_object(props, '$.k') AS k",
            "CASE WHEN event_type = 'view' THEN '' ELSE concat('because ', event_type) END AS why")

    def events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "concat('p', user_id % 10) AS project_id", "ts", "event_id AS seq", "event_type AS event",
            "CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' ELSE 'watch' END AS actor",
            "concat('U', user_id) AS node", "props AS detail")

    # ---------------------------------------------------------- files
    def _listed(self, more: str) -> DataFrame:
        return self.table("documents").selectExpr(
            "source AS owner", "concat(source, '/', lang) AS folder",
            "concat('d', doc_id, element_at(array('.tsv', '.png', '.py', '.log', '.tex'), CAST(doc_id % 5 AS INT) + 1))"
            " AS name",
            "CAST(octet_length(text) AS BIGINT) AS size", "doc_id AS mtime", more, "doc_id"
        ).withColumn("path", F.concat("folder", F.lit("/"), "name")).withColumn("project_id", F.lit(PROJECT))

    def inventory(self) -> DataFrame:
        return self._listed("sha2(text, 256) AS hash")

    def contents(self) -> DataFrame:
        """The bytes of every listed file."""
        return self._listed("text AS content").select("project_id", "owner", "path", "content")

    def tracked(self) -> DataFrame:
        """The labelled documents are recorded artifacts."""
        return (self.inventory().join(self.table("labels").select("doc_id").distinct(), "doc_id", "left_semi")
                .withColumn("node_id", F.concat(F.lit("D"), "doc_id")))

    def seen(self) -> DataFrame:
        """Earlier listing: English documents, those labelled toxic with another time."""
        marks = self.table("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        english = self.table("documents").where("lang = 'en'").select("doc_id")
        return (self.inventory().join(english, "doc_id", "left_semi").join(marks, "doc_id", "left")
                .select("project_id", "path", "size", (F.col("mtime") + F.coalesce("toxic", F.lit(0))).alias("mtime")))

    def manifest(self) -> DataFrame:
        return self.inventory().select("project_id", "owner", "name", "hash")

    def copies(self) -> DataFrame:
        """Copies at the destination: German ones were not copied, low-quality ones were damaged."""
        marks = self.table("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        kept = self.table("documents").where("lang <> 'de'").select("doc_id")
        return (self.inventory().join(kept, "doc_id", "left_semi").join(marks, "doc_id", "left")
                .select("project_id", "owner", "name",
                        F.when(F.col("quality") == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))
                        .alias("hash"),
                        F.when(F.col("quality") == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size")))

    # ---------------------------------------------------------- trees
    def branches(self) -> DataFrame:
        """Each order is an alternative of the same customer's order before it."""
        orders = self.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
        chained = with_previous(orders, ["o_custkey"], F.date_trunc("quarter", "o_orderdate"),
                                [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderkey"), "before")
        return chained.selectExpr(
            f"'{PROJECT}' AS project_id", "concat('O', o_orderkey) AS node_id",
            "concat('O', before.value) AS of", "CASE o_orderstatus WHEN 'F' THEN 'main' WHEN 'O' THEN 'alternative' "
            "ELSE 'abandoned' END AS status", "o_orderdate AS decided")

    def analyses(self) -> DataFrame:
        """Regions, nations and customers as a tree of analyses; nations of the first region are hidden."""
        t = self.table
        shape = "project_id STRING, key STRING, parent STRING, ord INT, start STRING, title STRING, hidden BOOLEAN"
        names = [c.split()[0] for c in shape.split(", ")]
        top = t("region").selectExpr(
            f"'{PROJECT}' AS project_id", "concat('r', r_regionkey) AS key", "CAST(NULL AS STRING) AS parent",
            "CAST(r_regionkey AS INT) AS ord", "'' AS start", "r_name AS title", "false AS hidden")
        mid = t("nation").selectExpr(
            f"'{PROJECT}' AS project_id", "concat('r', n_regionkey, '.n', n_nationkey) AS key",
            "concat('r', n_regionkey) AS parent", "CAST(1 + n_nationkey % 3 AS INT) AS ord", "'' AS start",
            "n_name AS title", "n_regionkey = 0 AS hidden")
        low = t("customer").join(t("nation"), F.expr("c_nationkey = n_nationkey")).selectExpr(
            f"'{PROJECT}' AS project_id", "concat('r', n_regionkey, '.n', n_nationkey, '.c', c_custkey) AS key",
            "concat('r', n_regionkey, '.n', n_nationkey) AS parent", "CAST(1 + c_custkey AS INT) AS ord",
            "c_mktsegment AS start", "c_name AS title", "c_acctbal < -900 AS hidden")
        return top.unionByName(mid).unionByName(low).select(*names)

    def analysis_nodes(self) -> DataFrame:
        """Which artifact each customer analysis lists."""
        return self.analyses().where("key LIKE '%.c%'").selectExpr(
            "project_id", "key", "concat('C', regexp_extract(key, 'c([0-9]+)$', 1)) AS node_id")

    # ---------------------------------------------------------- text
    def tex(self) -> DataFrame:
        """One marked-up file per document: a section head, its text and, for labelled ones, a marker."""
        marks = self.table("labels").select("doc_id").distinct().withColumn("marked", F.lit(1))
        return (self.table("documents").join(marks, "doc_id", "left").selectExpr(
            "source AS article", "concat('d', doc_id, '.tex') AS file", "doc_id",
            "concat('\\\\section{', source, '}\\n', text, CASE WHEN marked = 1 THEN concat(' \\\\ev{E', doc_id % 50, '}') "
            "ELSE '' END) AS text"))

    def evidence(self) -> DataFrame:
        """Evidence register: one row per benchmark passage, some with a mismatch, some cited papers without a file."""
        return self.table("benchmark").selectExpr(
            "concat('E', item_id) AS id", "CASE WHEN item_id % 6 = 0 THEN concat('r', item_id) "
            "ELSE concat('data/q', item_id, '.tsv') END AS target",
            "CASE WHEN item_id % 8 = 0 THEN 'MISMATCH with the text' ELSE '' END AS note",
            "substring(text, 1, 40) AS claim", "item_id")

    def revisions(self) -> DataFrame:
        """Each turn of a conversation and its answer as one suggested change."""
        c = self.table("conversations")
        a, b = c.alias("a"), c.alias("b")
        files = ("array('main.tex', 'sections/methods.tex', 'sections/results.tex', 'notes.tex')")
        decisions = "array('accepted', 'accepted with edits', 'partly applied', 'needs author', 'not applied')"
        return (a.join(b, F.expr("a.conv_id = b.conv_id AND b.turn = a.turn + 1")).selectExpr(
            "concat(a.conv_id, '.', a.turn) AS r_id", "concat('R', a.conv_id % 3) AS round", "b.role AS reviewer",
            f"element_at({files}, CAST(a.turn % 4 AS INT) + 1) AS file", "a.text AS before",
            "b.text AS reviewer_text",
            f"element_at({decisions}, CAST((a.conv_id + a.turn) % 5 AS INT) + 1) AS decision",
            "CASE WHEN a.turn = 0 THEN concat('P', a.conv_id) ELSE concat('P', a.conv_id, ', P', a.conv_id + 1) END"
            " AS proposal",
            "element_at(array('proposed', 'accepted', 'open question'), CAST(a.conv_id % 3 AS INT) + 1) AS status"))

    def hunks(self) -> DataFrame:
        """Pieces of proposals and their decisions: one per conversation turn."""
        return self.table("conversations").selectExpr(
            "concat('P', conv_id) AS proposal", "turn AS n",
            "CASE WHEN length(text) < 60 THEN 'rejected' WHEN length(text) > 20000 THEN 'open' "
            "WHEN length(text) > 1500 THEN 'conflict' ELSE 'accepted' END AS state")

    # ---------------------------------------------------------- batches
    def batch_nodes(self) -> DataFrame:
        """Parts as new artifacts, one batch per first word of the name; sizes and types bring all sorts of mistakes."""
        return self.table("part").selectExpr(
            f"'{PROJECT}' AS project_id", "split(p_name, ' ')[0] AS batch_id", "p_partkey AS seq",
            "CASE WHEN p_size >= 45 THEN concat('k', p_type) ELSE concat('k', p_partkey) END AS key",
            "CASE WHEN p_size = 1 THEN concat('P', p_partkey) WHEN p_size = 2 THEN concat('T', p_partkey)"
            " WHEN p_size = 3 THEN concat('NEW', p_type) END AS id",
            "CASE p_type WHEN 'ECONOMY' THEN 'table' WHEN 'PROMO' THEN 'figure' WHEN 'SMALL' THEN 'raw'"
            " WHEN 'LARGE' THEN 'resource' WHEN 'MEDIUM' THEN 'note' ELSE 'widget' END AS type",
            "CASE WHEN p_size = 4 THEN ' ' WHEN p_size = 5 THEN repeat(p_name, 10) ELSE p_name END AS label",
            "CASE WHEN p_size = 6 THEN 'copied' WHEN p_retailprice > 1000 THEN 'managed' ELSE 'ref' END AS mode",
            "CASE WHEN p_size BETWEEN 6 AND 20 THEN concat('data/parts/P', p_partkey, '.tsv')"
            " WHEN p_size BETWEEN 21 AND 23 THEN concat('gone/', p_partkey) END AS path",
            "CASE WHEN p_size BETWEEN 7 AND 12 THEN concat('data/customers/C', p_partkey, '.tsv') END AS dest",
            "CASE WHEN p_size = 8 THEN NULL WHEN p_size = 9 THEN 'finemapping' ELSE 'sources' END AS step",
            "CASE WHEN p_size > 30 THEN p_name END AS grp", "CASE WHEN p_size < 30 THEN 'http://x' END AS url",
            "CASE WHEN p_size > 25 THEN 'cluster' END AS location", "false AS allow_duplicate")

    def batch_edges(self) -> DataFrame:
        """Order lines as links to those artifacts; heavily taxed returns and those of lost files run backwards."""
        keys = self.batch_nodes().select("batch_id", "key", "path", "dest", F.col("seq").alias("l_partkey"))
        back = "((l_returnflag = 'R' AND l_tax >= 0.08) OR coalesce(path LIKE 'gone/%', false))"
        return self.table("lineitem").join(keys, "l_partkey").selectExpr(
            f"'{PROJECT}' AS project_id", "batch_id", "concat(l_orderkey, '.', l_linenumber, '.', l_partkey) AS n",
            f"CASE WHEN {back} THEN key WHEN l_returnflag = 'R' THEN concat('PL', l_orderkey)"
            " WHEN l_returnflag = 'A' THEN concat('SU', l_suppkey) ELSE concat('X', l_orderkey) END AS src",
            f"CASE WHEN {back} THEN concat('P', l_partkey) ELSE key END AS dst",
            "element_at(array('produces', 'derives', 'feeds', 'code', 'part_of', 'makes', 'related'), l_linenumber) AS rel",
            "CASE WHEN l_discount < 0.025 OR dest IS NOT NULL THEN CAST(map() AS MAP<STRING,STRING>) WHEN l_discount < 0.055"
            " THEN map('L', '5', 'la_marker', '1') ELSE map('font_size', '9', 'alpha', '0.05', 'label_size', '2') END AS params",
            "CASE WHEN l_linestatus = 'F' THEN concat('PL', l_orderkey) WHEN l_linenumber = 2 THEN concat('SU', l_suppkey) END"
            " AS script",
            "CASE WHEN l_quantity < 10 THEN '{\"a\": [1, 2], \"b\": \"x\"}' WHEN l_quantity < 12 THEN '{\"a\": {\"b\": 1}}'"
            " WHEN l_quantity < 14 THEN '[1]' WHEN l_quantity < 16 THEN '{\"a\": [1, [2]], \"c\": null}' END AS params_json")
