"""The same fixture tables as plain SQL text, written independently of the DataFrame form."""

from __future__ import annotations

_CUR = {
    "R": "1 + {k} % 2", "N": "1 + {k} % 3",
    "C": "1 + CASE WHEN {k} % 7 = 0 THEN 1 ELSE 0 END", "SU": "1 + CASE WHEN {k} % 5 = 0 THEN 1 ELSE 0 END",
    "P": "1 + CASE WHEN {k} % 11 = 0 THEN 1 ELSE 0 END", "PL": "1",
    "O": "1 + CASE WHEN {k} % 13 = 0 THEN 1 ELSE 0 END", "T": "1 + CASE WHEN {k} % 9 = 0 THEN 1 ELSE 0 END", "A": "1",
}


def _node(table, prefix, key, kind, step, label, group="NULL", created="TIMESTAMP '1990-01-01 00:00:00'",
          path="NULL", mode="managed"):
    cur = "(" + _CUR[prefix].format(k=key) + ")"
    return (f"SELECT '{prefix}' || {key} AS node_id, '{kind}' AS type, {label} AS label, '{step}' AS step, "
            f"CAST({group} AS VARCHAR) AS grp, CAST({cur} AS INT) AS current_version, "
            f"CAST(CASE WHEN {cur} = 2 AND {key} % 2 = 0 THEN 1 END AS INT) AS final_version, "
            f"CAST({created} AS TIMESTAMP) AS created, CAST({path} AS VARCHAR) AS path, '{mode}' AS mode, "
            f"CAST({key} AS BIGINT) AS key FROM {table}")


_PLACED = "(SELECT DISTINCT c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)"
_PAPERS = f"(SELECT DISTINCT c_nationkey FROM {_PLACED})"

_NODES = " UNION ALL ".join([
    _node("region", "R", "r_regionkey", "raw", "sources", "r_name"),
    _node("nation", "N", "n_nationkey", "input", "sources", "n_name"),
    _node("customer", "C", "c_custkey", "input", "sources", "c_name", "c_mktsegment",
          path="'data/customers/C' || c_custkey || '.tsv'"),
    _node("supplier", "SU", "s_suppkey", "input", "sources", "s_name", path="'data/suppliers/SU' || s_suppkey || '.tsv'"),
    _node("part", "P", "p_partkey", "raw", "sources", "p_name", "p_brand", path="'data/parts/P' || p_partkey || '.tsv'"),
    _node("orders", "PL", "o_orderkey", "pipeline", "process", "'order ' || o_orderkey", created="o_orderdate",
          path="'pipelines/PL' || o_orderkey || '.smk'"),
    _node("orders", "O", "o_orderkey", "result", "outputs", "'result ' || o_orderkey", created="o_orderdate",
          path="'results/O' || o_orderkey || '.tsv'", mode="ref"),
    _node("(SELECT DISTINCT o_custkey FROM orders)", "T", "o_custkey", "table", "outputs", "'table ' || o_custkey",
          path="'results/tables/T' || o_custkey || '.tsv'"),
    _node(_PAPERS, "A", "c_nationkey", "article", "writing", "'article ' || c_nationkey",
          path="'articles/A' || c_nationkey || '.tex'"),
])


def _edge(table, source, target, rel, priority="NULL", status="NULL", placed="NULL", label="NULL"):
    return (f"SELECT {source} AS source, {target} AS target, '{rel}' AS rel, CAST({priority} AS VARCHAR) AS priority, "
            f"CAST({status} AS VARCHAR) AS status, CAST({placed} AS INT) AS placed_version, "
            f"CAST({label} AS VARCHAR) AS label FROM {table}")


_EDGES = ("SELECT *, source || '>' || target || ':' || rel AS edge_id FROM (" + " UNION ALL ".join([
    _edge("nation", "'R' || n_regionkey", "'N' || n_nationkey", "derives"),
    _edge("customer", "'N' || c_nationkey", "'C' || c_custkey", "derives"),
    _edge("supplier", "'N' || s_nationkey", "'SU' || s_suppkey", "derives"),
    _edge("orders", "'C' || o_custkey", "'PL' || o_orderkey", "feeds"),
    _edge("(SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)", "'SU' || l_suppkey", "'PL' || l_orderkey", "feeds"),
    _edge("(SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)", "'P' || l_partkey", "'PL' || l_orderkey", "feeds"),
    _edge("orders", "'PL' || o_orderkey", "'O' || o_orderkey", "produces", "o_orderpriority", "o_orderstatus"),
    _edge("orders", "'O' || o_orderkey", "'T' || o_custkey", "derives"),
    _edge(_PLACED, "'T' || c_custkey", "'A' || c_nationkey", "part_of",
          placed="CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 1 END", label="'Table ' || c_custkey"),
    _edge(_PAPERS, "'N' || c_nationkey", "'A' || c_nationkey", "documents"),
]) + ")")


def _recorded(table, pp, pk, cp, ck):
    cur = "(" + _CUR[pp].format(k=pk) + ")"
    return (f"SELECT '{cp}' || {ck} AS node_id, '{pp}' || {pk} AS parent_id, CAST(CASE WHEN ({pk} + {ck}) % 17 = 0 "
            f"THEN NULL ELSE greatest({cur} - CASE WHEN (7 * {pk} + {ck}) % 97 = 0 THEN 1 ELSE 0 END, 1) END AS INT) "
            f"AS recorded, CAST({cur} AS INT) AS parent_current FROM {table}")


_PARENTS = " UNION ALL ".join([
    _recorded("nation", "R", "n_regionkey", "N", "n_nationkey"),
    _recorded("customer", "N", "c_nationkey", "C", "c_custkey"),
    _recorded("supplier", "N", "s_nationkey", "SU", "s_suppkey"),
    _recorded("orders", "C", "o_custkey", "O", "o_orderkey"),
    _recorded("(SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)", "SU", "l_suppkey", "O", "l_orderkey"),
    _recorded("(SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)", "P", "l_partkey", "O", "l_orderkey"),
    _recorded("orders", "PL", "o_orderkey", "O", "o_orderkey"),
    _recorded("orders", "O", "o_orderkey", "T", "o_custkey"),
])

# name -> (tables it needs, SQL)
TABLES: dict[str, tuple[list[str], str]] = {
    "fx_node": ([], _NODES),
    "fx_edge": ([], _EDGES),
    "fx_recorded": ([], _PARENTS),
    "fx_disk": (["fx_node"], """
        SELECT n.path, 1000 + key AS size,
               key + CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 1 ELSE 0 END AS mtime,
               'h' || node_id || CASE WHEN o_orderpriority = '1-URGENT' THEN 'x' ELSE '' END AS hash
        FROM fx_node n LEFT JOIN orders ON node_id = 'O' || o_orderkey
        WHERE n.path IS NOT NULL AND node_id NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < 0)"""),
    # Staleness worked out level by level from the known shape of the network.
    "st_direct": (["fx_recorded"], """
        SELECT node_id, parent_id, recorded, parent_current FROM fx_recorded
        WHERE recorded IS NOT NULL AND recorded <> parent_current"""),
    "st_n": (["st_direct"], "SELECT DISTINCT node_id FROM st_direct WHERE node_id LIKE 'N%'"),
    "st_c": (["st_direct", "st_n"], """
        SELECT DISTINCT node_id FROM st_direct WHERE node_id LIKE 'C%'
        UNION SELECT 'C' || c_custkey FROM customer WHERE 'N' || c_nationkey IN (SELECT node_id FROM st_n)"""),
    "st_su": (["st_direct", "st_n"], """
        SELECT DISTINCT node_id FROM st_direct WHERE node_id LIKE 'SU%'
        UNION SELECT 'SU' || s_suppkey FROM supplier WHERE 'N' || s_nationkey IN (SELECT node_id FROM st_n)"""),
    "st_feed": ([], """
        SELECT DISTINCT 'C' || o_custkey AS source, o_orderkey FROM orders
        UNION SELECT 'SU' || l_suppkey, l_orderkey FROM lineitem
        UNION SELECT 'P' || l_partkey, l_orderkey FROM lineitem"""),
    "st_o": (["st_direct", "st_feed", "st_c", "st_su"], """
        SELECT DISTINCT node_id FROM st_direct WHERE node_id LIKE 'O%'
        UNION SELECT 'O' || o_orderkey FROM st_feed WHERE source IN (SELECT node_id FROM st_c UNION SELECT node_id FROM st_su)"""),
    "st_pl": (["st_direct", "st_feed", "st_c", "st_su"], """
        SELECT DISTINCT 'PL' || o_orderkey AS node_id FROM st_feed
        WHERE source IN (SELECT node_id FROM st_c UNION SELECT node_id FROM st_su)
           OR (source, 'O' || o_orderkey) IN (SELECT parent_id, node_id FROM st_direct WHERE node_id LIKE 'O%')"""),
    "st_t": (["st_direct", "st_o"], """
        SELECT DISTINCT node_id FROM st_direct WHERE node_id LIKE 'T%'
        UNION SELECT 'T' || o_custkey FROM orders WHERE 'O' || o_orderkey IN (SELECT node_id FROM st_o)"""),
    "st_placed": (["fx_edge", "fx_node"], """
        SELECT e.edge_id, e.source, e.target, e.placed_version, coalesce(final_version, current_version) AS wanted
        FROM fx_edge e JOIN fx_node n ON n.node_id = e.source
        WHERE rel = 'part_of' AND placed_version IS NOT NULL
          AND coalesce(final_version, current_version) <> placed_version"""),
    "st_a": (["st_placed", "st_t", "fx_edge"], """
        SELECT DISTINCT target AS node_id FROM st_placed
        UNION SELECT target FROM fx_edge WHERE rel = 'part_of' AND source IN (SELECT node_id FROM st_t)"""),
    "st_all": (["st_n", "st_c", "st_su", "st_o", "st_pl", "st_t", "st_a"], """
        SELECT node_id FROM st_n UNION SELECT node_id FROM st_c UNION SELECT node_id FROM st_su
        UNION SELECT node_id FROM st_o UNION SELECT node_id FROM st_pl UNION SELECT node_id FROM st_t
        UNION SELECT node_id FROM st_a"""),
    "fx_snapshot": ([], """
        SELECT 'U' || user_id AS node_id, ts, event_id AS seq, event_type AS hash,
               CAST(floor(value) AS BIGINT) AS size, CAST(event_id % 4 AS INT) AS parent_version,
               CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
               CASE WHEN event_type = 'view' THEN '' ELSE 'because ' || event_type END AS why FROM events"""),
    "fx_version": (["fx_snapshot"], """
        SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY ts, seq) AS v, ts, seq, hash, size,
               parent_version, k, why
        FROM (SELECT *, lag(hash) OVER (PARTITION BY node_id ORDER BY ts, seq) AS before FROM fx_snapshot)
        WHERE before IS NULL OR before <> hash"""),
    "fx_event": ([], """
        SELECT 'p' || (user_id % 10) AS project_id, ts, event_id AS seq, event_type AS event,
               CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' ELSE 'watch' END AS actor,
               'U' || user_id AS node, props AS detail FROM events"""),
    "fx_inventory": ([], """
        SELECT source AS owner, source || '/' || lang AS folder,
               'd' || doc_id || (['.tsv', '.png', '.py', '.log', '.tex'])[doc_id % 5 + 1] AS name,
               source || '/' || lang || '/d' || doc_id || (['.tsv', '.png', '.py', '.log', '.tex'])[doc_id % 5 + 1] AS path,
               CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id AS mtime, sha256(text) AS hash, doc_id, lang
        FROM documents"""),
    "fx_tracked": (["fx_inventory"], """
        SELECT *, 'D' || doc_id AS node_id FROM fx_inventory WHERE doc_id IN (SELECT doc_id FROM labels)"""),
    "fx_seen": (["fx_inventory"], """
        SELECT i.path, i.size, i.mtime + coalesce(toxic, 0) AS mtime FROM fx_inventory i
        LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id) WHERE lang = 'en'"""),
    "fx_copies": (["fx_inventory"], """
        SELECT owner, name, CASE WHEN quality = 0 THEN hash || 'x' ELSE hash END AS hash,
               CASE WHEN quality = 0 THEN size + 1 ELSE size END AS size
        FROM fx_inventory LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
        WHERE lang <> 'de'"""),
    "fx_branch": ([], """
        SELECT 'O' || o_orderkey AS node_id,
               'O' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "of",
               first_value('O' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root,
               CASE o_orderstatus WHEN 'F' THEN 'main' WHEN 'O' THEN 'alternative' ELSE 'abandoned' END AS status,
               o_orderdate AS decided FROM orders"""),
    "fx_analysis": ([], """
        SELECT 'r' || r_regionkey AS key, NULL AS parent, CAST(r_regionkey AS INT) AS ord, '' AS start, r_name AS title,
               false AS hidden FROM region
        UNION ALL SELECT 'r' || n_regionkey || '.n' || n_nationkey, 'r' || n_regionkey, CAST(1 + n_nationkey % 3 AS INT), '',
               n_name, n_regionkey = 0 FROM nation
        UNION ALL SELECT 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey,
               'r' || n_regionkey || '.n' || n_nationkey, CAST(1 + c_custkey AS INT), c_mktsegment, c_name, c_acctbal < -900
               FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "fx_tex": ([], """
        SELECT source AS article, 'd' || d.doc_id || '.tex' AS file, d.doc_id,
               '\\section{' || source || '}' || chr(10) || text ||
               CASE WHEN l.doc_id IS NOT NULL THEN ' \\ev{E' || (d.doc_id % 50) || '}' ELSE '' END AS text
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id"""),
    "fx_evidence": ([], """
        SELECT 'E' || item_id AS id, CASE WHEN item_id % 6 = 0 THEN 'r' || item_id
               ELSE 'data/q' || item_id || '.tsv' END AS target,
               CASE WHEN item_id % 8 = 0 THEN 'MISMATCH with the text' ELSE '' END AS note,
               substring(text, 1, 40) AS claim, item_id FROM benchmark"""),
    "fx_revision": ([], """
        SELECT a.conv_id || '.' || a.turn AS r_id, 'R' || (a.conv_id % 3) AS round, b.role AS reviewer,
               (['main.tex', 'sections/methods.tex', 'sections/results.tex', 'notes.tex'])[a.turn % 4 + 1] AS file,
               a.text AS before, b.text AS reviewer_text,
               (['accepted', 'accepted with edits', 'partly applied', 'needs author', 'not applied'])
                   [(a.conv_id + a.turn) % 5 + 1] AS decision,
               CASE WHEN a.turn = 0 THEN 'P' || a.conv_id ELSE 'P' || a.conv_id || ', P' || (a.conv_id + 1) END AS proposal,
               (['proposed', 'accepted', 'open question'])[a.conv_id % 3 + 1] AS status
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""),
    "fx_hunk": ([], """
        SELECT 'P' || conv_id AS proposal, turn AS n,
               CASE WHEN length(text) < 60 THEN 'rejected' WHEN length(text) > 20000 THEN 'open'
                    WHEN length(text) > 1500 THEN 'conflict' ELSE 'accepted' END AS state FROM conversations"""),
    "fx_batch_node": ([], """
        SELECT split_part(p_name, ' ', 1) AS batch_id, p_partkey AS seq,
          CASE WHEN p_size >= 45 THEN 'k' || p_type ELSE 'k' || p_partkey END AS key,
          CASE WHEN p_size = 1 THEN 'P' || p_partkey WHEN p_size = 2 THEN 'T' || p_partkey WHEN p_size = 3 THEN 'NEW' || p_type END AS id,
          CASE p_type WHEN 'ECONOMY' THEN 'table' WHEN 'PROMO' THEN 'figure' WHEN 'SMALL' THEN 'raw' WHEN 'LARGE' THEN 'resource'
               WHEN 'MEDIUM' THEN 'note' ELSE 'widget' END AS type,
          CASE WHEN p_size = 4 THEN ' ' WHEN p_size = 5 THEN repeat(p_name, 10) ELSE p_name END AS label,
          CASE WHEN p_size = 6 THEN 'copied' WHEN p_retailprice > 1000 THEN 'managed' ELSE 'ref' END AS mode,
          CASE WHEN p_size BETWEEN 6 AND 20 THEN 'data/parts/P' || p_partkey || '.tsv'
               WHEN p_size BETWEEN 21 AND 23 THEN 'gone/' || p_partkey END AS path,
          CASE WHEN p_size BETWEEN 7 AND 12 THEN 'data/customers/C' || p_partkey || '.tsv' END AS dest,
          CASE WHEN p_size = 8 THEN NULL WHEN p_size = 9 THEN 'finemapping' ELSE 'sources' END AS step,
          CASE WHEN p_size > 30 THEN p_name END AS grp, CASE WHEN p_size < 30 THEN 'http://x' END AS url,
          CASE WHEN p_size > 25 THEN 'cluster' END AS location FROM part"""),
    "fx_batch_edge": (["fx_batch_node"], """
        SELECT batch_id, l_orderkey || '.' || l_linenumber || '.' || l_partkey AS n,
          CASE WHEN l_returnflag = 'R' AND l_tax >= 0.08 OR path LIKE 'gone/%' THEN key WHEN l_returnflag = 'R' THEN 'PL' || l_orderkey
               WHEN l_returnflag = 'A' THEN 'SU' || l_suppkey ELSE 'X' || l_orderkey END AS src,
          CASE WHEN l_returnflag = 'R' AND l_tax >= 0.08 OR path LIKE 'gone/%' THEN 'P' || l_partkey ELSE key END AS dst,
          (['produces', 'derives', 'feeds', 'code', 'part_of', 'makes', 'related'])[l_linenumber] AS rel,
          CASE WHEN l_discount < 0.025 OR dest IS NOT NULL THEN [] WHEN l_discount < 0.055 THEN ['L', 'la_marker']
               ELSE ['font_size', 'alpha', 'label_size'] END AS keys,
          CASE WHEN l_linestatus = 'F' THEN 'PL' || l_orderkey WHEN l_linenumber = 2 THEN 'SU' || l_suppkey END AS script,
          l_quantity FROM lineitem JOIN fx_batch_node ON seq = l_partkey"""),
}


def with_tables(names: list[str], body: str, extra: str = "", recursive: bool = False) -> str:
    """`body` preceded by the fixture tables it needs (and `extra` common table expressions)."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in TABLES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({TABLES[name][1]})" for name in order]
    if extra:
        parts.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
