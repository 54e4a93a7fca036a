"""Searches over the fixture network."""

from strandline.fixtures import with_tables
from strandline.operators import search
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


@query(with_tables(["fx_node", "fx_edge"], """
SELECT node_id FROM (
  SELECT n.node_id, lower(n.node_id || ' ' || label || ' ' || type || ' ' || coalesce(path, '') || ' ' || coalesce(n.grp, '') || ' ' ||
         coalesce((SELECT string_agg('priority ' || priority || ' status ' || status, ' ') FROM fx_edge e
                   WHERE e.target = n.node_id AND priority IS NOT NULL), '')) AS blob FROM fx_node n)
WHERE contains(blob, 'result') AND contains(blob, '2-high') AND contains(blob, '9')"""))
def search_all_terms(fx):
    return search.search_all_terms(fx.nodes(), fx.edges(), "Result 2-HIGH 9").select("node_id")


_WORDS = """
piece AS (SELECT node_id, unnest([node_id, label, type, path, grp]) AS piece FROM fx_node
          UNION ALL SELECT target, 'priority ' || priority || ' status ' || status FROM fx_edge WHERE priority IS NOT NULL),
word AS (SELECT DISTINCT node_id, w FROM (SELECT node_id, unnest(regexp_split_to_array(lower(piece), '[^a-z0-9_.]+')) AS w FROM piece)
         WHERE length(w) > 1),
asked AS (SELECT unnest(['building', 'hot', 'order', 'ring', 'urgent']) AS q)"""


@query(with_tables(["fx_node", "fx_edge"], """
SELECT word.node_id, CAST(sum(CASE WHEN q = w THEN CASE WHEN list_contains(regexp_split_to_array(lower(label), '[^a-z0-9_.]+'), w)
         THEN 2 ELSE 1 END WHEN length(q) > 3 AND (contains(w, q) OR contains(q, w)) THEN 1 ELSE 0 END) AS BIGINT) AS score
FROM word JOIN fx_node n ON n.node_id = word.node_id, asked GROUP BY word.node_id HAVING score > 0""", _WORDS))
def search_scored(fx):
    return search.search_scored(fx.nodes(), fx.edges(), "Which hot ring is in the urgent building order?", None).select(
        "node_id", "score")


@query(with_tables(["fx_node", "fx_edge"], """
SELECT node_id, CAST(sum(CASE WHEN q = w THEN CASE WHEN list_contains(regexp_split_to_array(lower(label), '[^a-z0-9_.]+'), w)
         THEN 2 ELSE 1 END WHEN length(q) > 3 AND (contains(w, q) OR contains(q, w)) THEN 1 ELSE 0 END) AS BIGINT) AS score
FROM word JOIN fx_node n USING (node_id), asked GROUP BY node_id HAVING score > 0 ORDER BY score DESC, node_id LIMIT 12""", _WORDS))
def search_best(fx):
    return search.search_scored(fx.nodes(), fx.edges(), "Which hot ring is in the urgent building order?", 12).select(
        "node_id", "score")


@query(with_tables(["fx_edge"], """
SELECT edge_id FROM fx_edge WHERE priority IS NOT NULL AND (lower(priority) LIKE '%urgent%' OR source IN ('PL77', 'PL78'))
ORDER BY edge_id LIMIT 15"""))
def search_params(fx):
    return search.search_params(fx.nodes(), fx.edges(), "Which params were used for urgent, 77 and 78?", 15).select("edge_id")


@query(with_tables(["fx_analysis"], """
SELECT key FROM fx_analysis WHERE contains(lower(key), 'n1') OR contains(lower(parent), 'n1') OR contains(lower(title), 'n1')
   OR contains(lower(start), 'n1')"""))
def analysis_search(fx):
    return search.search_records(fx.analyses().select("key", "parent", "title", "start"), "N1").select("key")
