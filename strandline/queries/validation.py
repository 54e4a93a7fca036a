"""Batch checks over the fixture batches."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import dedup, validate
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql
OUT = ["batch_id", "severity", "rule", "subject", "detail"]


def out(df):
    return df.select(*OUT)


def sql(*parts, need=("fx_batch_node", "fx_batch_edge"), extra="", recursive=False):
    """Union of (severity, rule, subject, detail, FROM ...) selections."""
    selects = [f"SELECT batch_id, '{sev}' AS severity, '{rule}' AS rule, CAST({subject} AS VARCHAR) AS subject, "
               f"CAST({detail} AS VARCHAR) AS detail FROM {source}" for sev, rule, subject, detail, source in parts]
    return with_tables(list(need), "\nUNION ALL ".join(selects), extra, recursive)


@query(sql(("ERROR", "duplicate_key", "key", "count(*)", "fx_batch_node GROUP BY batch_id, key HAVING count(*) > 1"),
           ("ERROR", "duplicate_id", "id", "count(*)", "fx_batch_node WHERE id IS NOT NULL GROUP BY batch_id, id HAVING count(*) > 1"),
           ("ERROR", "id_taken", "id", "NULL", "(SELECT DISTINCT batch_id, id FROM fx_batch_node) WHERE id IN (SELECT node_id FROM fx_node)"),
           need=("fx_batch_node", "fx_node")))
def v_duplicate_keys(fx):
    return out(validate.duplicate_keys(fx.batch_nodes(), fx.nodes()))


@query(sql(("ERROR", "unknown_type", "key", "type", "fx_batch_node WHERE type = 'widget'"),
           ("ERROR", "unknown_mode", "key", "mode", "fx_batch_node WHERE mode = 'copied'"),
           ("ERROR", "unknown_relation", "n", "rel", "fx_batch_edge WHERE rel = 'makes'")))
def v_unknown_values(fx):
    return out(validate.unknown_values(fx.batch_nodes(), fx.batch_edges()))


@query(sql(("ERROR", "no_label", "key", "NULL", "fx_batch_node WHERE trim(label) = ''"),
           ("WARN", "long_label", "key", "NULL", "fx_batch_node WHERE length(trim(label)) > 60")))
def v_labels(fx):
    return out(validate.labels(fx.batch_nodes()))


_ENDS = """refs AS (SELECT batch_id, 'edge src ' || n AS place, src AS ref FROM fx_batch_edge
  UNION ALL SELECT batch_id, 'edge dst ' || n, dst FROM fx_batch_edge
  UNION ALL SELECT batch_id, 'edge script ' || n, script FROM fx_batch_edge WHERE script IS NOT NULL)"""


@query(sql(("ERROR", "dangling", "place", "ref", """refs WHERE (batch_id, ref) NOT IN (SELECT batch_id, key FROM fx_batch_node)
            AND ref NOT IN (SELECT node_id FROM fx_node)"""), need=("fx_batch_edge", "fx_node"), extra=_ENDS))
def v_dangling(fx):
    return out(validate.dangling(fx.batch_nodes(), validate.edge_refs(fx.batch_edges()), fx.nodes()))


@query(sql(("ERROR", "script_not_a_process", "n", "script", "fx_batch_edge WHERE script LIKE 'SU%'")))
def v_script_type(fx):
    return out(validate.script_types(fx.batch_nodes(), fx.batch_edges(), fx.nodes()))


@query(sql(("ERROR", "params_not_an_object", "n", "NULL", "fx_batch_edge WHERE l_quantity >= 12 AND l_quantity < 14"),
           ("ERROR", "param_not_scalar", "n", "'a'", "fx_batch_edge WHERE (l_quantity >= 10 AND l_quantity < 12) OR (l_quantity >= 14 AND l_quantity < 16)")))
def v_nested_params(fx):
    return out(validate.nested_params(fx.batch_edges()))


@query(sql(("WARN", "cosmetic_param", "n", "unnest(['font_size', 'label_size'])", "fx_batch_edge WHERE len(keys) = 3")))
def v_cosmetic(fx):
    return out(validate.cosmetic_params(fx.batch_edges()))


@query(sql(("WARN", "params_on_relation", "n", "rel", "fx_batch_edge WHERE len(keys) > 0 AND rel IN ('code', 'part_of', 'related')")))
def v_param_rel(fx):
    return out(validate.params_on_relation(fx.batch_edges()))


@query(sql(("WARN", "no_params_into_output", "n", "dst", """fx_batch_edge e WHERE len(keys) = 0 AND rel IN ('produces', 'derives')
            AND (batch_id, dst) IN (SELECT batch_id, key FROM kind WHERE type IN ('table', 'figure'))
            AND (batch_id, dst) NOT IN (SELECT batch_id, dst FROM fx_batch_edge WHERE len(keys) > 0)"""),
           extra="kind AS (SELECT DISTINCT batch_id, key, type FROM fx_batch_node)"))
def v_unparameterised(fx):
    return out(validate.unparameterised(fx.batch_nodes(), fx.batch_edges(), fx.nodes(), fx.edges()))


@query(sql(("WARN", "no_provenance", "key", "NULL", """(SELECT DISTINCT batch_id, key FROM fx_batch_node WHERE type IN ('table', 'figure'))
            WHERE (batch_id, key) NOT IN (SELECT batch_id, dst FROM fx_batch_edge)""")))
def v_no_provenance(fx):
    return out(validate.no_provenance(fx.batch_nodes(), fx.batch_edges()))


@query(with_tables(["fx_batch_node", "fx_batch_edge", "st_feed"],
                   "SELECT DISTINCT batch_id, 'ERROR' AS severity, 'cycle' AS rule FROM hops WHERE a = b", """
links AS (SELECT DISTINCT batch_id, src, dst FROM fx_batch_edge
          UNION SELECT batch_id, script, dst FROM fx_batch_edge WHERE script IS NOT NULL),
hop AS (SELECT DISTINCT x.batch_id, x.src AS a, z.src AS b FROM links x
        JOIN st_feed f ON f.source = x.dst JOIN links z ON z.batch_id = x.batch_id AND z.src = 'PL' || f.o_orderkey
        WHERE x.src LIKE 'k%' AND z.dst LIKE 'k%'
        UNION SELECT DISTINCT batch_id, src, dst FROM links WHERE src LIKE 'PL%' AND dst LIKE 'k%'),
hops(batch_id, a, b) AS (SELECT batch_id, a, b FROM hop WHERE a LIKE 'k%'
        UNION SELECT hops.batch_id, hops.a, hop.b FROM hops JOIN hop ON hop.batch_id = hops.batch_id AND hop.a = hops.b)""", True))
def v_cycles(fx):
    return out(validate.cycles(fx.batch_nodes(), fx.batch_edges(), fx.edges())).select("batch_id", "severity", "rule")


def listed(fx):
    return fx.disk().withColumn("is_dir", F.lit(False))


def on_disk(fx):
    """The batch's files with content: parts of one name have equal content."""
    files = fx.batch_nodes().join(fx.disk().select("project_id", "path", "size"), ["project_id", "path"])
    return files.select("project_id", "batch_id", F.col("key").alias("owner"), "size", F.sha2("label", 256).alias("hash"))


def recorded_parts(fx):
    """Parts over size 40 are recorded with their name as content."""
    return fx.table("part").where("p_size > 40").selectExpr(
        "'p0' AS project_id", "concat('P', p_partkey) AS owner", "sha2(p_name, 256) AS hash", "CAST(1 AS BIGINT) AS size")


@query(sql(("ERROR", "same_content", "key", "owner", "batch JOIN old USING (label) WHERE least = owner"),
           ("ERROR", "twice_in_batch", "key", "first", """(SELECT *, min(key) OVER (PARTITION BY batch_id, label) AS first FROM batch)
            WHERE first <> key"""), need=("fx_batch_node", "fx_disk"), extra="""
batch AS (SELECT DISTINCT batch_id, key, label FROM fx_batch_node JOIN fx_disk USING (path)),
old AS (SELECT 'P' || p_partkey AS owner, p_name AS label, min('P' || p_partkey) OVER (PARTITION BY p_name) AS least FROM part
        WHERE p_size > 40)"""))
def v_duplicates(fx):
    batch = on_disk(fx).withColumn("size", F.lit(1).cast("long"))
    return out(validate.content_duplicates(fx.batch_nodes(), batch, recorded_parts(fx), 1))


@query(sql(("ERROR", "path_missing", "key", "path", "fx_batch_node WHERE path LIKE 'gone/%'"),
           ("ERROR", "destination_taken", "key", "dest", "fx_batch_node WHERE mode = 'managed' AND dest IN (SELECT path FROM fx_disk)"),
           need=("fx_batch_node", "fx_disk")))
def v_paths(fx):
    return out(validate.paths(fx.batch_nodes(), listed(fx)))


@query(sql(("WARN", "no_url", "key", "NULL", "fx_batch_node WHERE path IS NULL AND type = 'resource' AND url IS NULL"),
           ("WARN", "no_path", "key", "NULL", "fx_batch_node WHERE path IS NULL AND type NOT IN ('resource', 'note') AND location IS NULL"),
           ("WARN", "no_step", "key", "NULL", "fx_batch_node WHERE step IS NULL AND type <> 'note'"),
           ("WARN", "undefined_step", "key", "step", "fx_batch_node WHERE step = 'finemapping'")))
def v_missing_meta(fx):
    steps = fx.nodes().select("project_id", "step").distinct()
    return out(validate.missing_meta(fx.batch_nodes(), steps))


@query(sql(("WARN", "ungrouped_set", "min(mine)", "count(*) || ' ' || type || ' ' || way || ' ' || other",
            "tied GROUP BY batch_id, step, type, kind, way, other HAVING count(*) > 1"), extra="""
free AS (SELECT batch_id, key, any_value(step) AS step, any_value(type) AS type,
                any_value(CASE WHEN path LIKE '%.tsv' THEN 'tsv' ELSE '' END) AS kind
         FROM fx_batch_node WHERE grp IS NULL GROUP BY batch_id, key),
tied AS (SELECT DISTINCT e.batch_id, dst AS mine, 'are made by' AS way, src AS other, step, type, kind FROM fx_batch_edge e
         JOIN free f ON f.batch_id = e.batch_id AND f.key = dst WHERE rel IN ('produces', 'derives', 'feeds') AND src LIKE 'PL%')"""))
def v_ungrouped_sets(fx):
    return out(validate.ungrouped_sets(fx.batch_nodes(), fx.batch_edges(), fx.nodes()))


# every rule that has a query of its own, next to each other
_RULES = ("v_duplicate_keys", "v_unknown_values", "v_labels", "v_dangling", "v_script_type", "v_nested_params", "v_cosmetic",
          "v_param_rel", "v_unparameterised", "v_no_provenance", "v_cycles", "v_duplicates", "v_paths", "v_missing_meta",
          "v_ungrouped_sets")
_FOUND = "\nUNION ALL ".join(f"SELECT batch_id, severity FROM ({SQL[name]}) AS {name}" for name in _RULES)


@query(f"""
SELECT b.batch_id, count(f.severity) FILTER (f.severity = 'ERROR') AS errors, count(f.severity) FILTER (f.severity = 'WARN') AS warnings,
       count(f.severity) FILTER (f.severity = 'ERROR') = 0 AS passed
FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS batch_id FROM part) b LEFT JOIN ({_FOUND}) f ON f.batch_id = b.batch_id
GROUP BY b.batch_id""")
def v_report(fx):
    """All rules over the batches with their files, against the whole catalog."""
    batch = {"nodes": fx.batch_nodes(), "edges": fx.batch_edges(), "files": on_disk(fx).withColumn("size", F.lit(1).cast("long"))}
    catalog = {"nodes": fx.nodes(), "edges": fx.edges(), "inventory": listed(fx), "files": recorded_parts(fx),
               "steps": fx.nodes().select("project_id", "step").distinct()}
    return validate.report(fx.batch_nodes(), validate.check_batch(batch, catalog)).drop("project_id")


@query(with_tables(["fx_batch_node", "fx_node"], """
SELECT batch_id, key, prefix || n AS node_id FROM wanted JOIN free USING (prefix, r)
UNION ALL SELECT batch_id, key, id FROM fx_batch_node WHERE id IS NOT NULL""", """
counters AS (SELECT regexp_extract(node_id, '^([A-Za-z]+)', 1) AS prefix, max(key) AS counter FROM fx_node GROUP BY 1),
wanted AS (SELECT batch_id, key, prefix, row_number() OVER (PARTITION BY prefix ORDER BY seq) AS r FROM (
  SELECT *, CASE type WHEN 'table' THEN 'T' WHEN 'figure' THEN 'F' WHEN 'raw' THEN 'RAW' WHEN 'resource' THEN 'RES'
                      WHEN 'note' THEN 'N' END AS prefix FROM fx_batch_node WHERE id IS NULL AND type <> 'widget')),
free AS (SELECT prefix, n, row_number() OVER (PARTITION BY prefix ORDER BY n) AS r FROM (
  SELECT prefix, coalesce(counter, 0) + i AS n FROM (SELECT DISTINCT prefix FROM wanted) LEFT JOIN counters USING (prefix),
         (SELECT unnest(range(1, 1 + 2 * (SELECT count(*) FROM part))) AS i))
  WHERE prefix || n NOT IN (SELECT id FROM fx_batch_node WHERE id IS NOT NULL))"""))
def next_ids(fx):
    return validate.next_ids(fx.batch_nodes(), fx.nodes(), F.expr("seq div 1000")).drop("project_id")


@query(with_tables(["fx_batch_edge", "fx_edge"], """
SELECT DISTINCT script, dst FROM fx_batch_edge WHERE script <> src
EXCEPT (SELECT src, dst FROM fx_batch_edge UNION SELECT source, target FROM fx_edge)"""))
def implied_code_edges(fx):
    return validate.implied_code_edges(fx.batch_edges(), fx.edges()).select("script", "dst")
