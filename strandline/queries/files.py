"""File listings: identical content and the monitor round, over the fixture tables."""

from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.functions.paths import guess_type, matches_any
from strandline.operators import dedup, monitor, staleness
from strandline.operators.staleness import Staleness
from strandline.queries.register import Registry
from strandline.queries.staleness import stored
from strandline.vocab import IGNORE_GLOBS

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql
SMALL = 100


@query(with_tables(["fx_inventory", "fx_seen"], """
SELECT i.path, i.hash, s.path IS NOT NULL AS reused FROM fx_inventory i
LEFT JOIN fx_seen s ON s.path = i.path AND s.size = i.size AND s.mtime = i.mtime"""))
def content_hash(fx):
    files = fx.inventory()
    cache = fx.seen().withColumn("hash", F.lit(None).cast("string")).drop("hash").join(
        files.select("project_id", "path", "hash"), ["project_id", "path"])
    content = files.select("project_id", "path", "doc_id").join(fx.table("documents").select("doc_id", "text"), "doc_id")
    return dedup.content_hash(files, content.select("project_id", "path", F.col("text").alias("content")), cache).select(
        "path", "hash", "reused")


_XOR = " || ".join(f"lpad(lower(to_hex(bit_xor(CAST('0x' || substring(sha256({{m}}), {1 + 15 * i}, 15) AS BIGINT)))), 15, '0')"
                   for i in range(4))


@query(with_tables(["fx_inventory"], f"""
SELECT owner, 'dir:' || {_XOR.format(m="path || '|' || size || '|' || mtime")} AS hash, CAST(sum(size) AS BIGINT) AS size,
       count(*) AS files FROM fx_inventory GROUP BY owner"""))
def listing_digest(fx):
    return dedup.listing_digest(fx.inventory()).select("owner", "hash", "size", "files")


_GROUPS = f"""
groups AS (SELECT hash, max(size) AS size, count(*) AS files, count(DISTINCT owner) > 1 AS owners_differ FROM fx_inventory
           WHERE size >= {SMALL} GROUP BY hash HAVING count(DISTINCT lower(path)) > 1 OR count(DISTINCT owner) > 1)"""


@query(with_tables(["fx_inventory"], "SELECT hash, size, files, owners_differ FROM groups", _GROUPS))
def duplicate_groups(fx):
    return dedup.duplicate_groups(fx.inventory(), SMALL).select("hash", "size", "files", "owners_differ")


@query(with_tables(["fx_inventory"], f"""
SELECT hash, owner, path FROM fx_inventory WHERE size >= {SMALL} AND hash IN (SELECT hash FROM groups)""", _GROUPS))
def duplicate_members(fx):
    return dedup.duplicate_members(fx.inventory().drop("hash"), SMALL, fx.contents()).select("hash", "owner", "path")


def single_files(fx):
    """Every document as an object of its own, next to its folders, so that whole objects can be equal."""
    files = fx.inventory()
    alone = files.withColumn("owner", F.concat(F.lit("D"), "doc_id"))
    return files.withColumn("owner", F.col("folder")).unionByName(alone)


_HELD = f"""
held AS (SELECT DISTINCT owner, hash FROM (
  SELECT folder AS owner, hash FROM fx_inventory WHERE size >= {SMALL}
  UNION ALL SELECT 'D' || doc_id, hash FROM fx_inventory WHERE size >= {SMALL})),
sets AS (SELECT owner, string_agg(hash, ',' ORDER BY hash) AS content, count(*) AS files FROM held GROUP BY owner),
classes AS (SELECT owner, min(owner) OVER (PARTITION BY content) AS class, files FROM sets)"""


@query(with_tables(["fx_inventory"], 'SELECT owner, "class", files FROM classes', _HELD))
def owner_classes(fx):
    return dedup.owner_classes(single_files(fx), SMALL).select("owner", "class", "files")


@query(with_tables(["fx_inventory"], """
SELECT m.shared_set, m.contents, c.owner AS "class", c.files FROM (
  SELECT min(hash) AS shared_set, count(*) AS contents, who FROM holders GROUP BY who) m
JOIN held h ON h.hash = m.shared_set JOIN classes c ON c.owner = h.owner AND c.class = c.owner""", _HELD + """,
holders AS (SELECT hash, string_agg(h.owner, ',' ORDER BY h.owner) AS who FROM held h
            JOIN classes c ON c.owner = h.owner AND c.class = c.owner GROUP BY hash HAVING count(*) > 1)"""))
def owner_overlap(fx):
    return dedup.shared_sets(single_files(fx), SMALL).select("shared_set", "contents", "class", "files")


@query(with_tables(["fx_inventory", "fx_tracked"], """
SELECT n.owner, s.class AS same_as, o.overlaps, coalesce(o.all_overlaps, '') AS all_overlaps
FROM (SELECT folder AS owner, string_agg(DISTINCT hash, ',' ORDER BY hash) AS content FROM fx_inventory WHERE size >= 100
      GROUP BY folder UNION ALL SELECT 'D' || doc_id, hash FROM fx_inventory WHERE size >= 100) n
LEFT JOIN (SELECT content, min(owner) AS class FROM old_sets GROUP BY content) s USING (content)
LEFT JOIN (
  SELECT h.owner, min(k.class) AS overlaps, string_agg(DISTINCT k.class, ',' ORDER BY k.class) AS all_overlaps
  FROM held h JOIN old_classes k ON k.hash = h.hash
  LEFT JOIN (SELECT sets.owner, min(old_sets.owner) AS own FROM sets JOIN old_sets USING (content) GROUP BY 1) e ON e.owner = h.owner
  WHERE k.class IS DISTINCT FROM e.own GROUP BY h.owner) o ON o.owner = n.owner""", _HELD + """,
old AS (SELECT DISTINCT owner, hash FROM (SELECT folder AS owner, hash FROM fx_tracked WHERE size >= 100
        UNION ALL SELECT node_id, hash FROM fx_tracked WHERE size >= 100)),
old_sets AS (SELECT owner, string_agg(hash, ',' ORDER BY hash) AS content FROM old GROUP BY owner),
old_classes AS (SELECT DISTINCT hash, min(o.owner) OVER (PARTITION BY content) AS class
                FROM old_sets JOIN old o USING (owner))"""))
def classify_new(fx):
    """All documents and folders as a new batch against the labelled ones."""
    tracked = fx.tracked()
    catalog = tracked.withColumn("owner", F.col("folder")).unionByName(tracked.withColumn("owner", F.col("node_id")))
    return dedup.classify_new(single_files(fx), catalog, SMALL).select(
        "owner", "same_as", "overlaps", F.array_join("all_overlaps", ",").alias("all_overlaps"))


@query(with_tables(["fx_inventory"], """
SELECT owner, files, size, min(owner) OVER (PARTITION BY content) AS first FROM (
  SELECT owner, string_agg(hash, ',' ORDER BY hash) AS content, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM (
    SELECT folder AS owner, hash, size FROM fx_inventory WHERE size >= 100
    UNION ALL SELECT 'D' || doc_id, hash, size FROM fx_inventory WHERE size >= 100) GROUP BY owner)"""))
def batch_signature(fx):
    return dedup.batch_signature(single_files(fx), SMALL).select("owner", "files", "size", "first")


@query(with_tables(["fx_edge"], """
SELECT first(edge_id ORDER BY regexp_extract(edge_id, '^([A-Za-z]+)', 1), coalesce(TRY_CAST(regexp_extract(edge_id, '^[A-Za-z]+([0-9]+)', 1) AS BIGINT), 0),
             regexp_extract(edge_id, '^[A-Za-z]+[0-9]+(.*)$', 1)) AS edge_id, source, target, rel FROM (
  SELECT edge_id, coalesce(r.keep, source) AS source, target, rel FROM fx_edge LEFT JOIN renamed r ON r.dup = source)
GROUP BY source, target, rel""", """
renamed AS (SELECT 'P' || p_partkey AS dup, 'P' || min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS keep FROM part)"""))
def merge_edges(fx):
    """Links after parts of one name and brand became one artifact."""
    part = fx.table("part")
    kept = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("least"))
    renames = part.join(kept, ["p_name", "p_brand"]).selectExpr(
        "'p0' AS project_id", "concat('P', p_partkey) AS dup", "concat('P', least) AS keep").where("dup <> keep")
    return dedup.merge_edges(fx.edges(), renames).select("edge_id", "source", "target", "rel")


@query("""
WITH named AS (SELECT p_partkey, p_name, about, 'P' || min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS keep FROM
    (SELECT *, CASE WHEN p_size % 4 = 0 THEN '' ELSE '<' || p_name || '>' END AS about FROM part)),
own AS (SELECT keep, about AS text FROM named WHERE keep = 'P' || p_partkey),
news AS (SELECT n.keep, n.about AS text, min(p_partkey) AS least FROM named n JOIN own o ON o.keep = n.keep
         WHERE n.about <> '' AND n.about <> o.text GROUP BY ALL)
SELECT n.keep AS node_id, trim(any_value(o.text) || chr(10) || string_agg('[also, as P' || least || '] ' || n.text, chr(10) ORDER BY least), chr(10)) AS description
FROM news n JOIN own o ON o.keep = n.keep GROUP BY n.keep""")
def merged_descriptions(fx):
    """Descriptions after the parts of one brand and type became one artifact; every fourth size has none."""
    part = fx.table("part")
    kept = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("least"))
    renames = part.join(kept, ["p_brand", "p_type"]).selectExpr(
        "'p0' AS project_id", "concat('P', p_partkey) AS dup", "concat('P', least) AS keep").where("dup <> keep")
    nodes = part.selectExpr("'p0' AS project_id", "concat('P', p_partkey) AS node_id",
                            "IF(p_size % 4 = 0, '', concat('<', p_name, '>')) AS description")
    return dedup.merge_descriptions(nodes, renames).select("node_id", "description")


@query(with_tables(["fx_inventory"], """
SELECT path, CASE WHEN path LIKE '%.tsv' THEN 'table' WHEN path LIKE '%.png' THEN 'figure' WHEN path LIKE '%.py' THEN 'script'
       WHEN path LIKE '%.tex' THEN 'section' ELSE 'result' END AS type FROM fx_inventory"""))
def file_types(fx):
    return fx.inventory().select("path", guess_type(F.col("path")).alias("type"))


@query(with_tables(["fx_inventory"], """
SELECT path, path LIKE '%.log' OR folder LIKE 'src1/%' AS ignored FROM fx_inventory"""))
def ignored_files(fx):
    return fx.inventory().select("path", matches_any(F.col("path"), [*IGNORE_GLOBS, "src1/*"]).alias("ignored"))


def unrecorded(fx):
    folders = fx.inventory().where(F.endswith("folder", F.lit("/fr"))).select("project_id", F.col("folder").alias("path"))
    return monitor.untracked(monitor.visible_files(fx.inventory()), fx.tracked(), folders)


_UNRECORDED = """
unrecorded AS (SELECT * FROM fx_inventory WHERE path NOT LIKE '%.log' AND lang <> 'fr'
               AND doc_id NOT IN (SELECT doc_id FROM labels))"""
_NEW = _UNRECORDED + """,
fresh AS (SELECT u.*, s.path IS NOT NULL AS changed_since_seen FROM unrecorded u LEFT JOIN fx_seen s USING (path)
          WHERE s.path IS NULL OR s.mtime <> u.mtime OR s.size <> u.size)"""


@query(with_tables(["fx_inventory"], "SELECT path FROM unrecorded", _UNRECORDED))
def untracked_files(fx):
    return unrecorded(fx).select("path")


@query(with_tables(["fx_inventory", "fx_seen"], """
SELECT i.path, s.path IS NOT NULL AS changed_since_seen FROM fx_inventory i LEFT JOIN fx_seen s USING (path)
WHERE s.path IS NULL OR s.mtime <> i.mtime OR s.size <> i.size"""))
def new_files(fx):
    return monitor.new_files(fx.inventory(), fx.seen()).select("path", "changed_since_seen")


@query()
def version_candidates(fx):
    """Checked against a brute-force comparison in the tests: the name ratio has no SQL form."""
    return monitor.version_candidates(fx.inventory(), fx.tracked()).select("path", "node_id", "ratio")


@query(with_tables(["fx_inventory", "fx_tracked"], """
SELECT i.path, coalesce(f.node_id, s.node_id) AS node_id FROM fx_inventory i
LEFT JOIN (SELECT folder, min(node_id) AS node_id FROM fx_tracked WHERE lang = 'en' GROUP BY folder) f USING (folder)
LEFT JOIN (SELECT owner, min(node_id) AS node_id FROM fx_tracked WHERE lang <> 'en' GROUP BY owner) s USING (owner)
WHERE coalesce(f.node_id, s.node_id) IS NOT NULL"""))
def nearest_node(fx):
    """Labelled English documents lie in their folder, the other ones directly below their source."""
    place = F.when(F.endswith("folder", F.lit("/en")), F.col("folder")).otherwise(F.col("owner"))
    tracked = fx.tracked().withColumn("path", F.concat(place, F.lit("/"), "name"))
    return monitor.nearest_node(fx.inventory(), tracked).select("path", "node_id")


@query(with_tables(["fx_inventory"], """
SELECT folder, count(*) AS files FROM fx_inventory GROUP BY folder ORDER BY files DESC, folder LIMIT 12"""))
def baseline_folders(fx):
    return monitor.baseline_folders(fx.inventory()).select("folder", "files")


@query(with_tables(["fx_inventory", "fx_seen", "fx_disk", "fx_node", "st_all"], """
SELECT (SELECT count(*) FROM fx_node n JOIN fx_disk d USING (path) WHERE d.mtime <> n.key AND d.hash <> 'h' || node_id) AS updated,
       (SELECT count(*) FROM fresh) AS new, (SELECT count(*) FROM st_all) AS stale,
       (SELECT count(*) FROM fx_node WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM fx_disk)) AS missing""", _NEW))
def monitor_round(fx):
    disk = staleness.disk_state(fx.node_versions(), fx.disk())
    new = monitor.new_files(unrecorded(fx), fx.seen())
    return monitor.monitor_round(disk, new, Staleness(*stored(fx)).stale_nodes()).drop("project_id")
