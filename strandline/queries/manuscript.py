"""Revisions, proposals and builds over the fixture texts."""

from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import manuscript as ops
from strandline.queries.register import Registry
from strandline.vocab import DECISIONS

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql

_TOKEN = "\\d+(?:[.,]\\d+)*|[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]"


def _profile(split):
    return f"""
tok AS (SELECT r_id, word, sum(a) AS a, sum(b) AS b FROM (
  SELECT r_id, unnest({split.replace('@', 'before')}) AS word, 1 AS a, 0 AS b FROM fx_revision
  UNION ALL SELECT r_id, unnest({split.replace('@', 'reviewer_text')}), 0, 1 FROM fx_revision) WHERE word <> '' GROUP BY ALL),
prof AS (SELECT r_id, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS removed, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added,
         CAST(sum(least(a, b)) AS BIGINT) AS kept FROM tok GROUP BY r_id)"""


@query(with_tables(["fx_revision"], """
SELECT r_id AS id, removed, added, kept, removed + kept > 0 AND added + kept > 0 AND 2 * kept < 0.45 * (2 * kept + removed + added) AS rewrite
FROM prof""", _profile(f"regexp_extract_all(@, '{_TOKEN}')")))
def change_profile(fx):
    pairs = fx.revisions().select(F.col("r_id").alias("id"), "before", F.col("reviewer_text").alias("after"))
    return ops.change_profile(pairs)


_CHANGED = _profile("regexp_split_to_array(@, '\\s+')") + """,
changed AS (SELECT r_id, greatest(removed, added) AS words_changed FROM prof)"""


@query(with_tables(["fx_revision"], "SELECT r_id, words_changed FROM changed", _CHANGED))
def words_changed(fx):
    return ops.words_changed(fx.revisions())


@query(with_tables(["fx_hunk"], """
SELECT proposal, CASE WHEN bool_or(state = 'open') THEN 'open' WHEN bool_and(state = 'accepted') THEN 'accepted'
  WHEN bool_and(state = 'rejected') THEN 'rejected' ELSE 'resolved' END AS status, count(*) FILTER (state = 'conflict') AS conflicts
FROM fx_hunk GROUP BY proposal"""))
def proposal_status(fx):
    return ops.proposal_status(fx.hunks())


@query(with_tables(["fx_revision", "fx_hunk"], """
SELECT r_id, CASE WHEN any_value(r.status) <> 'open question' AND bool_and(coalesce(p.status = 'accepted', false)) THEN 'accepted'
  WHEN any_value(r.status) <> 'open question' AND bool_and(coalesce(p.status = 'rejected', false)) THEN 'rejected'
  ELSE any_value(r.status) END AS status
FROM (SELECT *, unnest(string_split(proposal, ', ')) AS one FROM fx_revision) r LEFT JOIN (
  SELECT proposal, CASE WHEN bool_or(state = 'open') THEN 'open' WHEN bool_and(state = 'accepted') THEN 'accepted'
    WHEN bool_and(state = 'rejected') THEN 'rejected' ELSE 'resolved' END AS status FROM fx_hunk GROUP BY proposal) p
  ON p.proposal = r.one GROUP BY r_id"""))
def revision_status(fx):
    return ops.revision_status(fx.revisions(), ops.proposal_status(fx.hunks()))


@query(with_tables(["fx_revision"], """
SELECT reviewer, round, decision, count(*) AS changes, CAST(sum(words_changed) AS BIGINT) AS words
FROM fx_revision JOIN changed USING (r_id) GROUP BY ALL""", _CHANGED))
def revision_by_reviewer(fx):
    return ops.revision_by_reviewer(fx.revisions(), ops.words_changed(fx.revisions()))


_BY_DECISION = ", ".join(f"CAST(coalesce(sum(words_changed) FILTER (decision = '{d}'), 0) AS BIGINT) AS {d.replace(' ', '_')}"
                         for d in DECISIONS)


@query(with_tables(["fx_revision"], f"""
SELECT CASE file WHEN 'main.tex' THEN 'Title' WHEN 'sections/methods.tex' THEN 'Methods' WHEN 'sections/results.tex' THEN 'Results'
       ELSE 'Other' END AS part, count(*) AS changes, CAST(sum(words_changed) AS BIGINT) AS words, {_BY_DECISION}
FROM fx_revision JOIN changed USING (r_id) GROUP BY 1""", _CHANGED))
def revision_by_part(fx):
    return ops.revision_by_part(fx.revisions(), ops.words_changed(fx.revisions()), DECISIONS)


@query(with_tables(["fx_revision"], """
SELECT r_id FROM fx_revision WHERE status = 'open question' OR decision IN ('partly applied', 'needs author')"""))
def open_questions(fx):
    return ops.open_questions(fx.revisions()).select("r_id")


def texts(fx):
    return fx.table("documents").selectExpr("concat('d', doc_id) AS file", "text")


def edits(fx):
    """Per document: its first word, the letters `the`, and its language's article are replaced."""
    base = fx.table("documents").selectExpr("concat('d', doc_id) AS file", "substring_index(text, ' ', 1) AS first", "lang")
    finds = F.array(F.col("first"), F.lit(" the "), F.when(F.col("lang") == "de", " der ").otherwise(" le "))
    return base.select("file", F.posexplode(finds).alias("pos", "find")).selectExpr(
        "file", "pos + 1 AS n", "find", "concat('<', pos, '>') AS replace", "CASE WHEN pos = 1 THEN 2 END AS nth")


_HITS = """e AS (SELECT 'd' || doc_id AS file, text, unnest([1, 2, 3]) AS n,
  unnest([split_part(text, ' ', 1), ' the ', CASE WHEN lang = 'de' THEN ' der ' ELSE ' le ' END]) AS find FROM documents),
h AS (SELECT *, CAST((length(text) - length(replace(text, find, ''))) / length(find) AS INT) AS hits FROM e)"""


@query("WITH " + _HITS + """
SELECT file, n, hits, CASE WHEN hits = 0 THEN 'not found' WHEN n <> 2 AND hits > 1 THEN 'ambiguous'
       WHEN n = 2 AND hits < 2 THEN 'no such occurrence' END AS problem FROM h""")
def edit_checks(fx):
    return ops.edit_checks(texts(fx), edits(fx))


@query("""
WITH t0 AS (SELECT 'd' || doc_id AS file, text, split_part(text, ' ', 1) AS f1, CASE WHEN lang = 'de' THEN ' der ' ELSE ' le ' END AS f2
            FROM documents),
t1 AS (SELECT *, (length(text) - length(replace(text, f1, ''))) / length(f1) AS h1, replace(text, f1, '<0>') AS text1 FROM t0),
t2 AS (SELECT *, (length(text1) - length(replace(text1, f2, ''))) / length(f2) AS h2 FROM t1)
SELECT file, CASE WHEN h1 = 1 AND h2 = 1 THEN replace(text1, f2, '<2>') ELSE text END AS text,
       CAST(CASE WHEN h1 <> 1 THEN 1 WHEN h2 <> 1 THEN 2 END AS INT) AS failed,
       CASE WHEN h1 = 0 OR (h1 = 1 AND h2 = 0) THEN 'not found' WHEN h1 > 1 OR h2 > 1 THEN 'ambiguous' END AS problem FROM t2""")
def applied_edits(fx):
    """The first and third edit of every document, one after the other."""
    two = edits(fx).where("nth IS NULL").withColumn("n", F.when(F.col("n") == 3, 2).otherwise(F.col("n")))
    return ops.apply_edits(texts(fx), two)


@query()
def applied_edits_all(fx):
    """All three edits of every document, one after the other; the second asks for an occurrence."""
    return ops.apply_edits(texts(fx), edits(fx))


@query("""
SELECT 'd' || doc_id AS file, role AS writer, d.lang = 'fr' AS refused FROM documents d JOIN conversations c ON c.conv_id = d.doc_id
UNION ALL SELECT 'd' || doc_id, 'new', false FROM documents WHERE lang = 'de'""")
def stale_writes(fx):
    """Saves by the speakers of each conversation; French files changed meanwhile, German ones are new."""
    docs = fx.table("documents").selectExpr("concat('d', doc_id) AS file", "doc_id", "text", "lang")
    files = docs.selectExpr("file", "sha2(IF(lang = 'fr', concat(text, '!'), text), 256) AS hash")
    writes = docs.join(fx.table("conversations").selectExpr("conv_id AS doc_id", "role AS writer"), "doc_id").selectExpr(
        "file", "writer", "sha2(text, 256) AS base_hash").unionByName(
        docs.where("lang = 'de'").selectExpr("file", "'new' AS writer", "CAST(NULL AS STRING) AS base_hash"))
    return ops.stale_writes(writes, files)


_LOG = ("concat(IF(lang = 'en', concat('./d', doc_id, '.tex:12: Undefined control sequence. \\n'), '! Emergency stop.\\n'), text,"
        " IF(lang = 'en', concat('\\nd', doc_id, '.tex:12: Undefined control sequence.'), '\\nl.7 end'))")


@query("""
SELECT 'L' || doc_id AS log, CASE WHEN lang = 'en' THEN 'd' || doc_id || '.tex' END AS file,
       CAST(CASE WHEN lang = 'en' THEN 12 ELSE 7 END AS INT) AS line,
       CASE WHEN lang = 'en' THEN 'Undefined control sequence.' ELSE 'Emergency stop.' END AS message FROM documents""")
def log_errors(fx):
    """Build logs around the documents: English ones name a file twice, the others stop with a bare message."""
    return ops.log_errors(fx.table("documents").selectExpr("concat('L', doc_id) AS log", f"{_LOG} AS text"))


@query("""
SELECT 'L' || doc_id AS log, CAST(0 AS INT) AS pos, 'Citation undefined on ' || source AS message FROM documents
UNION ALL SELECT 'L' || doc_id, 1, 'old option' FROM documents""")
def log_warnings(fx):
    text = ("concat('LaTeX Warning: Citation\\n undefined  on ', source, '.\\n', regexp_replace(text, 'Warning', ''),"
            " '\\nPackage babel Warning: old\\noption\\n\\nend')")
    return ops.log_warnings(fx.table("documents").selectExpr("concat('L', doc_id) AS log", f"{text} AS text"))


@query("""
SELECT source AS article, max(n_chars) > 5000 + avg_n + 1 AS stale FROM documents
JOIN (SELECT source AS s, CAST(floor(avg(n_chars)) AS BIGINT) AS avg_n FROM documents GROUP BY source) ON s = source GROUP BY source, avg_n""")
def stale_products(fx):
    docs = fx.table("documents")
    products = docs.groupBy("source").agg((F.floor(F.avg("n_chars")) + 5000).alias("mtime")).withColumnRenamed("source", "article")
    return ops.stale_products(products, docs.select(F.col("source").alias("article"), F.col("n_chars").alias("mtime")))


@query("""
SELECT 'k' || doc_id AS key, CASE WHEN lang = 'fr' THEN 'unsafe' WHEN quality IS NULL THEN 'missing'
  WHEN quality = 1 THEN 'same' ELSE 'copy' END AS action FROM documents LEFT JOIN labels USING (doc_id)""")
def assets_to_sync(fx):
    """Each document as an asset: labelled ones exist, good ones were synced with the content they still have."""
    docs = fx.table("documents").join(fx.table("labels"), "doc_id", "left")
    assets = docs.selectExpr("concat('k', doc_id) AS key", "concat('src/', doc_id) AS source",
                             "concat(IF(lang = 'fr', '../', 'Figures/'), doc_id) AS file")
    have = docs.where("quality IS NOT NULL")
    present = have.selectExpr("concat('src/', doc_id) AS path", "sha2(text, 256) AS hash").unionByName(
        have.selectExpr("concat('Figures/', doc_id) AS path", "sha2(text, 256) AS hash"))
    synced = have.selectExpr("concat('Figures/', doc_id) AS file", "IF(quality = 1, sha2(text, 256), 'old') AS hash")
    return ops.assets_to_sync(assets, present, synced)


@query("""
SELECT user_id AS file, event_id AS seq FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 40""")
def snapshot_retention(fx):
    snapshots = fx.table("events").selectExpr("user_id AS file", "ts", "event_id AS seq")
    return ops.snapshot_retention(snapshots, 40).select("file", "seq")
