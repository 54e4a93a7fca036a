"""The registered queries of the subpackage and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import (
    chat_format,
    filter_audit,
    fingerprints,
    lexical_search,
    license_scan,
    line_crf,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    simhash,
    suffix_dedup,
    warc,
)
from strandline.llm.text import table
from strandline.plans.materialize import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


@query(r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
runs AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), chr(10)) AS run
         FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs),
hit AS (SELECT DISTINCT doc_id, i + j AS k FROM (SELECT doc_id, i FROM twice WHERE n > 1), range(8) r(j)),
repeats AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
worded AS (SELECT doc_id, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lined AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM worded GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS n_exclaims,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_adjacent
         FROM w LEFT JOIN lined USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
            OR (10 * n_upper > 4 * n_letters AND 2 * n_letters > word_chars) OR 10 * n_exclaims > 4 * n_words OR 10 * n_adjacent > 3 * n_words
            OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM base
""")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base failure and verdict of every document."""
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(entries, quality_rules.STRICT, "kept")
    judged = quality_rules.apply_policy(judged, quality_rules.BASE, "_base")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~F.col("_base")).alias("base_failed"), "kept")


@query(r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 1), ' ') AS shingle
         FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM lowered WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
           GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
""")
def op5_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over 2-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 2).select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    stripped = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                           F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
weighed AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
ordered AS (SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, pos) AS k FROM weighed),
sums AS (SELECT *, (SELECT sum(source_size) FROM s)
           - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM ordered),
filling AS (SELECT min(k) AS k FROM sums WHERE 3 * source_size * weights > rest * weight),
targets AS (SELECT s.source, s.source_size, CASE WHEN f.k IS NULL OR s.k < f.k THEN CAST(3 * s.source_size AS DOUBLE)
              ELSE CAST(o.rest * s.weight AS DOUBLE) / CAST(o.weights AS DOUBLE) END AS target
            FROM sums s, filling f LEFT JOIN sums o ON o.k = f.k),
placed AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
           FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
-- the schedule: slot i has the point i * 2654435769 mod 2^32, in one interval per source; blocks hold 1024 words
need AS (SELECT pos, target, CAST(ceil(floor(target) / 1024) AS BIGINT) AS blocks, weighed.source
         FROM targets JOIN weighed ON weighed.source IS NOT DISTINCT FROM targets.source),
slots AS (SELECT CASE WHEN sum(blocks) = 0 THEN 0 ELSE sum(blocks) + sum(blocks) // 64 + 64 END AS n FROM need),
bounds AS (SELECT pos, blocks, CASE WHEN pos = max(pos) OVER () THEN 4294967296
             ELSE CAST(floor(sum(target) OVER (ORDER BY pos) / sum(target) OVER () * 4294967296.0) AS BIGINT) END AS high FROM need WHERE blocks > 0),
cells AS (SELECT pos, blocks, coalesce(lag(high) OVER (ORDER BY pos), 0) AS low, high FROM bounds),
points AS (SELECT CAST(i AS BIGINT) AS slot, CAST((CAST(i AS HUGEINT) * 2654435769) % 4294967296 AS BIGINT) AS point FROM range((SELECT CAST(n AS BIGINT) FROM slots)) r(i)),
turns AS (SELECT slot, pos, row_number() OVER (PARTITION BY pos ORDER BY slot) - 1 AS rank FROM points JOIN cells ON low <= point AND point < high),
short AS (SELECT n.pos, count(t.slot) AS had, n.blocks FROM need n LEFT JOIN turns t USING (pos) GROUP BY n.pos, n.blocks),
plan AS (SELECT slot, pos, rank FROM turns JOIN need USING (pos) WHERE rank < blocks
         UNION ALL SELECT pos + CAST((SELECT n FROM slots) AS BIGINT), pos, unnest(range(had, blocks)) FROM short WHERE had < blocks),
taking AS (SELECT placed.*, pos, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // CAST(source_size AS BIGINT)) * size
             + least(greatest(words % CAST(source_size AS BIGINT) - start, 0), size) END AS BIGINT) AS taken
           FROM placed JOIN need ON need.source IS NOT DISTINCT FROM placed.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, taking.target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM taking LEFT JOIN plan ON plan.pos = taking.pos AND plan.rank = CAST(start AS BIGINT) // 1024
""")
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document, and where it first does."""
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


@query(r"""
WITH added AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens,
             length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS n_text,
             length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS n_role
           FROM added WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE WHEN opens THEN 7 + n_role + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_conversations(rows)
    read = made.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "loss", chat_format.learned_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query()
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    found = fingerprints.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("slots")).alias("fingerprint"),
                        fingerprints.as_text(F.col("edited_slots")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN n < 100 OR d.page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR d.page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND n >= 100
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = line_crf.score(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_lines", "n_bad_lines")


@query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document states."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    best = F.get("licenses", F.lit(0))
    return found.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"), best["license"].alias("license"),
                        best["coverage"].alias("coverage"), best["first_word"].alias("first_word"), "licenses")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
failed AS (SELECT doc_id, part, CAST(len(words) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
           + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER)
           + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS mask FROM w),
told AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
weights AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM failed LEFT JOIN told USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM f v, f w, f x, f y, f z
           WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS earlier
          FROM orders, range(1, 6) r(s)),
counted AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
              sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
              sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
              sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
              sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
              sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM weights, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of every source in all 120 orders."""
    weights = filter_audit.mask_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(weights)


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(rf"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS line, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS words FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term FROM benchmark),
size AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM cut WHERE len(words) > 0),
tf AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(words) AS term FROM cut) WHERE term IN (SELECT term FROM asked) GROUP BY line, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM size) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf GROUP BY term),
m AS (SELECT line, doc_id, 10 + (90 * CAST(len(words) AS BIGINT) * docs) // terms AS m FROM cut, size WHERE len(words) > 0),
scored AS (SELECT item_id, line, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
           FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (line) GROUP BY item_id, line),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scored JOIN m USING (line) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and what they are linked with."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
