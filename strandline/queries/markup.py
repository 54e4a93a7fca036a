"""Article text analytics over the fixture files."""

from pyspark.sql import functions as F

from strandline.fixtures import with_tables
from strandline.operators import markup
from strandline.queries.register import Registry

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql


def count_sql(text):
    """The same word count for text without back slashes other than section heads and evidence markers."""
    steps = [("%[^\\n]*", ""), ("\\\\ev(\\{[^{}]*\\})*", " "), ("\\$[^$]*\\$", " X "), ("\\\\[A-Za-z@]+\\*?", " "), ("~", " ")]
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return (f"len(list_filter(regexp_split_to_array({text}, '[\\s{{}}\\[\\]]+|--+'), lambda w: regexp_matches(w, '[A-Za-z0-9]')))")


@query(with_tables(["fx_tex"], f"SELECT file, CAST({count_sql('text')} AS INT) AS words FROM fx_tex"))
def word_counts(fx):
    return markup.word_counts(fx.tex()).select("file", "words")


def two_sections(fx):
    """Documents with a second heading before every line that starts with a capital T."""
    return fx.tex().withColumn("text", F.regexp_replace("text", r"\nT", "\n\\\\\\\\subsection{ Part T }T"))


@query(with_tables(["fx_tex"], f"""
SELECT file, heading, CAST({count_sql('body')} AS INT) AS words, CAST(pos AS INT) AS pos FROM (
  SELECT file, unnest(range(1, len(parts) + 1)) - 1 AS pos, unnest(parts) AS body,
         unnest(['(opening)', article] || [chr(8195) || 'Part T' FOR x IN range(len(parts) - 2)]) AS heading
  FROM (SELECT file, article, regexp_split_to_array(replace(text, chr(10) || 'T', chr(10) || '\\subsection*{{x}}T'),
               '\\\\(section|subsection)\\*?\\{{[^}}]*\\}}') AS parts FROM fx_tex))
WHERE heading <> '(opening)' OR words > 0"""))
def section_words(fx):
    return markup.section_words(two_sections(fx)).select("file", "heading", "words", "pos")


@query(with_tables(["fx_tex"], f"""
SELECT article, part, CAST(sum(CASE WHEN part = 'References' THEN (length(body) - length(replace(body, 'bibitem', '')) ) / 7
       ELSE {count_sql('body')} END) AS BIGINT) AS words FROM (
  SELECT article, CASE lang WHEN 'fr' THEN 'Abstract' WHEN 'de' THEN 'Supplement' WHEN 'es' THEN 'References'
         ELSE 'Main text' END AS part, CASE WHEN lang = 'es' THEN replace(t.text, '. ', '. \\bibitem{{x}} ') ELSE t.text END AS body
  FROM fx_tex t JOIN documents d USING (doc_id)) GROUP BY ALL"""))
def part_totals(fx):
    """Languages as parts of an article; Spanish texts are its references, one entry per sentence."""
    files = fx.tex().join(fx.table("documents").select("doc_id", "lang"), "doc_id")
    stem = (F.when(F.col("lang") == "fr", "abstract").when(F.col("lang") == "de", "supplemental")
            .when(F.col("lang") == "es", "references").otherwise("results"))
    text = F.when(F.col("lang") == "es", F.replace(F.col("text"), F.lit(". "), F.lit(". \\bibitem{x} "))).otherwise(F.col("text"))
    return markup.part_totals(files.withColumn("stem", stem).withColumn("text", text))


_MAIN = "concat('\\\\input{sections/b}\\n% \\\\input{x}\\n', text, '\\n\\\\include{sections/a.tex}\\n\\\\input{sections/d', doc_id, '}')"


@query(with_tables(["fx_tex"], """
SELECT file AS article, s.stem, CAST(CASE WHEN s.stem = 'b' THEN 0 WHEN s.stem = 'a' THEN 1 ELSE 3 END AS INT) AS rank
FROM fx_tex, (SELECT unnest(['a', 'b', 'c']) AS stem) s"""))
def include_order(fx):
    mains = fx.tex().selectExpr("file AS article", f"{_MAIN} AS text")
    stems = F.array(*[F.lit(s) for s in "abc"])
    return markup.section_order(mains, mains.select("article", F.explode(stems).alias("stem")))


@query(with_tables(["fx_tex"], """
SELECT file AS article, CAST(0 AS INT) AS rank, 'sections/b.tex' AS file FROM fx_tex
UNION ALL SELECT file, 1, 'sections/a.tex' FROM fx_tex UNION ALL SELECT file, 2, 'sections/d' || doc_id || '.tex' FROM fx_tex"""))
def included_files(fx):
    return markup.included_files(fx.tex().selectExpr("file AS article", f"{_MAIN} AS text"))


def figured(fx):
    """Files whose first line also shows a figure and a table."""
    return fx.tex().withColumn("text", F.concat(F.lit("\\figref[A]{1} \\supref{S1}\\tabref{"), F.col("doc_id") % 7, F.lit("}"), "text"))


_USES = """uses AS (
  SELECT file, CAST(n AS INT) AS line, name FROM (
    SELECT file, doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS code FROM fx_tex)
    , LATERAL (SELECT unnest(['E' || (doc_id % 50)]) AS name)
  WHERE contains(split_part(code, '%', 1), '\\ev{')
  UNION ALL SELECT file, 1, unnest(['@F1', '@S1', '@T' || (doc_id % 7)]) FROM fx_tex)"""


@query(with_tables(["fx_tex"], "SELECT name, file, line FROM uses", _USES))
def marker_uses(fx):
    return markup.marker_uses(figured(fx)).select("name", "file", "line")


def registers(fx):
    """Papers of every second cited entry, some data files, assets named after figures."""
    t = fx.table("benchmark")
    cited = t.where("length(text) > 300").selectExpr("concat('r', item_id) AS key", "concat('r', item_id, '.pdf') AS file")
    assets = t.selectExpr("concat('F', item_id, 'x') AS key", "concat('Figures/F', item_id, '.pdf') AS file")
    present = t.selectExpr("concat('CitedArticles/r', item_id, '.pdf') AS path").unionByName(
        t.where("length(text) < 600").selectExpr("concat('data/q', item_id, '.tsv') AS path"))
    return cited, assets, present


@query(with_tables(["fx_evidence"], """
SELECT id, CASE WHEN target LIKE 'r%' THEN 'cite' ELSE 'file' END AS kind,
  CASE WHEN target LIKE 'r%' THEN CASE WHEN length(text) > 300 THEN 'CitedArticles/' || target || '.pdf' END
       WHEN length(text) < 600 THEN target END AS path,
  CASE WHEN target LIKE 'r%' THEN CASE WHEN length(text) <= 300 THEN 'paper not in the folder' END
       WHEN length(text) >= 600 THEN 'not a file in the folder' END AS problem
FROM fx_evidence JOIN benchmark USING (item_id)"""))
def evidence_targets(fx):
    return markup.evidence_targets(fx.evidence(), *registers(fx))


@query(with_tables(["fx_evidence", "fx_tex"], """
SELECT 'not in the register' AS problem, name, count(*) AS n FROM uses WHERE name LIKE 'E%' AND name NOT IN (SELECT id FROM fx_evidence)
GROUP BY name
UNION ALL SELECT 'unused', id, 1 FROM fx_evidence WHERE id NOT IN (SELECT name FROM uses)
UNION ALL SELECT 'asset not registered', substring(name, 2), count(*) FROM uses WHERE name LIKE '@S%' OR name LIKE '@T%' GROUP BY name
UNION ALL SELECT 'bad id', 'E1b', count(*) FROM documents WHERE source = 'src1'
UNION ALL SELECT 'listed twice', 'E3', 2""", _USES))
def evidence_problems(fx):
    bad = fx.table("documents").where("source = 'src1'").selectExpr("'E1b' AS id")
    twice = fx.evidence().select("id").unionByName(fx.evidence().where("id = 'E3'").select("id"))
    _, assets, _ = registers(fx)
    return markup.evidence_problems(twice.unionByName(bad), markup.marker_uses(figured(fx)), assets)


_NORMAL = "trim(lower(regexp_replace({}, '\\s+', ' ', 'g')))"
_BARE = """' ' || array_to_string(list_transform(string_split({}, ' '), lambda w: trim(w, '.,;:()[]''"')), ' ') || ' '"""


@query(f"""
WITH q AS (SELECT quote_id, q, {_BARE.format('q')} AS bare FROM (
  SELECT 'w' || item_id AS quote_id, {_NORMAL.format('text')} AS q FROM benchmark
  UNION ALL SELECT 's' || item_id, {_NORMAL.format("split_part(text, '.', 1)")} FROM benchmark
  UNION ALL SELECT 't' || item_id, array_to_string(list_slice(string_split({_NORMAL.format('text')}, ' '), 1, 2), ' ') FROM benchmark
  UNION ALL SELECT 'p' || item_id, replace({_NORMAL.format("split_part(text, '.', 1)")}, ',', '') || ';' FROM benchmark)),
p AS (SELECT doc, page_no, page, {_BARE.format('page')} AS bare FROM (SELECT source AS doc, doc_id AS page_no, {_NORMAL.format('text')} AS page FROM documents)),
hits AS (SELECT quote_id, doc, page_no, CASE WHEN contains(page, q) THEN 'text' ELSE 'words' END AS how
         FROM q JOIN p ON contains(page, q) OR contains(p.bare, q.bare) WHERE q <> ''),
best AS (SELECT quote_id, doc, min(how) AS how FROM hits GROUP BY quote_id, doc)
SELECT quote_id, doc, min(page_no) AS page_no, how FROM hits JOIN best USING (quote_id, doc, how) GROUP BY quote_id, doc, how
UNION ALL SELECT quote_id, NULL, NULL, 'not found' FROM q WHERE quote_id NOT IN (SELECT quote_id FROM best)""")
def quote_matches(fx):
    """Benchmark passages, their first sentences, those with other punctuation, and their first two words, in the documents of each
    source."""
    t = fx.table("benchmark")
    quotes = (t.selectExpr("concat('w', item_id) AS quote_id", "text AS quote")
              .unionByName(t.selectExpr("concat('s', item_id) AS quote_id", "substring_index(text, '.', 1) AS quote"))
              .unionByName(t.selectExpr("concat('t', item_id) AS quote_id",
                                        "substring_index(trim(regexp_replace(text, '\\\\s+', ' ')), ' ', 2) AS quote"))
              .unionByName(t.selectExpr("concat('p', item_id) AS quote_id", "concat(replace(substring_index(text, '.', 1), ',', ''), ';') AS quote")))
    quotes = quotes.selectExpr("*", "CAST(NULL AS BIGINT) AS want", "CAST(NULL AS STRING) AS doc")
    pages = fx.table("documents").selectExpr("source AS doc", "doc_id AS page_no", "text")
    return markup.match_quotes(quotes, pages)


@query("""
SELECT doc_id AS text_id, 'B' || (doc_id % 50) AS ref FROM documents
WHERE doc_id % 50 IN (SELECT item_id FROM benchmark) AND doc_id % 50 >= 5""")
def doi_matches(fx):
    """Documents that mention a DOI with blanks inside; a few references also have a shorter DOI that fits."""
    texts = fx.table("documents").selectExpr(
        "doc_id AS text_id", "concat(text, ' doi: 10. ', 1000 + doc_id % 50, '/aB', doc_id % 50, 'z next 10.5') AS text")
    t = fx.table("benchmark")
    refs = t.selectExpr("concat('B', item_id) AS ref", "concat('10.', 1000 + item_id, '/AB', item_id, 'Z') AS doi").unionByName(
        t.where("item_id < 5").selectExpr("concat('S', item_id) AS ref", "concat('10.', 1000 + item_id, '/a') AS doi"))
    return markup.match_doi(texts, refs).select("text_id", "ref")


def gaps(fx):
    """Each document's last twelve letters as an anchor; French gaps have a cause."""
    return fx.table("documents").selectExpr(
        "concat('d', doc_id, '.tex') AS file", "right(text, 12) AS anchor", "IF(lang = 'fr', 'known', ' ') AS cause")


@query(with_tables(["fx_tex"], """
SELECT file, CASE WHEN once THEN CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) END AS line, NOT once AS stale,
       lang = 'fr' AS explained FROM (
  SELECT t.file, lang, (length(t.text) - length(replace(t.text, right(d.text, 12), ''))) = length(right(d.text, 12)) AS once,
         left(t.text, instr(t.text, right(d.text, 12)) - 1) AS before
  FROM fx_tex t JOIN documents d USING (doc_id))"""))
def gap_locations(fx):
    return markup.gap_locations(gaps(fx), fx.tex()).select("file", "line", "stale", "explained")


@query(with_tables(["fx_evidence"], """
SELECT 'mismatch' AS kind, id FROM fx_evidence WHERE note LIKE 'MISMATCH%'
UNION ALL SELECT 'nofile', id FROM fx_evidence JOIN benchmark USING (item_id)
WHERE CASE WHEN target LIKE 'r%' THEN length(text) <= 300 ELSE length(text) >= 600 END"""))
def evidence_missing(fx):
    return markup.evidence_missing(fx.evidence(), markup.evidence_targets(fx.evidence(), *registers(fx)))


_IGNORED = "%[^\\n]*|\\bchr\\w+|\\brs\\d+|\\b\\d+[pq]\\d+(?:\\.\\d+)?|\\b[A-Z][A-Z0-9-]*\\d[A-Z0-9-]*\\b|\\b[A-Za-z]+\\d+[A-Za-z]*\\b"


@query(with_tables(["fx_tex"], f"""
SELECT file, CAST(line AS INT) AS line, trim(claim) AS claim FROM (
  SELECT file, line, unnest(string_split(regexp_replace(code, '([.?!])\\s+([A-Z\\\\(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS claim
  FROM (SELECT file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS code FROM fx_tex
        WHERE contains(text, '\\ev{{'))
  WHERE NOT regexp_matches(trim(code), '^(\\\\section|%)'))
WHERE NOT contains(claim, '\\ev{{') AND regexp_matches(regexp_replace(claim, '{_IGNORED}', ' ', 'g'), '[0-9]')"""))
def unmarked_numbers(fx):
    return markup.unmarked_numbers(fx.tex()).select("file", "line", "claim")


@query("""
SELECT "table", CAST(line AS INT) AS line FROM (
  SELECT doc_id AS "table", unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(lower(text), chr(10))) AS code
  FROM documents)
WHERE line = 3 OR (contains(code, 'the') AND contains(code, 'and')) OR contains(code, 'zu') OR contains(code, 'que')""")
def find_rows(fx):
    """Lines of every document that a place description names."""
    rows = fx.table("documents").select(F.col("doc_id").alias("table"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    places = fx.table("documents").selectExpr("doc_id AS table", "'sheet=a ; find = The & and | zu|que; row=3' AS where")
    return markup.find_rows(rows.select("table", (F.col("pos") + 1).alias("line"), "text"), places)
