"""Text analytics over marked-up article files: word counts, markers, evidence, quotes, gaps.

`files` has article, file and text (one row per file, whole text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import markup as m
from strandline.functions.keys import scope
from strandline.plans import cut, few, if_few
from strandline.vocab import PART_BY_STEM, SKIPPED_STEMS

FILE = ["article", "file"]


def word_counts(files: DataFrame) -> DataFrame:
    return files.select(*FILE, m.markup_word_count(F.col("text")).alias("words"))


def section_words(files: DataFrame) -> DataFrame:
    """(file, pos, heading, words) per section; text before the first heading only when it has words."""
    kinds = F.regexp_extract_all("text", F.lit(m.HEADING), 1)
    names = F.regexp_extract_all("text", F.lit(m.HEADING), 2)
    heads = F.concat(F.array(F.lit("(opening)")), F.zip_with(
        kinds, names, lambda k, n: F.concat(F.when(k == "section", "").otherwise("\u2003"), F.trim(n))))
    parts = F.arrays_zip(heads.alias("heading"), F.split("text", m.HEADING, -1).alias("body"))
    rows = files.select(*FILE, F.posexplode(parts).alias("pos", "part")).select(
        *FILE, "pos", F.col("part.heading").alias("heading"), m.markup_word_count(F.col("part.body")).alias("words"))
    return rows.where("words > 0 OR heading <> '(opening)'")


def article_part(stem: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, part in PART_BY_STEM.items():
        out = out.when(stem == name, part)
    return out.otherwise("Main text")


def part_totals(files: DataFrame) -> DataFrame:
    """(article, part, words): words per part; references are counted as entries. `files` carries stem."""
    part = article_part(F.col("stem"))
    entries = F.regexp_count("text", F.lit(r"\\bibitem\{"))
    counted = files.where(~F.col("stem").isin(SKIPPED_STEMS)).select("article", part.alias("part"), "text")
    n = F.when(F.col("part") == "References", entries).otherwise(m.markup_word_count(F.col("text")))
    return counted.groupBy("article", "part").agg(F.sum(n).cast("long").alias("words"))


def included_files(mains: DataFrame) -> DataFrame:
    """(article, rank, file): files a main text includes, in order, comments left out."""
    names = F.regexp_extract_all(F.regexp_replace("text", m.STRIPPING[0][0], ""), F.lit(m.INCLUDED), 1)
    rows = mains.select("article", F.posexplode(names).alias("rank", "name"))
    file = F.when(F.endswith("name", F.lit(".tex")), F.col("name")).otherwise(F.concat("name", F.lit(".tex")))
    return rows.select("article", "rank", file.alias("file"))


def section_order(mains: DataFrame, sections: DataFrame) -> DataFrame:
    """(article, stem, rank) to sort section files by (rank, stem): order of inclusion, unlisted ones last."""
    names = F.regexp_extract_all("text", F.lit(m.SECTION_FILE), 1)
    listed = mains.select("article", F.size(F.array_distinct(names)).alias("last"),
                          F.posexplode_outer(names).alias("rank", "stem"))
    ranks = listed.where("stem IS NOT NULL").groupBy("article", "stem").agg(F.max("rank").alias("rank"))
    ends = mains.select("article", F.size(F.array_distinct(names)).alias("last"))
    return sections.join(ranks, ["article", "stem"], "left").join(ends, "article").select(
        "article", "stem", F.coalesce("rank", "last").alias("rank"))


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text): numbered lines."""
    return files.select(*FILE, F.posexplode(F.split("text", "\r?\n")).alias("pos", "line_text")).select(
        *FILE, (F.col("pos") + 1).alias("line"), F.col("line_text").alias("text"))


def marker_uses(files: DataFrame) -> DataFrame:
    """(name, file, line): evidence ids, and asset keys led by @, where the text uses them."""
    code = m.without_comment(F.col("text"))
    marks = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(m.EVIDENCE_MARK), 1), lambda s: F.split(s, ",")))
    kinds, keys = (F.regexp_extract_all(code, F.lit(m.ITEM_MARK), i) for i in (1, 2))
    items = F.zip_with(kinds, keys, lambda k, s: F.concat(
        F.lit("@"), F.when(k == "figref", "F").when(k == "tabref", "T").otherwise(""), F.trim(s)))
    names = F.concat(F.transform(marks, lambda s: F.trim(s)), items)
    return lines(files.where(F.contains("text", F.lit("\\")))).select(*FILE, "line", F.explode(names).alias("name"))


def evidence_targets(evidence: DataFrame, cited: DataFrame, assets: DataFrame, present: DataFrame) -> DataFrame:
    """(id, kind, path, problem): where each evidence entry points.

    `cited` has key and file (in the folder for cited articles), `assets` key and file, `present` path.
    """
    key = scope(evidence, cited, assets, present)
    there = present.select(*key, "path").distinct().withColumn("here", F.lit(True))
    paper = cited.select(*key, F.col("key").alias("target"), F.concat(F.lit("CitedArticles/"), "file").alias("paper"))
    asset = assets.select(*key, F.col("key").alias("target"), F.col("file").alias("asset"))
    rows = evidence.join(paper, [*key, "target"], "left").join(asset, [*key, "target"], "left")
    cite = F.col("target").rlike(m.CITE_KEY)
    kind = F.when(cite, "cite").when(F.col("asset").isNotNull(), "asset").otherwise("file")
    rows = rows.withColumn("kind", kind).withColumn("path", F.when(cite, F.col("paper")).otherwise(
        F.coalesce("asset", "target")))
    safe = F.col("path").rlike(m.SAFE_PATH) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)") & ~F.startswith("path", F.lit("/"))
    rows = rows.join(there, [*key, "path"], "left")
    empty = F.coalesce("target", F.lit("")) == ""
    problem = (F.when(empty, "no target").when(cite & F.col("here").isNull(), "paper not in the folder")
               .when((F.col("kind") == "asset") & F.col("here").isNull(), "asset missing")
               .when((F.col("kind") == "file") & (F.col("here").isNull() | ~safe), "not a file in the folder"))
    keeps = (F.col("kind") == "asset") | problem.isNull()
    return rows.select(*scope(evidence), "id", "kind", F.when(keeps & ~empty, F.col("path")).alias("path"), problem.alias("problem"))


def evidence_problems(evidence: DataFrame, uses: DataFrame, assets: DataFrame) -> DataFrame:
    """(problem, name, n): bad ids, ids listed twice, names used but not registered, ids never used."""
    key = scope(evidence, uses, assets)
    ids = evidence.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n"))
    good = ids.where(F.col("id").rlike(m.EVIDENCE_ID))
    used = uses.groupBy(*key, "name").agg(F.count(F.lit(1)).alias("n"))
    marks = used.where("NOT startswith(name, '@')")
    items = used.where("startswith(name, '@')").withColumn("key", F.substr("name", F.lit(2)))
    # a used key also stands for every asset key that begins with it
    starts = assets.select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.left("key", i))).alias("key")).distinct()
    known = good.select(*key, F.col("id").alias("name"))

    def rows(df: DataFrame, what: str, name: str) -> DataFrame:
        return df.select(*key, F.lit(what).alias("problem"), F.col(name).alias("name"), "n")

    return reduce(DataFrame.unionByName, [
        rows(ids.where(~F.col("id").rlike(m.EVIDENCE_ID)), "bad id", "id"), rows(good.where("n > 1"), "listed twice", "id"),
        rows(marks.join(known, [*key, "name"], "left_anti"), "not in the register", "name"),
        rows(items.join(starts, [*key, "key"], "left_anti"), "asset not registered", "key"),
        rows(good.join(marks.select(*key, F.col("name").alias("id")), [*key, "id"], "left_anti"), "unused", "id")])


def _grams(words: Column, k: int) -> Column:
    """Hashes of every k words in a row."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(
        *[F.get(words, i + (j - 1)) for j in range(k)]))
    return F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>"))


# The punctuation that may stick to a word.
GLUED = ".,;:()[]'\""
# end of fixed values
_GLUED = r"(^| )[.,;:()\[\]'\"]+|[.,;:()\[\]'\"]+(?= |$)"
TEXT, WORDS = "text", "words"


def bare_words(normal: Column) -> Column:
    """A normalised text without the punctuation at the ends of its words."""
    return F.regexp_replace(normal, F.lit(_GLUED), F.lit("$1"))


def _has_words(page: Column, quote: Column) -> Column:
    """Do the words of the quote follow each other on the page? Both without glued punctuation."""
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.contains(spaced(page), spaced(quote))


def quote_pairs(quotes: DataFrame, pages: DataFrame, k: int = 2) -> DataFrame:
    """(quote_id, doc, page_no, how): pages that show the quote, line breaks and typography aside, also more than once. `how` is 'text' where the text
    contains it, or 'words' where only its words follow each other, whatever punctuation is glued to them.

    The words inside a quote are whole words on its page in either case, so k of them in a row (fewer in short quotes)
    lead to the candidate pages by an equi-join; the full texts are compared only there. Quotes of one or two words have no
    inner word: what stands beside their blank, or the vocabulary of all pages, leads to them. While the word runs asked for and the pages
    found are few, they are sent to the pages, which are not shuffled then.
    """
    page = ["doc", "page_no"]
    known, _ = cut(pages.select(*page, m.normal_text(F.col("text")).alias("page")), "pages", row_group=1 << 20)
    asked = (quotes.select("quote_id", m.normal_text(F.col("quote")).alias("quote")).where("quote <> ''")
             .withColumn("bare", bare_words(F.col("quote"))).withColumn("words", F.split("bare", " ")))
    asked, told = cut(asked.withColumn("inner", F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0))))
                   .withColumn("k", F.least(F.size("inner"), F.lit(k))), "quotes")
    lengths = sorted(r["k"] for r in asked.select("k").distinct().collect())  # at most k + 1 values
    inner, parts = [n for n in lengths if n > 0], []
    if inner:
        # stored first, so that its size decides how the far larger page side is joined
        offered, n_offered = cut(reduce(DataFrame.unionByName, [asked.where(F.col("k") == n).select(
            "quote_id", F.explode(F.array_distinct(_grams(F.col("inner"), n))).alias("gram")) for n in inner]), "offered")
        wanted = if_few(offered.select("gram").distinct(), n_offered["rows"])
        worded = known.withColumn("words", F.split(bare_words(F.col("page")), " "))
        grams = F.flatten(F.array(*[_grams(F.col("words"), n) for n in inner]))
        found, _ = cut(worded.select(*page, F.explode(grams).alias("gram")).join(wanted, "gram", "left_semi").distinct(), "grams")
        on_pages = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # of the word runs of a quote, the one on the fewest pages leads to the candidates
        rarest = (offered.join(on_pages, "gram", "left").groupBy("quote_id")
                  .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
                  .where("a.n > 0").select("quote_id", F.col("a.gram").alias("gram")))
        pairs, n_pairs = cut(found.join(if_few(rarest, told["rows"]), "gram").select("quote_id", *page), "pairs")
        shown = known.join(if_few(pairs, n_pairs["rows"]), page)
        both = shown.join(if_few(asked.select("quote_id", "quote", "bare"), told["rows"]), "quote_id")
        how = F.when(F.contains("page", F.col("quote")), TEXT).when(_has_words(bare_words(F.col("page")), F.col("bare")), WORDS)
        parts.append(both.select("quote_id", *page, how.alias("how")).where("how IS NOT NULL"))
    if 0 in lengths:
        parts += _short_quotes(asked.where("k = 0"), known, page, told["rows"])
    if not parts:
        return known.select(F.lit(None).cast("string").alias("quote_id"), *page, F.lit(TEXT).alias("how")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _runs(word: Column, n: int) -> Column:
    """Every n characters in a row."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substr(word, i, F.lit(n)))


EDGE = 2


def _beside_blank(two: DataFrame, known: DataFrame, page: list[str]) -> DataFrame:
    """Pages with one of few quotes of two words. Up to EDGE letters on each side of its blank, or both words without glued punctuation, lead
    from two neighbouring words to it; the words themselves decide."""
    quoted = F.split("quote", " ")
    ends = two.select("quote_id", "bare", quoted[0].alias("first"), quoted[1].alias("last")).withColumn(
        "m", F.least(F.length("first"), F.lit(EDGE))).withColumn("n", F.least(F.length("last"), F.lit(EDGE)))
    sizes = sorted((r["m"], r["n"]) for r in ends.select("m", "n").distinct().collect())  # at most EDGE * EDGE
    at_blank = lambda a, m, b, n: F.xxhash64(F.lit(TEXT), F.right(a, m), F.left(b, n))
    as_words = lambda bare: F.xxhash64(F.lit(WORDS), bare)
    wanted = ends.select("quote_id", "bare", "first", "last", F.inline(F.array(
        F.struct(F.lit(TEXT).alias("how"), at_blank(F.col("first"), F.col("m"), F.col("last"), F.col("n")).alias("key")),
        F.struct(F.lit(WORDS).alias("how"), as_words(F.col("bare")).alias("key")))))
    words = known.select(*page, F.split("page", " ").alias("w"), F.split(bare_words(F.col("page")), " ").alias("c"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    beside = words.select(*page, F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"),
                          F.slice("c", F.lit(1), n).alias("c"), F.slice("c", F.lit(2), n).alias("d"))
    near = beside.select(*page, F.inline(F.arrays_zip("a", "b", "c", "d"))).withColumn("c", F.concat("c", F.lit(" "), "d")).drop("d")
    keys = [F.when((F.length("a") >= m) & (F.length("b") >= n), at_blank(F.col("a"), F.lit(m), F.col("b"), F.lit(n))) for m, n in sizes]
    led = near.select(*page, "a", "b", "c", F.explode(F.array(as_words(F.col("c")), *keys)).alias("key"))
    fits = F.when(F.col("how") == TEXT, F.endswith("a", F.col("first")) & F.startswith("b", F.col("last"))).otherwise(F.col("c") == F.col("bare"))
    return led.join(F.broadcast(wanted), "key").where(fits).select("quote_id", *page, "how")


def _short_quotes(short: DataFrame, known: DataFrame, page: list[str], n_quotes: int) -> list[DataFrame]:
    """Pages with a quote of one or two words, found through the vocabulary of all pages; of two in a list of few quotes, `_beside_blank`.

    One word lies inside some word of the page. Of two, the first ends a word and the second begins the next one. Or the
    words are those of the page but for glued punctuation.
    """
    kinds = {r[0] for r in short.select(F.size("words")).distinct().collect()}
    parts = []
    if 2 in kinds and few(n_quotes):
        parts.append(_beside_blank(short.where("size(words) = 2"), known, page))
        kinds.remove(2)
    if not kinds:
        return parts
    text, words = F.lit(TEXT).alias("how"), F.lit(WORDS).alias("how")
    worded = known.select(*page, F.split("page", " ").alias("words"))
    vocabulary, _ = cut(worded.select(F.explode(F.array_distinct("words")).alias("word")).distinct(), "vocabulary", row_group=1 << 20)
    upto = F.sequence(F.lit(1), F.length("word"))
    quoted = F.split("quote", " ")
    first, last = quoted[0], quoted[F.size(quoted) - 1]
    alike = vocabulary.select("word", bare_words(F.col("word")).alias("key"))
    known_as = lambda part, name: alike.join(short.where("size(words) = 2").select(
        "quote_id", bare_words(part).alias("key")), "key").select("quote_id", F.col("word").alias(name), words)
    if 1 in kinds:
        # the first three letters of the part, or all of a shorter one, stand somewhere in the word
        sizes = sorted(r[0] for r in short.where("size(words) = 1").select(F.least(F.length("quote"), F.lit(3))).distinct().collect())
        runs = F.array_distinct(F.concat(*[_runs(F.col("word"), n) for n in sizes]))
        one = short.where("size(words) = 1").select("quote_id", F.left("quote", F.lit(3)).alias("key"), F.col("quote").alias("part"))
        inside = vocabulary.select("word", F.explode(runs).alias("key")).join(if_few(one, n_quotes), "key").where(
            F.contains("word", F.col("part"))).select("quote_id", "word", text)
        same = alike.join(short.where("size(words) = 1").select("quote_id", F.col("bare").alias("key")), "key").select("quote_id", "word", words)
        inside, n_inside = cut(inside.unionByName(same).distinct(), "inside")
        parts.append(worded.select(*page, F.explode(F.array_distinct("words")).alias("word")).join(if_few(inside, n_inside["rows"]), "word").select("quote_id", *page, "how"))
    if 2 in kinds:
        two = short.where("size(words) = 2")
        ends = vocabulary.withColumn("key", F.explode(F.transform(upto, lambda i: F.substr("word", i)))).join(
            two.select("quote_id", first.alias("key")), "key").select("quote_id", F.col("word").alias("a"), text)
        ends, _ = cut(ends.unionByName(known_as(first, "a")), "ends")
        begins = vocabulary.withColumn("key", F.explode(F.transform(upto, lambda i: F.left("word", i)))).join(
            two.select("quote_id", last.alias("key")), "key").select("quote_id", F.col("word").alias("b"), text)
        begins, _ = cut(begins.unionByName(known_as(last, "b")), "begins")
        n = F.greatest(F.size("words") - 1, F.lit(0))
        neighbours = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        near = worded.select(*page, F.inline(neighbours))
        for side, name in ((ends, "a"), (begins, "b")):
            near = near.join(side.select(name).distinct(), name, "left_semi")
        parts.append(near.join(ends, "a").join(begins, ["quote_id", "how", "b"]).select("quote_id", *page, "how"))
    return parts


def match_quotes(quotes: DataFrame, pages: DataFrame, k: int = 2) -> DataFrame:
    """(quote_id, doc, page_no, how): the page that shows the quote in each document. Pages whose text contains it come before those
    that only have its words ('text', 'words'), then the wanted page, then the lowest one.

    `quotes` has quote_id, quote, want (page or null), doc (or null: all documents). A quote that is on no page it may be on has one
    row: 'not found', with the document that was asked and no page.
    """
    quotes, told = cut(quotes.select("quote_id", "quote", "want", "doc"), "asked")
    wanted = if_few(quotes.select("quote_id", "want", F.col("doc").alias("_doc")), told["rows"])
    found = quote_pairs(quotes, pages, k).join(wanted, "quote_id")
    here = found.where("_doc IS NULL OR _doc = doc")
    order = F.struct("how", (~F.col("page_no").eqNullSafe(F.col("want"))).cast("int").alias("other"), "page_no")
    shown, _ = cut(here.groupBy("quote_id", "doc").agg(F.min(order).alias("best")).select(
        "quote_id", "doc", F.col("best.page_no").alias("page_no"), F.col("best.how").alias("how")), "shown")
    missing = quotes.select("quote_id", "doc").distinct().join(shown, "quote_id", "left_anti")
    return shown.unionByName(missing.select("quote_id", "doc", F.lit(None).cast(shown.schema["page_no"].dataType).alias("page_no"),
                                            F.lit("not found").alias("how")))


def match_doi(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """(text_id, ref, hits): the reference whose DOI a text contains, when it is exactly one.

    White space does not count. DOIs are grouped by their first 2^k characters, for the largest k that fits. What follows an occurrence
    of `10.` is looked up at lengths 2, 4, 8, ..., which gives the few lengths of DOIs that start like it, and then at those.
    """
    clean = F.lower(F.regexp_replace("doi", r"(?U)\s+", ""))
    power = lambda k: F.pow(F.lit(2.0), k).cast("int")
    waiting = refs.select("ref", clean.alias("doi")).withColumn("tail", F.regexp_extract("doi", r"10\..*$", 0)).where("tail <> ''")
    waiting, _ = cut(waiting.withColumn("start", F.left("tail", power(F.floor(F.log2(F.length("tail").cast("double")))))), "dois")
    longest = waiting.agg(F.max(F.length("tail"))).first()[0] or 1
    # the lengths of the DOIs with one start lie between its length and twice that
    starts = waiting.groupBy("start").agg(F.collect_set(F.length("tail")).alias("sizes"))
    flat = texts.select("text_id", F.lower(F.regexp_replace("text", r"(?U)\s+", "")).alias("flat"))
    # what follows each occurrence, as far as the longest DOI; it may hold the next occurrence
    pieces = flat.where(F.contains("flat", F.lit("10."))).select("text_id", F.transform(
        F.split("flat", r"10\.", -1), lambda s: F.left(s, F.lit(longest))).alias("pieces"))
    at = F.transform(F.sequence(F.lit(2), F.size("pieces")), lambda i: F.left(F.concat(F.lit("10."), F.array_join(
        F.slice("pieces", i, F.lit(longest // 3 + 1)), "10.")), F.lit(longest)))
    tails = pieces.select("text_id", F.explode(at).alias("after"))
    levels = F.sequence(F.lit(1), F.floor(F.log2(F.length("after").cast("double"))).cast("int"))
    probes = tails.select("text_id", F.inline(F.transform(levels, lambda k: F.struct(
        F.left("after", power(k)).alias("start"), F.left("after", power(k + 1) - 1).alias("after")))))
    alike = probes.distinct().join(starts, "start")
    fits = F.filter("sizes", lambda n: n <= F.length("after"))
    tried = alike.select("text_id", F.explode(F.transform(fits, lambda n: F.left("after", n))).alias("tail")).distinct()
    hits = tried.join(waiting.drop("start"), "tail").select("text_id", "ref", "doi").distinct()
    # a DOI written with something before the 10. must occur as a whole
    whole = hits.where(F.startswith("doi", F.lit("10."))).select("text_id", "ref")
    longer = hits.where(~F.startswith("doi", F.lit("10."))).join(flat, "text_id").where(F.contains("flat", F.col("doi"))).select("text_id", "ref")
    return (whole.unionByName(longer).groupBy("text_id").agg(F.min("ref").alias("ref"), F.count(F.lit(1)).alias("hits"))
            .where("hits = 1"))


def gap_locations(gaps: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded gaps with the line of their anchor: stale unless it occurs exactly once; explained when a cause is given."""
    key = [*scope(gaps, files), "file"]
    rows = gaps.join(files.select(*key, "text"), key, "left")
    times = (F.length("text") - F.length(F.replace(F.col("text"), F.col("anchor"), F.lit("")))) / F.length("anchor")
    once = (F.length("anchor") > 0) & (times == 1)
    at = F.when(once, F.expr("instr(text, anchor)"))
    before = F.left("text", F.col("at") - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1))
    return (rows.withColumn("at", at).select(
        *gaps.columns, line.cast("int").alias("line"), column.alias("column"), F.col("at").isNull().alias("stale"),
        (F.trim(F.coalesce("cause", F.lit(""))) != "").alias("explained")))


def evidence_missing(evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """(kind, id): entries that disagree with the text, and entries without a file."""
    mismatch = evidence.where(F.startswith("note", F.lit("MISMATCH"))).select(
        *scope(evidence, targets), F.lit("mismatch").alias("kind"), "id")
    return mismatch.unionByName(targets.where("path IS NULL").select(*scope(evidence, targets), F.lit("nofile").alias("kind"), "id"))


def gap_spans(located: DataFrame) -> DataFrame:
    """(file, line, x, y): the columns each located gap covers, line by line."""
    piece = F.split("anchor", "\n")
    key = [*scope(located), "file"]
    rows = located.where("NOT stale").select(*key, "line", "column", F.posexplode(piece).alias("i", "piece"))
    x = F.when(F.col("i") == 0, F.col("column")).otherwise(F.lit(0))
    return rows.select(*key, (F.col("line") + F.col("i")).alias("line"), x.alias("x"), (x + F.length("piece")).alias("y"))


def unmarked_numbers(files: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(file, line, claim): sentences with a number and no evidence marker, in files that use markers.

    Left out are tables with a marker, lines that state nothing and the columns of recorded gaps (`gap_spans`), which
    are matched line by line.
    """
    key = [*(scope(files) if spans is None else scope(files, spans)), "file"]
    first_line = F.substring_index("text", "\n", 1)
    audited = files.where(F.contains("text", F.lit("\\ev{")) & ~F.startswith("text", F.lit(m.GENERATED))
                          & ~F.contains(first_line, F.lit(m.NO_EVIDENCE)))
    # lines inside a table that carries a marker get a sign in front
    covered = "\ue000"
    marked = F.filter(F.regexp_extract_all("text", F.lit(m.TABLE_BODY), 0), lambda t: F.contains(t, F.lit("\\ev{")))
    signed = F.reduce(marked, F.col("text"), lambda t, body: F.replace(
        t, body, F.replace(body, F.lit("\n"), F.lit("\n" + covered))))
    rows = audited.select(*key, F.posexplode(F.split(signed, "\n")).alias("pos", "text"))
    kept = rows.where(~F.startswith("text", F.lit(covered)) & ~F.trim("text").rlike(m.SKIPPED_LINE))
    sentences = F.posexplode(F.split("text", m.SENTENCE_BREAK)).alias("n", "claim")
    claims = kept.select(*key, (F.col("pos") + 1).alias("line"), F.col("text").alias("_line"), sentences)
    body = F.regexp_replace("claim", m.NOT_CLAIMS, " ")
    claims = claims.where(~F.contains("claim", F.lit("\\ev{")) & body.rlike(r"\d"))
    if spans is not None:
        at = F.expr("instr(_line, claim)") - 1
        inside = (claims.select(*key, "line", "n", at.alias("a"), (at + F.length("claim")).alias("b"))
                  .join(spans, [*key, "line"]).where("x < b AND a < y").select(*key, "line", "n").distinct())
        claims = claims.join(inside, [*key, "line", "n"], "left_anti")
    return claims.select(*key, "line", F.trim("claim").alias("claim"))


def parse_where(where: Column) -> dict[str, Column]:
    """Row terms of a place such as `sheet=s; find=a&b|c; row=3`: terms (any of, each all of) and row numbers."""
    def field(name: str) -> Column:
        return F.regexp_extract(where, rf"(?:^|;)\s*{name}\s*=\s*([^;]*)", 1)

    alternatives = F.filter(F.transform(F.split(field("find"), r"\|"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    terms = F.transform(alternatives, lambda t: F.filter(F.transform(F.split(t, "&"), lambda p: F.trim(p)), lambda p: p != ""))
    rows = F.transform(F.regexp_extract_all(field("row"), F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))
    return {"terms": terms, "rows": rows, "sheet": field("sheet")}


def find_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(table, line) of rows (table, line, text) that a place (table, where) points at."""
    parsed = parse_where(F.col("where"))
    asked = places.select("table", parsed["terms"].alias("terms"), parsed["rows"].alias("wanted"))
    text = F.lower("text")
    hit = F.array_contains("wanted", F.col("line")) | F.exists("terms", lambda t: F.forall(t, lambda p: F.contains(text, p)))
    return rows.join(asked, "table").where(hit).select("table", "line").distinct()
