"""Revisions, proposals and builds of articles as tables.

Tables that have project_id and article are matched within them (`scope`); tables without are those of one article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import scope
from strandline.plans import cut
from strandline.vocab import KEPT_SNAPSHOTS, REVIEW_PART_BY_FILE

# How text falls into words, and below which share of kept words a change is a rewrite.
TOKEN = r"(?U)\d+(?:[.,]\d+)*|\w+|[^\w\s]"
REWRITE_BELOW = 0.45
ERROR_LINE = r"(?m)^(?:\./)?([^\s:][^:\n]*\.(?:tex|sty|cls|bib)):(\d+): (.+)$"
BARE_ERROR = r"(?m)^! (.+)$"
WARNING = r"(?ms)^(?:LaTeX|Package \w+) Warning: (.+?)(?:\n\n|\.$)"
# End of the fixed values.

EDITS_PER_ROUND = 256


def change_profile(pairs: DataFrame, words: Column | None = None) -> DataFrame:
    """(id, removed, added, kept, rewrite) per pair of texts (id, before, after).

    Words are compared as counted sets: one pass, one row per text and word. A word that moved counts as kept.
    """
    def split(column: str) -> Column:
        return F.regexp_extract_all(column, F.lit(TOKEN), 0) if words is None else F.filter(
            F.split(column, words), lambda w: w != "")

    sides = F.concat(F.transform(split("before"), lambda w: F.struct(w.alias("word"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
                     F.transform(split("after"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    counts = pairs.select("id", F.inline_outer(sides)).groupBy("id", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    zero = F.lit(0).cast("long")
    out = counts.groupBy("id").agg(
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), zero)), zero).alias("removed"),
        F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), zero)), zero).alias("added"),
        F.coalesce(F.sum(F.least("a", "b")), zero).alias("kept"))
    total = 2 * F.col("kept") + F.col("removed") + F.col("added")
    both = (F.col("kept") + F.col("removed") > 0) & (F.col("kept") + F.col("added") > 0)
    return out.withColumn("rewrite", both & (2 * F.col("kept") < REWRITE_BELOW * total))


def words_changed(revisions: DataFrame) -> DataFrame:
    """(r_id, words_changed): the larger of words removed and words added."""
    key = scope(revisions)
    if key:
        pairs = revisions.select(F.struct(*key, "r_id").alias("id"), F.coalesce("before", F.lit("")).alias("before"),
                                 F.coalesce("reviewer_text", F.lit("")).alias("after"))
        return change_profile(pairs, F.lit(r"(?U)\s+")).select("id.*", F.greatest("removed", "added").alias("words_changed"))
    pairs = revisions.select(F.col("r_id").alias("id"), F.coalesce("before", F.lit("")).alias("before"),
                             F.coalesce("reviewer_text", F.lit("")).alias("after"))
    return change_profile(pairs, F.lit(r"(?U)\s+")).select(F.col("id").alias("r_id"),
                                                         F.greatest("removed", "added").alias("words_changed"))


def proposal_status(hunks: DataFrame) -> DataFrame:
    """(proposal, status, conflicts): from the decisions on its pieces."""
    def every(state: str) -> Column:
        return F.bool_and(F.col("state") == state)

    status = (F.when(F.bool_or(F.col("state") == "open"), "open").when(every("accepted"), "accepted")
              .when(every("rejected"), "rejected").otherwise("resolved"))
    return hunks.groupBy(*scope(hunks), "proposal").agg(status.alias("status"), F.count_if(F.col("state") == "conflict").alias("conflicts"))


def revision_status(revisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """(r_id, status): live status from the proposals that carry a change; otherwise as recorded."""
    key = scope(revisions, proposals)
    named = revisions.select(*key, "r_id", F.explode(F.split(F.coalesce("proposal", F.lit("")), ",")).alias("p")).select(
        *key, "r_id", F.trim("p").alias("proposal")).where("proposal <> ''")
    live = named.join(proposals.select(*key, "proposal", F.col("status").alias("live")), [*key, "proposal"], "left").groupBy(*key, "r_id").agg(
        F.bool_and(F.coalesce(F.col("live") == "accepted", F.lit(False))).alias("all_accepted"),
        F.bool_and(F.coalesce(F.col("live").isin("rejected", "withdrawn"), F.lit(False))).alias("all_rejected"))
    movable = F.col("status").isin("proposed", "accepted", "rejected")
    status = (F.when(movable & F.col("all_accepted"), "accepted").when(movable & F.col("all_rejected"), "rejected")
              .otherwise(F.col("status")))
    return revisions.select(*key, "r_id", "status").join(live, [*key, "r_id"], "left").select(*key, "r_id", status.alias("status"))


def review_part(file: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, part in REVIEW_PART_BY_FILE.items():
        out = out.when(file == name, part)
    return out.otherwise("Other")


def revision_by_reviewer(revisions: DataFrame, changed: DataFrame) -> DataFrame:
    """(reviewer, round, decision, changes, words)."""
    return (revisions.join(changed, [*scope(revisions, changed), "r_id"], "left")
            .groupBy(*scope(revisions), "reviewer", "round", F.coalesce("decision", F.lit("pending")).alias("decision"))
            .agg(F.count(F.lit(1)).alias("changes"), F.sum(F.coalesce("words_changed", F.lit(0))).alias("words")))


def revision_by_part(revisions: DataFrame, changed: DataFrame, decisions: list[str]) -> DataFrame:
    """(part, changes, words, and the words of each decision)."""
    rows = revisions.join(changed, [*scope(revisions, changed), "r_id"], "left").withColumn("part", review_part(F.col("file")))
    n = F.coalesce("words_changed", F.lit(0))
    per_decision = [F.coalesce(F.sum(F.when(F.col("decision") == d, n)), F.lit(0)).alias(d.replace(" ", "_")) for d in decisions]
    return rows.groupBy(*scope(revisions), "part").agg(F.count(F.lit(1)).alias("changes"), F.sum(n).alias("words"), *per_decision)


def open_questions(revisions: DataFrame) -> DataFrame:
    return revisions.where((F.col("status") == "open question") | F.col("decision").isin("partly applied", "needs author"))


def occurrences(text: Column, find: Column) -> Column:
    """How often a text occurs, not overlapping."""
    return F.when(F.length(find) > 0, ((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)).cast("int")
                  ).otherwise(0)


def edit_checks(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, n, hits, problem): can each edit be placed in the current text? One hit, or the number of one."""
    key = [*scope(files, edits), "file"]
    rows = edits.join(files.select(*key, "text"), key, "left")
    hits = F.coalesce(occurrences(F.col("text"), F.col("find")), F.lit(0))
    problem = (F.when(F.col("text").isNull(), "no such file").when(F.col("nth") < 1, "no such occurrence")
               .when(F.col("hits") == 0, "not found")
               .when((F.col("hits") > 1) & F.col("nth").isNull(), "ambiguous")
               .when(F.col("nth") > F.col("hits"), "no such occurrence"))
    return rows.withColumn("hits", hits).select(*key, "n", "hits", problem.alias("problem"))


def apply_edits(files: DataFrame, edits: DataFrame, per_round: int = EDITS_PER_ROUND) -> DataFrame:
    """(file, text, failed, problem): texts after their edits, in order; a file with a failing edit keeps its text.

    Edits are (file, n, find, replace, nth) with n = 1, 2, 3, ... per file. Each edit sees the result of those
    before it, so a file's edits meet its text; they do so `per_round` at a time, whatever their number. Files without
    edits are not moved. Occurrences are counted from 1 and do not overlap; a smaller `nth` is refused.
    """
    key = [*scope(files, edits), "file"]
    asked = edits.select(*key).distinct()
    state, _ = cut(files.join(asked, key, "left_semi").select(
        *key, F.col("text").alias("was"), "text", F.lit(None).cast("int").alias("failed"),
        F.lit(None).cast("string").alias("problem")), "edits")
    rounds = edits.agg(F.max("n")).first()[0] or 0
    step = F.struct(F.col("n").cast("int").alias("n"), "find", F.coalesce("replace", F.lit("")).alias("replace"),
                    F.col("nth").cast("int").alias("nth"))
    for first in range(1, rounds + 1, per_round):
        batch = edits.where(F.col("n").between(first, first + per_round - 1)).groupBy(*key).agg(
            F.array_sort(F.collect_list(step)).alias("steps"))

        def one(acc: Column, e: Column) -> Column:
            text, find = acc["text"], e["find"]
            hits = occurrences(text, find)
            nth = F.coalesce(e["nth"], F.lit(1))
            problem = (F.when(nth < 1, "no such occurrence").when(hits == 0, "not found").when((hits > 1) & e["nth"].isNull(), "ambiguous")
                       .when(nth > hits, "no such occurrence"))
            before = F.call_function("substring_index", text, find, nth)
            changed = F.concat(before, e["replace"], F.substr(text, F.length(before) + F.length(find) + 1))
            fine = acc["problem"].isNull() & problem.isNull()
            return F.struct(F.when(fine, changed).otherwise(text).alias("text"),
                            F.when(acc["problem"].isNull() & problem.isNotNull(), e["n"]).otherwise(acc["failed"]).alias("failed"),
                            F.coalesce(acc["problem"], problem).alias("problem"))

        folded = F.reduce(F.coalesce("steps", F.array().cast("array<struct<n:int,find:string,replace:string,nth:int>>")),
                          F.struct("text", "failed", "problem"), one)
        state, _ = cut(state.join(batch, key, "left").select(*key, "was", folded.alias("s")).select(
            *key, "was", "s.text", "s.failed", "s.problem"), "edits")
    done = state.select(*key, F.when(F.col("problem").isNull(), F.col("text")).otherwise(F.col("was")).alias("text"),
                        "failed", "problem")
    return done.unionByName(files.join(asked, key, "left_anti").select(
        *key, "text", F.lit(None).cast("int").alias("failed"), F.lit(None).cast("string").alias("problem")))


def stale_writes(writes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, writer, refused): a write is refused when the file changed since the writer read it (base_hash)."""
    key = [*scope(writes, files), "file"]
    now = files.select(*key, F.col("hash").alias("_now"))
    refused = F.coalesce(F.col("_now") != F.col("base_hash"), F.lit(False))
    return writes.join(now, key, "left").select(*key, "writer", refused.alias("refused"))


def log_errors(logs: DataFrame) -> DataFrame:
    """(log, file, line, message) of build errors, each once; bare `!` messages where no file is named."""
    located = ERROR_LINE
    named = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(located), i).alias(c) for i, c in enumerate(("file", "line", "message"), 1)])
    errors = logs.select("log", F.explode(named).alias("e")).select(
        "log", F.replace(F.col("e.file"), F.lit("\\"), F.lit("/")).alias("file"), F.col("e.line").cast("int").alias("line"),
        F.trim("e.message").alias("message")).distinct()
    bare = BARE_ERROR
    messages = F.regexp_extract_all("text", F.lit(bare), 1)
    after = F.slice(F.split("text", bare, -1), F.lit(2), F.size(messages))
    pairs = F.zip_with(messages, after, lambda message, rest: F.struct(
        message.alias("message"), F.regexp_extract(rest, r"(?m)^l\.(\d+)", 1).alias("line")))
    plain = (logs.where(F.size(F.regexp_extract_all("text", F.lit(located), 1)) == 0).select("log", F.explode(pairs).alias("e"))
             .select("log", F.lit(None).cast("string").alias("file"), F.col("e.line").try_cast("int").alias("line"),
                     F.trim("e.message").alias("message")))
    return errors.unionByName(plain)


def log_warnings(logs: DataFrame) -> DataFrame:
    """(log, pos, message) of build warnings, white space folded."""
    found = F.regexp_extract_all("text", F.lit(WARNING), 1)
    return logs.select("log", F.posexplode(found).alias("pos", "message")).withColumn(
        "message", F.trim(F.regexp_replace("message", r"\s+", " ")))


def stale_products(products: DataFrame, sources: DataFrame, tolerance: int = 1) -> DataFrame:
    """(article, stale): is any source more than a second newer than the product?"""
    key = sorted({*scope(products, sources), "article"}, reverse=True)
    newest = sources.groupBy(*key).agg(F.max("mtime").alias("newest"))
    return products.join(newest, key, "left").select(
        *key, F.coalesce(F.col("newest") > F.col("mtime") + tolerance, F.lit(False)).alias("stale"))


def assets_to_sync(assets: DataFrame, present: DataFrame, synced: DataFrame) -> DataFrame:
    """(key, action): unsafe, missing, copy or same, from the files present and the hash at the last sync."""
    from strandline.functions.markup import SAFE_KEY, SAFE_PATH
    key = scope(assets, present, synced)
    src = present.select(*key, F.col("path").alias("source"), F.col("hash").alias("src_hash"))
    dst = present.select(*key, F.col("path").alias("file"), F.col("hash").alias("dst_hash"))
    old = synced.select(*key, "file", F.col("hash").alias("old_hash"))
    rows = assets.join(src, [*key, "source"], "left").join(dst, [*key, "file"], "left").join(old, [*key, "file"], "left")
    unsafe = ~F.col("key").rlike(SAFE_KEY) | ~F.col("file").rlike(SAFE_PATH) | F.col("file").rlike(r"(^|/)\.\.(/|$)")
    alone = F.coalesce("source", F.lit("")) == ""
    missing = (alone & F.col("dst_hash").isNull()) | (~alone & F.col("src_hash").isNull())
    same = alone | (F.col("dst_hash").eqNullSafe(F.col("src_hash")) & F.col("old_hash").eqNullSafe(F.col("src_hash")))
    return rows.select(*key, "key", F.when(unsafe, "unsafe").when(missing, "missing").when(same, "same").otherwise("copy").alias("action"))


def snapshot_retention(snapshots: DataFrame, keep: int = KEPT_SNAPSHOTS) -> DataFrame:
    """The newest `keep` snapshots per file; each task keeps at most that many per file before the shuffle."""
    newest = Window.partitionBy("file").orderBy(F.col("ts").desc(), F.col("seq").desc())
    return snapshots.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep).drop("_rank")
