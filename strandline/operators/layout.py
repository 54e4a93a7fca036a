"""Organised copies: where each artifact's copy belongs, what state it is in, whether it matches its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import basename, glob_regex
from strandline.vocab import BIG_BYTES

P = "project_id"
NODE = ["project_id", "node_id"]


def folder_name(text: Column) -> Column:
    plain = F.regexp_replace(F.trim(text), r"(?U)[^\w\-]+", "_")
    short = F.left(F.regexp_replace(plain, "^_+|_+$", ""), F.lit(60))
    return F.when(short == "", "item").otherwise(short)


def layout_folder(nodes: DataFrame, steps: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(node_id, folder): numbered step folder, below it the sub-group. `steps` has step, ord, step_label."""
    rows = nodes.select(*NODE, "step", "grp").join(steps.select(P, "step", "ord", "step_label"), [P, "step"], "left")
    label = F.col("grp")
    if groups is not None:
        rows = rows.join(groups.select(P, "grp", "group_label"), [P, "grp"], "left")
        label = F.coalesce("group_label", "grp")
    number = F.coalesce("ord", F.lit(0)).cast("string")
    top = F.when(F.col("step_label").isNull(), "00_No_step").otherwise(
        F.concat(F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit("_"), folder_name(F.col("step_label"))))
    return rows.select(*NODE, F.when(F.col("grp").isNull(), top).otherwise(
        F.concat(top, F.lit("/"), folder_name(label))).alias("folder"))


def layout_name(nodes: DataFrame, folders: DataFrame, copies: DataFrame, folder_paths: DataFrame | None = None) -> DataFrame:
    """(node_id, folder, name): base name of the file, led by the id where another artifact claims the same place.

    `copies` (node_id, copy_path) are recorded copies; artifacts that are folders themselves (`folder_paths`) are
    named by id and label.
    """
    places = nodes.where("path IS NOT NULL").select(*NODE, "path", "label").join(folders, NODE).withColumn(
        "base", basename(F.col("path")))
    claims = places.select(P, "node_id", F.concat_ws("/", "folder", "base").alias("at")).unionByName(
        copies.select(P, "node_id", F.col("copy_path").alias("at")))
    contested = (claims.groupBy(P, "at").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
                 .where("a <> b").select(P, "at", F.lit(True).alias("contested")))
    rows = places.withColumn("at", F.concat_ws("/", "folder", "base")).join(contested, [P, "at"], "left")
    name = F.when(F.col("contested"), F.concat("node_id", F.lit("_"), "base")).otherwise(F.col("base"))
    if folder_paths is not None:
        rows = rows.join(folder_paths.select(P, "path", F.lit(True).alias("is_folder")).distinct(), [P, "path"], "left")
        name = F.when(F.col("is_folder"), F.concat("node_id", F.lit("_"), folder_name(F.col("label")))).otherwise(name)
    return rows.select(*NODE, "folder", name.alias("name"))


def layout_moves(folders: DataFrame, copies: DataFrame) -> DataFrame:
    """(node_id, old, new): recorded copies that no longer lie where step and group put them."""
    wanted = copies.select(*NODE, "copy_path", "name").join(folders, NODE).withColumn(
        "wanted", F.concat_ws("/", "folder", "name"))
    return wanted.where("wanted <> copy_path").select(*NODE, F.col("copy_path").alias("old"), F.col("wanted").alias("new"))


def copy_conflicts(copies: DataFrame) -> DataFrame:
    """(copy_path, claims): places recorded for several artifacts."""
    return (copies.groupBy(P, "copy_path").agg(F.count(F.lit(1)).alias("claims"), F.min("node_id").alias("a"),
                                              F.max("node_id").alias("b")).where("a <> b").drop("a", "b"))


def copy_state(copies: DataFrame, destination: DataFrame, sources: DataFrame) -> DataFrame:
    """(node_id, state): copy_missing, copy_conflict, source_missing, source_changed or ok, the first that holds.

    `copies` has copy_path, source, source_hash, size, source_mtime; listings have path (size, mtime, hash).
    """
    there = destination.select(P, F.col("path").alias("copy_path"), F.lit(True).alias("there")).distinct()
    contested = copy_conflicts(copies).select(P, "copy_path", F.lit(True).alias("contested"))
    now = sources.select(P, F.col("path").alias("source"), F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"),
                         F.col("hash").alias("hash_now"))
    rows = (copies.join(there, [P, "copy_path"], "left").join(contested, [P, "copy_path"], "left")
            .join(now, [P, "source"], "left"))
    same = (F.col("size_now").eqNullSafe(F.col("size")) & F.col("mtime_now").eqNullSafe(F.col("source_mtime"))) | \
        F.col("hash_now").eqNullSafe(F.col("source_hash"))
    state = (F.when(F.col("there").isNull(), "copy_missing").when(F.col("contested"), "copy_conflict")
             .when(F.col("size_now").isNull(), "source_missing").when(same, "ok").otherwise("source_changed"))
    return rows.select(*NODE, state.alias("state"))


def copy_check(sources: DataFrame, copies: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(owner, source_size, copy_size, source_files, copy_files, up_to_date) from two listings (owner, size)."""
    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(P, "owner").agg(F.sum("size").alias(f"{name}_size"), F.count(F.lit(1)).alias(f"{name}_files"))

    both = totals(sources, "source").join(totals(copies, "copy"), [P, "owner"], "full_outer")
    same = F.col("source_size").eqNullSafe(F.col("copy_size")) & F.col("source_files").eqNullSafe(F.col("copy_files"))
    if states is not None:
        both = both.join(states.select(P, "owner", "state"), [P, "owner"], "left")
        same = same & (F.col("state") == "ok")
    zero = F.lit(0).cast("long")
    return both.select(P, "owner", *[F.coalesce(c, zero).alias(c) for c in (
        "source_size", "copy_size", "source_files", "copy_files")], same.alias("up_to_date"))


def manifest_verify(manifest: DataFrame, copies: DataFrame) -> DataFrame:
    """(owner, name, verdict) for every manifest line: ok, bad (another content) or missing."""
    found = copies.select(P, "owner", "name", F.col("hash").alias("found"))
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("hash"), "ok").otherwise("bad")
    return manifest.join(found, [P, "owner", "name"], "left").select(P, "owner", "name", verdict.alias("verdict"))


def manifest_summary(verdicts: DataFrame) -> DataFrame:
    """(owner, checked, bad, missing, ok)."""
    counts = verdicts.groupBy(P, "owner").agg(
        F.count_if(F.col("verdict") != "missing").alias("checked"), F.count_if(F.col("verdict") == "bad").alias("bad"),
        F.count_if(F.col("verdict") == "missing").alias("missing"))
    return counts.withColumn("ok", (F.col("bad") == 0) & (F.col("missing") == 0))


def selected_files(files: DataFrame, entries: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files chosen by the entries, entries without a hit). An entry is a file, a folder or a glob; caches are left out.

    Files are tested against one list of patterns while they are read; only the hits per entry are counted.
    """
    def regex(entry: str) -> str:
        if any(c in entry for c in "*?["):
            # a glob names files at its own depth: `*` stays inside a folder
            return glob_regex([entry]).replace(".*", "[^/]*")
        return glob_regex([entry])[:-2].replace("^(?:", "^(?:", 1) + ")(?:/.*)?$"

    clean = files.where(~F.col("path").rlike(r"(^|/)__pycache__(/|$)") & ~F.endswith("path", F.lit(".pyc")))
    tests = F.array_compact(F.array(*[F.when(F.col("path").rlike(regex(e)), F.lit(i)) for i, e in enumerate(entries)]))
    marked = clean.withColumn("_entries", tests)
    chosen = marked.where(F.size("_entries") > 0).drop("_entries")
    hit = marked.select(F.explode("_entries").alias("i")).distinct()
    listed = files.sparkSession.createDataFrame(list(enumerate(entries)), "i int, entry string")
    return chosen, listed.join(hit, "i", "left_anti").select("entry")


def held_back(nodes: DataFrame, sizes: DataFrame, limit: int = BIG_BYTES) -> DataFrame:
    """(node_id, reason): artifacts a bulk copy leaves out. `sizes` has the newest version's size."""
    rows = nodes.join(sizes.select(*NODE, "size"), NODE, "left")
    reason = F.when(F.coalesce("organize_skip", F.lit(False)), "skipped").when(F.col("size") > limit, "large")
    return rows.select(*NODE, reason.alias("reason")).where("reason IS NOT NULL")


def relocated(table: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """`table` with (before, after) for paths at or below `old`; a sibling that only starts alike stays."""
    path = F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    base, target = old.replace("\\", "/").rstrip("/"), new.replace("\\", "/").rstrip("/")
    inside = (path == base) | F.startswith(path, F.lit(base + "/"))
    return table.where(inside).withColumn("before", F.col(column)).withColumn(
        "after", F.concat(F.lit(target), F.substr(path, F.lit(len(base) + 1))))


def job_progress(jobs: DataFrame) -> DataFrame:
    """Percent done, bytes per second and seconds left of copy jobs (started, heartbeat, bytes_done, bytes_total)."""
    elapsed = F.unix_timestamp("heartbeat") - F.unix_timestamp("started")
    rate = F.when((elapsed > 1) & (F.col("bytes_done") > 0), F.col("bytes_done") / elapsed).otherwise(F.lit(0.0))
    percent = F.when(F.col("bytes_total") > 0, F.least(F.lit(100.0), 100 * F.col("bytes_done") / F.col("bytes_total"))
                     ).otherwise(F.lit(0.0))
    left = F.when(F.col("rate") > 0, (F.col("bytes_total") - F.col("bytes_done")) / F.col("rate"))
    return jobs.withColumn("rate", rate).withColumn("percent", percent).withColumn("seconds_left", left)


def job_states(jobs: DataFrame, copies: DataFrame, now: Column, timeout: int = 60, keep: int = 3600) -> DataFrame:
    """(job_id, state) of the jobs still worth showing.

    A running job without a heartbeat for `timeout` seconds was interrupted; a failed copy is forgotten once the
    artifact was copied later; finished jobs are shown for `keep` seconds.
    """
    silent = F.unix_timestamp(now) - F.unix_timestamp("heartbeat")
    running = F.col("state").isin("queued", "running", "copying", "checking")
    rows = jobs.withColumn("state", F.when(running & (silent > timeout), "interrupted").otherwise(F.col("state")))
    rows = rows.join(copies.select(*NODE, F.col("copied")), NODE, "left")
    replaced = (F.col("state").isin("interrupted", "error") & (F.col("kind") == "copy")
                & F.coalesce(F.col("copied") > F.col("created"), F.lit(False)))
    over = ~running & ~F.col("state").isin("interrupted") & (silent > keep)
    return rows.where(~replaced & ~over).select(P, "job_id", "node_id", "state")
