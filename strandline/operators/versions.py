"""Version histories: numbering, change records, final versions, placements, branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.words import natural_key
from strandline.operators.graph import branch_family, is_process
from strandline.plans import number_changes
from strandline.vocab import MAX_SNAPSHOT_BYTES, PARAM_RELS, SOFT_RELS

NODE = ["project_id", "node_id"]


def assign_versions(snapshots: DataFrame, slice_by: Column) -> DataFrame:
    """Snapshots (node_id, ts, seq, hash, ...) whose content differs from the one before, numbered as `v`.

    Content that returns after another one is a new version. `slice_by` is a period of ts: an artifact
    with most of the snapshots is spread over its periods instead of meeting in one task.
    """
    numbered = number_changes(snapshots, NODE, slice_by, [F.col("ts"), F.col("seq")], F.col("hash"), "v")
    return numbered.withColumn("v", F.col("v").cast("int"))


def with_version_before(versions: DataFrame, columns: list[str]) -> DataFrame:
    """Each version beside the one before it: version numbers have no holes, so this is an equi-join."""
    before = versions.select(*NODE, (F.col("v") + 1).cast("int").alias("v"),
                             *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("has_before"))
    return versions.join(before, [*NODE, "v"], "left")


def version_changes(versions: DataFrame, parents: DataFrame, params: DataFrame, nodes: DataFrame) -> DataFrame:
    """What differs between each version and the one before: (node_id, v, kind, subject, key, before, after).

    `parents` has node_id, v, parent_id, version; `params` has node_id, v, edge_id, key, value. Inputs can be
    added, moved or dropped; parameters are compared on links the new version has; the size may differ.
    """
    text = "string"
    at = [*NODE, "v"]
    later = versions.where("v > 1").select(*at)
    kinds = nodes.select("project_id", F.col("node_id").alias("parent_id"), is_process("type").alias("process"))
    new = parents.join(later, at, "left_semi").select(*at, "parent_id", F.struct("version").alias("new"))
    old = (parents.select(*NODE, (F.col("v") + 1).cast("int").alias("v"), "parent_id", F.struct("version").alias("old"))
           .join(later, at, "left_semi"))
    role = F.when(F.coalesce("process", F.lit(False)), F.lit("script")).otherwise(F.lit("input"))
    kind = (F.when(F.col("new").isNull(), F.lit("dropped_input"))
            .when(F.col("old").isNull(), F.concat(F.lit("added_"), role)).otherwise(role))
    inputs = (new.join(old, [*at, "parent_id"], "full_outer")
              .where("new IS NULL OR old IS NULL OR NOT (new.version <=> old.version)")
              .join(kinds, ["project_id", "parent_id"], "left")
              .select(*at, kind.alias("kind"), F.col("parent_id").alias("subject"), F.lit(None).cast(text).alias("key"),
                      F.col("old.version").cast(text).alias("before"), F.col("new.version").cast(text).alias("after")))
    links = params.join(later, at, "left_semi").select(*at, "edge_id").distinct()
    p_new = params.join(later, at, "left_semi").select(*at, "edge_id", "key", F.col("value").alias("new"))
    p_old = (params.select(*NODE, (F.col("v") + 1).cast("int").alias("v"), "edge_id", "key", F.col("value").alias("old"))
             .join(links, [*at, "edge_id"], "left_semi"))
    settings = (p_new.join(p_old, [*at, "edge_id", "key"], "full_outer").where("NOT (new <=> old)")
                .select(*at, F.lit("param").alias("kind"), F.col("edge_id").alias("subject"), "key",
                        F.col("old").alias("before"), F.col("new").alias("after")))
    sizes = (with_version_before(versions.select(*at, "size"), ["size"]).where("has_before AND old_size IS NOT NULL")
             .where("NOT (size <=> old_size)")
             .select(*at, F.lit("content").alias("kind"), F.lit(None).cast(text).alias("subject"),
                     F.lit(None).cast(text).alias("key"), F.col("old_size").cast(text).alias("before"),
                     F.col("size").cast(text).alias("after")))
    return inputs.unionByName(settings).unionByName(sizes)


def edge_param_changes(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Parameters each edit really changes: (edge_id, key, before, after, why); edits carry a `params` map."""
    new = edits.select("project_id", "edge_id", "why", F.explode("params").alias("key", "after"))
    old = edges.select("project_id", "edge_id", "params")
    return (new.join(old, ["project_id", "edge_id"]).withColumn("before", F.try_element_at("params", "key"))
            .where("NOT (before <=> after)").select("project_id", "edge_id", "key", "before", "after", "why"))


def merged_params(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Links after the edits: edited values win, other parameters stay. One edit per link."""
    new = edits.select("project_id", "edge_id", F.col("params").alias("_new"))
    kept = F.map_filter("params", lambda k, _: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    merged = F.when(F.col("_new").isNull(), F.col("params")).otherwise(F.map_concat(kept, "_new"))
    return edges.join(new, ["project_id", "edge_id"], "left").withColumn("params", merged).drop("_new")


def effective_version(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """(node_id, effective, valid): the final version, else the current one; valid when that version exists."""
    wanted = nodes.select(*NODE, F.coalesce("final_version", "current_version").alias("v"))
    exists = versions.select(*NODE, "v", F.lit(True).alias("valid")).distinct()
    return (wanted.join(exists, [*NODE, "v"], "left")
            .select(*NODE, F.col("v").alias("effective"), F.coalesce("valid", F.lit(False)).alias("valid")))


def restorable(requests: DataFrame, versions: DataFrame, unsaved: DataFrame | None = None) -> DataFrame:
    """Can a version's content be brought back? (node_id, v, hash, problem); problem is null when it can.

    Stored are managed plain files with an exact hash up to the snapshot limit.
    """
    stored = ((F.col("mode") == "managed") & (F.col("kind") == "file") & F.col("exact")
              & (F.col("size") <= MAX_SNAPSHOT_BYTES))
    known = versions.select(*NODE, "v", "hash", stored.alias("stored"))
    found = requests.select(*NODE, "v").join(known, [*NODE, "v"], "left")
    if unsaved is not None:
        found = found.join(unsaved.select(*NODE, F.lit(True).alias("dirty")).distinct(), NODE, "left")
    else:
        found = found.withColumn("dirty", F.lit(None).cast("boolean"))
    problem = (F.when(F.col("hash").isNull(), "no such version").when(~F.col("stored"), "not stored")
               .when(F.col("dirty"), "unsaved changes"))
    return found.select(*NODE, "v", "hash", problem.alias("problem"))


def update_timeline(versions: DataFrame, param_edits: DataFrame, edges: DataFrame) -> DataFrame:
    """Versions of an artifact and parameter edits on its incoming links: (node_id, ts, kind, detail, why, unexplained)."""
    quiet = F.col("v").cast("int") > 1
    if "actor" in versions.columns:
        quiet = quiet & (F.col("actor") != "import")
    saved = versions.select(*NODE, "ts", F.lit("version").alias("kind"), F.concat(F.lit("v"), "v").alias("detail"), "why",
                            (quiet & (F.coalesce("why", F.lit("")) == "")).alias("unexplained"))
    into = edges.select("project_id", "edge_id", F.col("target").alias("node_id"))
    tuned = param_edits.join(into, ["project_id", "edge_id"]).select(
        *NODE, "ts", F.lit("parameters").alias("kind"), F.concat("edge_id", F.lit(" "), "key").alias("detail"), "why",
        F.lit(False).alias("unexplained"))
    return saved.unionByName(tuned)


def latest_versions(versions: DataFrame, k: int = 8) -> DataFrame:
    """The newest k versions per artifact; each task keeps at most k per artifact before the shuffle."""
    newest = Window.partitionBy(*NODE).orderBy(F.col("v").desc())
    return versions.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= k).drop("_rank")


def derive_branch(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Links of new alternatives: the original's hard links with changed parameters, plus a variant link.

    `requests` has node_id (the original), new_id, params and why. Changes go to links that already carry one of
    the keys, else to the first produces or derives link by id.
    """
    hard = edges.where(~F.col("rel").isin([*SOFT_RELS, "part_of"])).select(
        "project_id", F.col("target").alias("node_id"), "edge_id", "source", "rel", F.col("params").alias("old"))
    pairs = hard.join(requests.select(*NODE, "new_id", "params"), NODE)
    carries = F.arrays_overlap(F.map_keys("params"), F.map_keys("old"))
    pairs = pairs.withColumn("carries", carries)
    per_branch = pairs.groupBy("project_id", "new_id").agg(
        F.bool_or("carries").alias("any_carries"),
        F.min_by("edge_id", F.when(F.col("rel").isin(PARAM_RELS), natural_key(F.col("edge_id")))).alias("first_link"))
    changed = F.col("carries") | (~F.col("any_carries") & F.col("edge_id").eqNullSafe(F.col("first_link")))
    kept = F.map_filter("old", lambda k, _: ~F.map_contains_key("params", k))
    params = F.when(F.col("rel") == "code", F.create_map().cast("map<string,string>")).when(
        changed, F.map_concat(kept, "params")).otherwise(F.col("old"))
    copies = pairs.join(per_branch, ["project_id", "new_id"]).select(
        "project_id", "source", F.col("new_id").alias("target"), "rel", params.alias("params"))
    # a code link is copied once per script
    code = copies.where("rel = 'code'").dropDuplicates(["project_id", "source", "target"])
    variants = requests.select("project_id", F.col("node_id").alias("source"), F.col("new_id").alias("target"),
                               F.lit("variant").alias("rel"), F.create_map().cast("map<string,string>").alias("params"))
    return copies.where("rel <> 'code'").unionByName(code).unionByName(variants)


def branch_main(branches: DataFrame) -> DataFrame:
    """(node_id, root, status): one main per family, the one declared main last; other mains are alternatives."""
    family = branch_family(branches.select(*NODE, "of"))
    members = branches.select(*NODE, "status", "decided").join(family, NODE)
    chosen = members.where("status = 'main'").groupBy("project_id", "root").agg(
        F.max_by("node_id", F.struct("decided", "node_id")).alias("main"))
    status = F.when((F.col("status") == "main") & (F.col("node_id") != F.col("main")), F.lit("alternative")).otherwise(
        F.col("status"))
    return members.join(chosen, ["project_id", "root"], "left").select(*NODE, "root", status.alias("status"))


def placement_refresh(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placements that show another version than the component's final (else current) one."""
    wanted = nodes.select("project_id", F.col("node_id").alias("source"),
                          F.coalesce("final_version", "current_version").alias("wanted"))
    return (edges.where("rel = 'part_of'").join(wanted, ["project_id", "source"])
            .where("NOT (wanted <=> placed_version)")
            .select("project_id", "edge_id", "source", "target", "label", "placed_version", "wanted"))


def backfill_versions(history: DataFrame, current: DataFrame, slice_by: Column) -> DataFrame:
    """Older copies become the versions before the current one; equal neighbours are kept once.

    The order is the order of import (`seq`); dates are data.
    """
    both = history.withColumn("_last", F.lit(0)).unionByName(current.withColumn("_last", F.lit(1)))
    order = [F.col("_last"), F.col("seq")]
    by = F.struct(F.col("_last"), slice_by.alias("slice"))
    numbered = number_changes(both, NODE, by, order, F.col("hash"), "v")
    return numbered.drop("_last").withColumn("v", F.col("v").cast("int"))


def cosmetic_parents(versions: DataFrame, parents: DataFrame) -> DataFrame:
    """Recorded inputs of the newest version: a cosmetic save keeps those of the last real save before it."""
    real = versions.where("NOT cosmetic OR v = 1").groupBy(*NODE).agg(F.max("v").alias("v"))
    return parents.join(real, [*NODE, "v"], "left_semi").drop("v")
