"""The catalog as versioned snapshots: a load writes whole new tables and becomes visible at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import validate
from strandline.operators.graph import branch_family
from strandline.operators.history import history, recent_updates
from strandline.operators.layout import copy_state, layout_folder
from strandline.operators.staleness import Staleness, disk_state, node_state
from strandline.operators.summary import category, group_members, step_flows, step_members
from strandline.operators.trees import analysis_numbers, hidden_analyses, hidden_nodes
from strandline.plans import cut, path_exists


def current_snapshot(spark: SparkSession, root: str) -> int:
    """Number of the newest complete snapshot, 0 if there is none."""
    if not path_exists(spark, f"{root}/committed"):
        return 0
    done = spark.read.schema("snapshot INT, tables STRING").parquet(f"{root}/committed")
    return done.agg(F.max("snapshot")).first()[0] or 0


def write_snapshot(tables: dict[str, DataFrame], root: str) -> int:
    """Write all tables under a new number; the commit record comes last, so readers see all of it or nothing.

    A number that another load has begun to use is passed over; should two begin at once, the writer of the second fails.
    """
    spark = next(iter(tables.values())).sparkSession
    n = current_snapshot(spark, root) + 1
    while path_exists(spark, f"{root}/snapshot-{n:06d}"):
        n += 1
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{root}/snapshot-{n:06d}/{name}")
    record = spark.range(1).select(F.lit(n).alias("snapshot"), F.lit(",".join(tables)).alias("tables"))
    record.coalesce(1).write.mode("append").parquet(f"{root}/committed")
    return n


def read_snapshot(spark: SparkSession, root: str, n: int | None = None) -> dict[str, DataFrame]:
    n = n or current_snapshot(spark, root)
    row = spark.read.schema("snapshot INT, tables STRING").parquet(f"{root}/committed").where(F.col("snapshot") == n).first()
    return {name: spark.read.parquet(f"{root}/snapshot-{n:06d}/{name}") for name in row["tables"].split(",")}


# sections of a batch besides nodes and edges, and the column of each that names an artifact
SECTIONS = {"notes": "node", "groups": "node", "final": "node", "saves": "node"}


def load_batch(batch: dict[str, DataFrame], catalog: dict[str, DataFrame], root: str) -> tuple[DataFrame, int | None]:
    """Check a batch and, without errors, write the next snapshot: (findings, snapshot number or None).

    Nothing of a refused or failed load becomes visible. Nodes get their ids first, everything else follows the keys.
    `steps` replace steps of the same name; `notes` (node, text) and `groups` (name, node) are added; a save (node) raises
    the version; `final` (node, version) marks a version, the newest one if it names none. Branches are made by
    `derive_branch` and refused here.
    """
    if "branches" in batch and batch["branches"].limit(1).count():
        raise ValueError("load_batch: make branches with derive_branch")
    findings = validate.check_batch(batch, catalog)
    if findings.where(F.col("severity") == validate.ERROR).limit(1).count():
        return findings, None
    nodes = batch["nodes"]
    ids, _ = cut(validate.next_ids(nodes, catalog["nodes"], F.expr("seq div 100000")), "ids")
    by_key = ids.select("project_id", "batch_id", "key", F.col("node_id").alias("_id"))

    def resolved(df: DataFrame, column: str) -> DataFrame:
        return df.join(by_key.withColumnRenamed("key", column), ["project_id", "batch_id", column], "left").withColumn(
            column, F.coalesce("_id", column)).drop("_id")

    def like(table: DataFrame, rows: DataFrame) -> DataFrame:
        """`rows` with the columns of a table; those they lack are null."""
        return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c)
                             for c in table.columns])

    links = batch["edges"]
    if "script" not in links.columns:
        links = links.withColumn("script", F.lit(None).cast("string"))
    for column in ("src", "dst", "script"):
        links = resolved(links, column)
    implied = validate.implied_code_edges(links, catalog["edges"]).select(
        "project_id", F.col("script").alias("source"), F.col("dst").alias("target"), F.lit("code").alias("rel"),
        F.create_map().cast("map<string,string>").alias("params"))
    named = links.withColumnsRenamed({"src": "source", "dst": "target"})
    fresh = validate.merged_links(named).unionByName(implied, allowMissingColumns=True)
    fresh = fresh.withColumn("edge_id", F.concat("source", F.lit(">"), "target", F.lit(":"), "rel"))
    tables = dict(catalog)
    tables["nodes"] = catalog["nodes"].unionByName(like(catalog["nodes"], nodes.join(ids, ["project_id", "batch_id", "key"])))
    tables["edges"] = validate.upsert_edges(catalog["edges"], fresh)
    rows = {name: resolved(batch[name], column).withColumnRenamed(column, "node_id")
            for name, column in SECTIONS.items() if name in batch}
    tables["nodes"] = _versions_set(tables["nodes"], rows.get("saves"), rows.get("final"))
    if "steps" in batch:
        new = batch["steps"].dropDuplicates(["project_id", "step"])
        old = catalog.get("steps", new.drop("batch_id").limit(0))
        tables["steps"] = old.join(new, ["project_id", "step"], "left_anti").select(*old.columns).unionByName(like(old, new))
    for name in ("notes", "groups"):
        if name in rows:
            new = rows[name].drop("batch_id", "n")
            old = catalog.get(name, new.limit(0))
            both = old.unionByName(like(old, new))
            tables[name] = both.distinct() if name == "groups" else both
    return findings, write_snapshot(tables, root)


def _versions_set(nodes: DataFrame, saves: DataFrame | None, final: DataFrame | None) -> DataFrame:
    """`nodes` after the saves and the marks of final versions."""
    key, names = ["project_id", "node_id"], nodes.columns
    if saves is not None:
        times = saves.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("_saves"))
        nodes = nodes.join(times, key, "left").withColumn("current_version", F.when(
            F.col("_saves").isNotNull(), F.coalesce("current_version", F.lit(0)) + F.col("_saves")).otherwise(F.col("current_version"))
        ).select(*names)
    if final is not None:
        marks = final.groupBy(*key).agg(F.max("version").alias("_final"), F.lit(True).alias("_marked"))
        nodes = nodes.join(marks, key, "left").withColumn(
            "final_version", F.when(F.col("_marked"), F.coalesce("_final", "current_version")).otherwise(F.col("final_version"))
        ).select(*names)
    return nodes


def catalog_snapshot(nodes: DataFrame, edges: DataFrame, recorded: DataFrame, versions: DataFrame, disk: DataFrame,
                     analyses: DataFrame, listed: DataFrame, events: DataFrame, last_events: int = 2000, copies: DataFrame | None = None,
                     destination: DataFrame | None = None, steps: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything a viewer shows: nodes with state and hiding reason, links with their stale flag, the newest events, the analyses and,
    with recorded `copies`, a listing of the `destination` and the `steps`, each organized copy with its state and folder."""
    verdict = Staleness(nodes, edges, recorded)
    states = node_state(nodes, verdict.stale_nodes(), disk_state(versions, disk))
    hidden = hidden_nodes(nodes, edges, analyses, listed).withColumnRenamed("reason", "hidden_because")
    key = ["project_id", "node_id"]
    stale = verdict.stale_links().select("project_id", "edge_id", F.lit(True).alias("stale")).distinct()
    out = {"nodes": nodes.join(states, key).join(hidden, key, "left"),
           "edges": edges.join(stale, ["project_id", "edge_id"], "left").withColumn("stale", F.coalesce("stale", F.lit(False))),
           "reasons": verdict.reasons(), "events": history(events, limit=last_events), "analyses": analyses}
    if copies is not None:
        out["organized"] = organized_copies(nodes, copies, destination, disk, steps)
    return out


def organized_copies(nodes: DataFrame, copies: DataFrame, destination: DataFrame, sources: DataFrame, steps: DataFrame) -> DataFrame:
    """(node_id, copy_path, state, folder): recorded copies with their state and the folder that step and group give them."""
    key = ["project_id", "node_id"]
    return (copies.select(*key, "copy_path").join(copy_state(copies, destination, sources), key)
            .join(layout_folder(nodes, steps), key, "left").select(*key, "copy_path", "state", "folder"))


def catalog_sections(nodes: DataFrame, edges: DataFrame, recorded: DataFrame, analyses: DataFrame, branches: DataFrame, groups: DataFrame,
                     versions: DataFrame) -> dict[str, DataFrame]:
    """The data of the written report, a table per section.

    stale (with reasons), steps and flows, analyses with number and hiding, artifacts with their category, links with what they carry and whether they
    are stale, members of branch families, the last updates that say why, members of groups.
    """
    verdict = Staleness(nodes, edges, recorded)
    out_of_view = hidden_analyses(analyses).withColumn("out_of_view", F.lit(True))
    stale = verdict.stale_links().select("project_id", "edge_id", F.lit(True).alias("stale")).distinct()
    families = branch_family(branches.select("project_id", "node_id", "of"))
    return {
        "stale": verdict.reasons(), "steps": step_members(nodes), "flows": step_flows(nodes, edges),
        "analyses": analysis_numbers(analyses).join(analyses.select("project_id", "key", "title"), ["project_id", "key"])
        .join(out_of_view, ["project_id", "key"], "left").withColumn("out_of_view", F.coalesce("out_of_view", F.lit(False))),
        "tables": nodes.withColumn("category", category(F.col("type"))),
        "links": edges.withColumn("with_params", F.coalesce(F.size("params") > 0, F.lit(False))).join(stale, ["project_id", "edge_id"], "left")
        .withColumn("stale", F.coalesce("stale", F.lit(False))),
        "branches": families.join(branches, ["project_id", "node_id"]),
        "recent": recent_updates(versions), "groups": group_members(nodes, groups)}
