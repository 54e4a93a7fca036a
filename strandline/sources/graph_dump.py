"""Whole-project JSON documents as normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.words import canonical_variant
from strandline.schemas import GRAPH

P = "project_id"


def canonical_params(params: Column) -> Column:
    """Parameter values as canonical JSON text, so that 1 and 1.0 compare equal and "1" does not."""
    return F.coalesce(F.transform_values(params, lambda _, v: canonical_variant(v)), F.create_map().cast("map<string,string>"))


def read_graph_dumps(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """One JSON document per project (missing sections count as empty) -> {table name: DataFrame}.

    The project id is the name of the folder above the document's state folder.
    """
    docs = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    docs = docs.withColumn(P, F.element_at(parts, -3))
    nodes = docs.select(P, F.explode("nodes").alias("node_id", "n"))
    edges = docs.select(P, F.explode("edges").alias("e"))
    analyses = docs.select(P, F.explode("analyses").alias("key", "a"))
    versions = nodes.select(P, "node_id", F.explode("n.versions").alias("w"))
    time = lambda c: F.col(c).try_cast("timestamp")
    tables = {
        "project": docs.select(P, "project.*"),
        "node": nodes.select(P, "node_id", *[F.col(f"n.{c}").alias(c) for c in (
            "type", "label", "path", "mode", "description", "step", "current_version", "final_version", "hidden",
            "organize_skip", "branch")], F.coalesce("n.tags", F.array().cast("array<string>")).alias("tags"),
            F.element_at(F.when(F.size("n.groups") > 0, F.col("n.groups")), 1).alias("grp"),
            canonical_params(F.col("n.meta")).alias("meta"), time("n.created").alias("created"), time("n.updated").alias("updated")),
        "node_group": nodes.select(P, "node_id", F.explode("n.groups").alias("grp")),
        "node_note": nodes.select(P, "node_id", F.explode("n.notes").alias("x")).select(P, "node_id", "x.*"),
        "node_version": versions.select(P, "node_id", *[F.col(f"w.{c}").alias(c) for c in (
            "v", "why", "hash", "size", "mtime", "kind", "stored", "message", "actor")], time("w.ts").alias("ts")),
        "version_parent": versions.select(P, "node_id", F.col("w.v").alias("v"),
                                          F.explode("w.parents").alias("parent_id", "recorded")),
        "version_param": versions.select(P, "node_id", F.col("w.v").alias("v"),
                                         F.explode("w.edge_params").alias("edge_id", "p")).select(
            P, "node_id", "v", "edge_id", F.explode(canonical_params(F.col("p"))).alias("key", "value")),
        "copy_record": nodes.where("n.organized IS NOT NULL").select(P, "node_id", "n.organized.*").withColumnRenamed(
            "path", "copy_path"),
        "edge": edges.select(P, F.col("e.id").alias("edge_id"), *[F.col(f"e.{c}").alias(c) for c in (
            "source", "target", "rel", "script", "script_version", "command", "label", "note", "source_version",
            "placed_version", "placed_path", "params_file")], canonical_params(F.col("e.params")).alias("params")),
        "edge_change": edges.select(P, F.col("e.id").alias("edge_id"), F.explode("e.changes").alias("c")).select(
            P, "edge_id", time("c.ts").alias("ts"), "c.actor", "c.why", F.explode("c.params").alias("key", "pair")).select(
            P, "edge_id", "ts", "actor", "why", "key", canonical_variant(F.get("pair", 0)).alias("before"),
            canonical_variant(F.get("pair", 1)).alias("after")),
        "step": docs.select(P, F.explode("steps").alias("step", "s")).select(
            P, "step", F.col("s.label").alias("step_label"), F.col("s.order").alias("ord"), "s.description"),
        "group_def": docs.select(P, F.explode("groups").alias("grp", "g")).select(
            P, "grp", F.col("g.label").alias("group_label"), "g.color"),
        "analysis": analyses.select(P, "key", *[F.col(f"a.{c}").alias(c) for c in (
            "title", "parent", "summary", "status", "start", "end", "hidden")], F.col("a.group").alias("label"),
            F.coalesce("a.order", F.lit(0)).alias("ord")),
        "analysis_node": analyses.select(P, "key", F.explode("a.nodes").alias("node_id")),
        "analysis_event": analyses.select(P, "key", F.posexplode("a.history").alias("seq", "h")).select(P, "key", "seq", "h.*"),
        "project_note": docs.select(P, F.explode("project_notes").alias("x")).select(
            P, F.col("x.id").alias("note_id"), "x.kind", "x.status", "x.text", "x.nodes", "x.actor"),
    }
    newest = tables["node_version"].groupBy(P, "node_id").agg(F.max("v").alias("v"))
    tables["recorded"] = tables["version_parent"].join(newest, [P, "node_id", "v"], "left_semi").drop("v")
    return tables
