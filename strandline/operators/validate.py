"""Checks of incoming batches of artifacts and links, and the load of accepted ones.

Every rule is a table of (project_id, batch_id, severity, rule, subject, detail). A batch with an ERROR is not
loaded. Links name artifacts by batch key or by catalog id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.words import looks_cosmetic, natural_key
from strandline.operators.dedup import batch_signature, classify_new
from strandline.operators.graph import between, find_cycles, reachable
from strandline.operators.summary import file_kind
from strandline.plans import cut, number_free
from strandline.vocab import (GROUPING_RELS, MAX_SNAPSHOT_BYTES, MODES, NO_PATH_EXPECTED, NODE_TYPES, OUTPUT_TYPES,
                              PARAM_RELS, PROCESS_TYPES, RAW_MANAGED_BYTES, RELATIONS, UNUSUAL_PARAM_RELS)

P = "project_id"
BATCH = ["project_id", "batch_id"]
ERROR, WARN = "ERROR", "WARN"


def finding(rows: DataFrame, severity: str, rule: str, subject: Column | str, detail: Column | str | None = None) -> DataFrame:
    detail = F.lit(None).cast("string") if detail is None else (F.col(detail) if isinstance(detail, str) else detail)
    subject = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(*BATCH, F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                       subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def header(headers: DataFrame) -> DataFrame:
    return _all([finding(headers.where("protocol IS NULL OR protocol <> 1"), ERROR, "protocol", "batch_id"),
                 finding(headers.where(_blank("summary")), WARN, "no_summary", "batch_id")])


def duplicate_keys(nodes: DataFrame, catalog_nodes: DataFrame) -> DataFrame:
    """Keys missing, used twice or equal to a catalog id; explicit ids used twice or taken."""
    known = catalog_nodes.select(P, F.col("node_id").alias("name"))
    keys = nodes.withColumn("name", F.coalesce("key", "id"))
    times = keys.where("name IS NOT NULL").groupBy(*BATCH, "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = nodes.where("id IS NOT NULL").groupBy(*BATCH, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    collides = keys.where("id IS NULL").select(*BATCH, "name").distinct().join(known, [P, "name"], "left_semi")
    taken = (nodes.where("id IS NOT NULL").select(*BATCH, F.col("id").alias("name")).distinct()
             .join(known, [P, "name"], "left_semi"))
    return _all([finding(keys.where("name IS NULL"), ERROR, "no_key", "label"),
                 finding(times, ERROR, "duplicate_key", "name", "n"), finding(ids, ERROR, "duplicate_id", "id", "n"),
                 finding(collides, ERROR, "key_is_an_id", "name"), finding(taken, ERROR, "id_taken", "name")])


def unknown_values(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def strange(column: str, allowed: list[str]) -> Column:
        return F.col(column).isNull() | ~F.col(column).isin(allowed)

    return _all([finding(nodes.where(strange("type", list(NODE_TYPES))), ERROR, "unknown_type", "key", "type"),
                 finding(nodes.where(~F.coalesce("mode", F.lit("ref")).isin(MODES)), ERROR, "unknown_mode", "key", "mode"),
                 finding(edges.where(strange("rel", RELATIONS)), ERROR, "unknown_relation", "n", "rel")])


def labels(nodes: DataFrame) -> DataFrame:
    return _all([finding(nodes.where(_blank("label")), ERROR, "no_label", "key"),
                 finding(nodes.where(F.length(F.trim("label")) > 60), WARN, "long_label", "key")])


def dangling(nodes: DataFrame, refs: DataFrame, catalog_nodes: DataFrame) -> DataFrame:
    """References (place, ref, catalog_only) to what is neither in the batch nor in the catalog."""
    keys = nodes.select(*BATCH, F.coalesce("key", "id").alias("ref")).distinct()
    known = catalog_nodes.select(P, F.col("node_id").alias("ref"))
    open_refs = refs.where("NOT catalog_only").join(keys, [*BATCH, "ref"], "left_anti").unionByName(
        refs.where("catalog_only"))
    return finding(open_refs.join(known, [P, "ref"], "left_anti"), ERROR, "dangling", "place", "ref")


def edge_refs(edges: DataFrame) -> DataFrame:
    ends = F.array(*[F.struct(F.concat(F.lit(f"edge {c} "), "n").alias("place"), F.col(c).alias("ref"))
                     for c in ("src", "dst", "script")])
    return edges.select(*BATCH, F.inline(ends), F.lit(False).alias("catalog_only")).where(
        "NOT (place LIKE 'edge script%' AND ref IS NULL)")


def known_types(nodes: DataFrame, catalog_nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """`refs` (project_id, batch_id, ref) with the type of what they name; a batch key hides a catalog id."""
    own = nodes.select(*BATCH, F.coalesce("key", "id").alias("ref"), F.col("type").alias("own")).dropDuplicates([*BATCH, "ref"])
    old = catalog_nodes.select(P, F.col("node_id").alias("ref"), F.col("type").alias("old"))
    return (refs.join(own, [*BATCH, "ref"], "left").join(old, [P, "ref"], "left")
            .withColumn("ref_type", F.coalesce("own", "old")).drop("own", "old"))


def script_types(nodes: DataFrame, edges: DataFrame, catalog_nodes: DataFrame) -> DataFrame:
    used = edges.where("script IS NOT NULL").select(*BATCH, "n", F.col("script").alias("ref"))
    typed = known_types(nodes, catalog_nodes, used)
    return finding(typed.where(F.col("ref_type").isNotNull() & ~F.col("ref_type").isin(PROCESS_TYPES)), ERROR,
                   "script_not_a_process", "n", "ref")


def nested_params(edges: DataFrame) -> DataFrame:
    """Links whose parameters (JSON text) are no object, or hold more than scalars and lists of scalars."""
    parsed = edges.where("params_json IS NOT NULL").withColumn("_v", F.try_parse_json("params_json"))
    shape = F.schema_of_variant("_v")
    no_object = parsed.where(F.col("_v").isNull() | ~F.startswith(shape, F.lit("OBJECT")))
    values = (parsed.where(F.startswith(shape, F.lit("OBJECT")))
              .select(*BATCH, "n", F.explode(F.from_json("params_json", "map<string,variant>")).alias("key", "value")))
    kind = F.schema_of_variant("value")
    inner = F.exists(F.col("value").try_cast("array<variant>"), lambda x: F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"))
    bad = values.where(F.startswith(kind, F.lit("OBJECT")) | (F.startswith(kind, F.lit("ARRAY")) & inner))
    return _all([finding(no_object, ERROR, "params_not_an_object", "n"), finding(bad, ERROR, "param_not_scalar", "n", "key")])


def cosmetic_params(edges: DataFrame) -> DataFrame:
    keys = edges.select(*BATCH, "n", F.explode(F.map_keys("params")).alias("key"))
    return finding(keys.where(looks_cosmetic(F.col("key"))), WARN, "cosmetic_param", "n", "key")


def params_on_relation(edges: DataFrame) -> DataFrame:
    odd = (F.size("params") > 0) & F.col("rel").isin(UNUSUAL_PARAM_RELS)
    return finding(edges.where(odd), WARN, "params_on_relation", "n", "rel")


def unparameterised(nodes: DataFrame, edges: DataFrame, catalog_nodes: DataFrame, catalog_edges: DataFrame) -> DataFrame:
    """Links without parameters into an output that no link brings parameters to."""
    plain = edges.where((F.size("params") == 0) & F.col("rel").isin(PARAM_RELS)).select(*BATCH, "n", F.col("dst").alias("ref"))
    into_output = known_types(nodes, catalog_nodes, plain).where(F.col("ref_type").isin(OUTPUT_TYPES))
    tuned = edges.where(F.size("params") > 0).select(*BATCH, F.col("dst").alias("ref")).distinct()
    tuned_before = catalog_edges.where(F.size("params") > 0).select(P, F.col("target").alias("ref")).distinct()
    left = into_output.join(tuned, [*BATCH, "ref"], "left_anti").join(tuned_before, [P, "ref"], "left_anti")
    return finding(left, WARN, "no_params_into_output", "n", "ref")


def no_provenance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    fed = edges.select(*BATCH, F.col("dst").alias("name")).distinct()
    outputs = nodes.where(F.col("type").isin(OUTPUT_TYPES)).withColumn("name", F.coalesce("key", "id"))
    return finding(outputs.select(*BATCH, "name").distinct().join(fed, [*BATCH, "name"], "left_anti"), WARN,
                   "no_provenance", "name")


def cycles(nodes: DataFrame, edges: DataFrame, catalog_edges: DataFrame) -> DataFrame:
    """Self-links, and batches that close a cycle together with the catalog.

    Each batch is its own question. The catalog only matters between artifacts the batch links to and from, so
    it is reduced to paths between those before cycles are looked for.
    """
    own = nodes.select(*BATCH, F.coalesce("key", "id").alias("ref"), F.lit(True).alias("own")).distinct()

    def named(df: DataFrame, column: str) -> DataFrame:
        keyed = own.withColumnRenamed("ref", column).withColumnRenamed("own", f"_{column}")
        return df.join(keyed, [*BATCH, column], "left").withColumn(
            column, F.when(F.col(f"_{column}"), F.concat(F.lit("@"), column)).otherwise(F.col(column))).drop(f"_{column}")

    links = edges.select(*BATCH, "src", "dst").unionByName(
        edges.where("script IS NOT NULL").select(*BATCH, F.col("script").alias("src"), "dst"))
    links, _ = cut(named(named(links, "src"), "dst").distinct(), "links")
    into = links.where("NOT startswith(dst, '@')").select(*BATCH, F.col("dst").alias("seed")).distinct()
    out = links.where("NOT startswith(src, '@')").select(*BATCH, F.col("src").alias("node_id")).distinct()
    way = between(catalog_edges, into.select(P, F.col("seed").alias("node_id")), out.select(P, "node_id"))
    met = into.select(P, "seed").distinct().join(way.select(P, F.col("source").alias("seed")).distinct(), [P, "seed"], "left_semi")
    paths = reachable(way, met, "down").select(P, "seed", "node_id")
    inside = into.join(paths, [P, "seed"]).join(out, [*BATCH, "node_id"], "left_semi").select(
        *BATCH, F.col("seed").alias("src"), F.col("node_id").alias("dst"))
    scope = F.concat_ws("\u0001", P, "batch_id")
    graph = links.where("src <> dst").unionByName(inside).select(
        scope.alias("project_id"), F.col("src").alias("source"), F.col("dst").alias("target"))
    caught = find_cycles(graph).groupBy("project_id").agg(F.min("node_id").alias("at"))
    parts = F.split("project_id", "\u0001")
    looped = caught.select(parts[0].alias("project_id"), parts[1].alias("batch_id"), "at")
    return _all([finding(edges.where("src = dst"), ERROR, "self_link", "n"), finding(looped, ERROR, "cycle", "at")])


def duplicates(nodes: DataFrame, classified: DataFrame, signatures: DataFrame) -> DataFrame:
    """Content that is recorded already (same_as, overlaps by key) or twice in the batch (first by key)."""
    chosen = F.coalesce("allow_duplicate", F.lit(False)) if "allow_duplicate" in nodes.columns else F.lit(False)
    allowed = nodes.select(*BATCH, F.col("key").alias("owner"), chosen.alias("allowed"))
    found = classified.join(allowed, [*BATCH, "owner"])
    same = found.where("same_as IS NOT NULL AND NOT allowed")
    partly = found.where("overlaps IS NOT NULL AND (same_as IS NULL OR allowed)")
    return _all([finding(same, ERROR, "same_content", "owner", "same_as"), finding(partly, WARN, "shared_files", "owner", "overlaps"),
                 finding(signatures.where("first <> owner"), ERROR, "twice_in_batch", "owner", "first")])


def content_duplicates(nodes: DataFrame, files: DataFrame, recorded: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`duplicates` from the files (owner = key, size, hash) of the batches and those of the catalog (owner, size, hash)."""
    # one object per batch and key; both checks look at content sets
    named = files.withColumn("owner", F.concat_ws("\u0001", "batch_id", "owner"))
    parts = F.split("owner", "\u0001")
    classified = classify_new(named, recorded, min_bytes).select(
        P, parts[0].alias("batch_id"), parts[1].alias("owner"), "same_as", "overlaps")
    scoped = files.withColumn(P, F.concat_ws("\u0001", P, "batch_id"))
    scope = F.split(P, "\u0001")
    signatures = batch_signature(scoped, min_bytes).select(scope[0].alias(P), scope[1].alias("batch_id"), "owner", "first")
    return duplicates(nodes, classified, signatures)


def paths(nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """Missing files, oversized managed copies, destinations that exist. `listing` has path, size, is_dir."""
    on_disk = listing.select(P, "path", F.col("size").alias("_size"), F.col("is_dir").alias("_dir")).dropDuplicates([P, "path"])
    rows = nodes.where("path IS NOT NULL").join(on_disk, [P, "path"], "left")
    here = rows.where("_size IS NOT NULL")
    managed = here.where("mode = 'managed'")
    taken = managed.where("dest IS NOT NULL AND dest <> path").join(
        listing.select(P, F.col("path").alias("dest")).distinct(), [P, "dest"], "left_semi")
    return _all([
        finding(rows.where("_size IS NULL"), ERROR, "path_missing", "key", "path"),
        finding(managed.where("_dir"), WARN, "managed_folder", "key", "path"),
        finding(managed.where((~F.col("_dir")) & (F.col("_size") > MAX_SNAPSHOT_BYTES)), WARN, "too_big_to_store", "key", "path"),
        finding(managed.where((F.col("type") == "raw") & ~F.col("_dir") & (F.col("_size") > RAW_MANAGED_BYTES)), WARN,
                "raw_is_copied", "key", "path"),
        finding(taken, ERROR, "destination_taken", "key", "dest")])


def missing_meta(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """No address, no place, no step, or a step nobody defined. `steps` (step) holds catalog and batch steps."""
    bare = nodes.where("path IS NULL")
    kind = F.coalesce("type", F.lit(""))
    nowhere = ~kind.isin([*NO_PATH_EXPECTED, "resource"]) & F.col("location").isNull()
    undefined = nodes.where("step IS NOT NULL").join(steps.select(P, "step").distinct(), [P, "step"], "left_anti")
    return _all([finding(bare.where((kind == "resource") & F.col("url").isNull()), WARN, "no_url", "key"),
                 finding(bare.where(nowhere), WARN, "no_path", "key"),
                 finding(nodes.where(F.col("step").isNull() & (kind != "note")), WARN, "no_step", "key"),
                 finding(undefined, WARN, "undefined_step", "key", "step")])


def ungrouped_sets(nodes: DataFrame, edges: DataFrame, catalog_nodes: DataFrame) -> DataFrame:
    """Two or more new artifacts of one kind tied the same way to one process, without a group."""
    free = nodes.where("key IS NOT NULL AND grp IS NULL").select(
        *BATCH, F.col("key").alias("mine"), "step", "type", file_kind(F.col("path")).alias("kind")).dropDuplicates([*BATCH, "mine"])
    links = edges.where(F.col("rel").isin(GROUPING_RELS))
    ends = _all([links.select(*BATCH, F.col(mine).alias("mine"), F.col(other).alias("ref"), F.lit(way).alias("way"))
                 for mine, other, way in (("src", "dst", "feed"), ("dst", "src", "are made by"))]).distinct()
    tied = known_types(nodes, catalog_nodes, ends).where(F.col("ref_type").isin(PROCESS_TYPES)).join(free, [*BATCH, "mine"])
    sets = tied.groupBy(*BATCH, "step", "type", "kind", "way", "ref").agg(F.count(F.lit(1)).alias("n"), F.min("mine").alias("first"))
    text = F.concat_ws(" ", F.col("n").cast("string"), "type", "way", "ref")
    return finding(sets.where("n > 1"), WARN, "ungrouped_set", "first", text)


def small_items(saves: DataFrame, branches: DataFrame, notes: DataFrame, groups: DataFrame) -> DataFrame:
    return _all([finding(saves.where(_blank("why")), WARN, "save_without_reason", "n"),
                 finding(branches.where(_blank("label")), ERROR, "branch_without_label", "n"),
                 finding(branches.where(_blank("why")), ERROR, "branch_without_reason", "n"),
                 finding(notes.where(_blank("text")), ERROR, "empty_note", "n"),
                 finding(groups.where(_blank("name")), ERROR, "group_without_name", "n")])


def report(batches: DataFrame, findings: DataFrame) -> DataFrame:
    """(batch_id, errors, warnings, passed): a batch passes without errors."""
    counts = findings.groupBy(*BATCH).agg(F.count_if(F.col("severity") == ERROR).alias("errors"),
                                          F.count_if(F.col("severity") == WARN).alias("warnings"))
    zero = F.lit(0).cast("long")
    return (batches.select(*BATCH).distinct().join(counts, BATCH, "left")
            .select(*BATCH, F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"))
            .withColumn("passed", F.col("errors") == 0))


def check_batch(batch: dict[str, DataFrame], catalog: dict[str, DataFrame]) -> DataFrame:
    """All findings about the tables of a batch that are given.

    What several rules read is written once, and the findings of each rule are written before the next rule runs: the plans and
    broadcasts of one rule are all that the driver holds at a time, however the tables came about.
    """
    nodes, edges = cut(batch["nodes"], "batch-nodes")[0], cut(batch["edges"], "batch-edges")[0]
    old_nodes, old_edges = cut(catalog["nodes"].select(P, "node_id", "type"), "catalog-nodes")[0], catalog["edges"]
    refs = [edge_refs(edges)]
    for name, column, only in (("notes", "node", False), ("groups", "node", False), ("final", "node", False),
                               ("saves", "node", True), ("branches", "of", True)):
        if name in batch:
            refs.append(batch[name].select(*BATCH, F.concat(F.lit(name + " "), "n").alias("place"), F.col(column).alias("ref"),
                                           F.lit(only).alias("catalog_only")))
    parts: list[DataFrame] = []

    def rule(found: DataFrame) -> None:
        parts.append(cut(found, "findings")[0])

    rule(duplicate_keys(nodes, old_nodes))
    rule(unknown_values(nodes, edges))
    rule(labels(nodes))
    rule(dangling(nodes, _all(refs), old_nodes))
    rule(script_types(nodes, edges, old_nodes))
    rule(cosmetic_params(edges))
    rule(params_on_relation(edges))
    rule(unparameterised(nodes, edges, old_nodes, old_edges))
    rule(no_provenance(nodes, edges))
    rule(cycles(nodes, edges, old_edges))
    rule(ungrouped_sets(nodes, edges, old_nodes))
    if "header" in batch:
        rule(header(batch["header"]))
    if "params_json" in edges.columns:
        rule(nested_params(edges))
    if "inventory" in catalog:
        rule(paths(nodes, cut(catalog["inventory"].select(P, "path", "size", "is_dir"), "inventory")[0]))
    if "files" in batch and "files" in catalog:
        files = cut(batch["files"].select(*BATCH, "owner", "size", "hash"), "batch-files")[0]
        rule(content_duplicates(nodes, files, cut(catalog["files"].select(P, "owner", "size", "hash"), "catalog-files")[0]))
    if "steps" in catalog:
        steps = catalog["steps"].select(P, "step")
        steps = steps.unionByName(batch["steps"].select(P, "step")) if "steps" in batch else steps
        rule(missing_meta(nodes, cut(steps.distinct(), "steps")[0]))
    if {"saves", "branches", "notes", "groups"} <= set(batch):
        rule(small_items(batch["saves"], batch["branches"], batch["notes"], batch["groups"]))
    return _all(parts)


def type_prefix(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, (prefix, _, _) in NODE_TYPES.items():
        out = out.when(kind == name, prefix)
    return out


def next_ids(nodes: DataFrame, catalog_nodes: DataFrame, slice_by: Column) -> DataFrame:
    """(key, node_id): explicit ids stay, others get the next free number of their type, in order of `seq`."""
    number = r"^([A-Za-z]+)([0-9]+)$"

    def numbers(df: DataFrame, column: str) -> DataFrame:
        return df.select(P, F.regexp_extract(column, number, 1).alias("prefix"),
                         F.regexp_extract(column, number, 2).try_cast("long").alias("n")).where("n IS NOT NULL")

    counters = numbers(catalog_nodes, "node_id").groupBy(P, "prefix").agg(F.max("n").alias("counter"))
    explicit = nodes.where("id IS NOT NULL")
    new = nodes.where("id IS NULL").withColumn("prefix", type_prefix(F.col("type"))).where("prefix IS NOT NULL")
    taken = (numbers(explicit, "id").join(counters, [P, "prefix"], "left")
             .select(P, "prefix", (F.col("n") - F.coalesce("counter", F.lit(0))).alias("n")).where("n > 0"))
    given = number_free(new.select(P, "batch_id", "key", "prefix", "seq"), [P, "prefix"], slice_by, [F.col("seq")], taken, "i")
    ids = given.join(counters, [P, "prefix"], "left").select(
        *BATCH, "key", F.concat("prefix", (F.col("i") + F.coalesce("counter", F.lit(0))).cast("string")).alias("node_id"))
    return ids.unionByName(explicit.select(*BATCH, "key", F.col("id").alias("node_id")))


def implied_code_edges(edges: DataFrame, catalog_edges: DataFrame) -> DataFrame:
    """(script, dst): code links to add because a link names a script that has no link of its own to the target."""
    wanted = edges.where("script IS NOT NULL AND script <> src").select(P, "script", "dst").distinct()
    have = (edges.select(P, F.col("src").alias("script"), "dst")
            .unionByName(catalog_edges.select(P, F.col("source").alias("script"), F.col("target").alias("dst"))).distinct())
    return wanted.join(have, [P, "script", "dst"], "left_anti")


def merged_links(links: DataFrame) -> DataFrame:
    """One row for each (source, target, rel) of a batch: parameters are merged in the order of `n`, the last value of a
    name wins, and so does the last text of each other column that has one."""
    key = [P, "source", "target", "rel"]
    place = F.col("n").cast("string")
    order = F.struct(place.try_cast("bigint").alias("number"), natural_key(place).alias("key"), place.alias("text"))
    rest = [c for c in links.columns if c not in (*key, "n", "params", "batch_id")]
    given = {c: F.nullif(F.col(c), F.lit("")) if dict(links.dtypes)[c] == "string" else F.col(c) for c in rest}
    told = links.groupBy(*key).agg(F.max(order).alias("_last"), *[
        F.max_by(given[c], F.when(given[c].isNotNull(), order)).alias(c) for c in rest]).drop("_last")
    values = (links.select(*key, order.alias("_order"), F.explode("params").alias("_name", "_value"))
              .groupBy(*key, "_name").agg(F.max_by("_value", "_order").alias("_value")))
    params = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("params"))
    empty = F.create_map().cast(links.schema["params"].dataType)
    return told.join(params, key, "left").withColumn("params", F.coalesce("params", empty))


def upsert_edges(catalog_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Links after a load: a link of the same ends and relation takes over new parameters and texts, others are added."""
    key = [P, "source", "target", "rel"]
    names = [c for c in catalog_edges.columns if c not in (*key, "params", "edge_id")]
    kinds = catalog_edges.schema
    told = {c: F.col(c).cast(kinds[c].dataType) if c in new_edges.columns else F.lit(None).cast(kinds[c].dataType) for c in names}
    fresh = new_edges.select(*key, F.col("params").alias("_new"), F.col("edge_id").alias("_id"),
                             *[told[c].alias(f"_new_{c}") for c in names])
    kept = F.map_filter("params", lambda k, _: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    params = (F.when(F.col("params").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("params"))
              .otherwise(F.map_concat(kept, "_new")))
    both = catalog_edges.join(fresh, key, "full_outer")
    return both.select(F.coalesce("edge_id", "_id").alias("edge_id"), *key, params.alias("params"),
                       *[F.coalesce(f"_new_{c}", c).alias(c) for c in names]).select(*catalog_edges.columns)
