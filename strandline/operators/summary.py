"""Counts, groupings and registers: steps, categories, projects, groups, articles, notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import basename
from strandline.functions.words import common_label, slug
from strandline.operators.history import recency
from strandline.plans import cut, forget, number_free, order_slices, running_sum
from strandline.vocab import COMPONENT_RANK, GROUPING_RELS, NODE_TYPES, PROCESS_TYPES

P = "project_id"
NODE = ["project_id", "node_id"]


def category(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, (_, cat, _) in NODE_TYPES.items():
        out = out.when(kind == name, cat)
    return out.otherwise("notes")


def type_rank(kind: Column) -> Column:
    names = list(NODE_TYPES)
    out = F.when(kind == names[0], 0)
    for i, name in enumerate(names[1:], 1):
        out = out.when(kind == name, i)
    return out.otherwise(len(names))


def node_list(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Artifacts in type order, then by id."""
    rows = nodes if kind is None else nodes.where(F.col("type") == kind)
    return rows.orderBy(type_rank(F.col("type")), "node_id")


def step_members(nodes: DataFrame) -> DataFrame:
    """(step, type, members); a null step appears when something has none."""
    return nodes.groupBy(P, "step", "type").agg(F.count(F.lit(1)).alias("members"))


def step_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_step, to_step, links): links within a step (both ends equal) and from one step to another."""
    a = nodes.select(P, F.col("node_id").alias("source"), F.col("step").alias("from_step"))
    b = nodes.select(P, F.col("node_id").alias("target"), F.col("step").alias("to_step"))
    return (edges.select(P, "source", "target").join(a, [P, "source"], "left").join(b, [P, "target"], "left")
            .groupBy(P, "from_step", "to_step").agg(F.count(F.lit(1)).alias("links")))


def category_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(P, category(F.col("type")).alias("category"), "type").agg(F.count(F.lit(1)).alias("n"))


def project_summary(projects: DataFrame, nodes: DataFrame, edges: DataFrame, states: DataFrame, events: DataFrame,
                    analyses: DataFrame | None = None, steps: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """One row per registered project; `missing` marks projects without a catalog.

    `place` is the order of the home page: last activity first, then by name (the id in tables without names). `analyses` may say
    which are organized, `steps` (step, ord, step_label) become the list of labels in their order, `copies` are counted.
    """
    counts = nodes.groupBy(P).agg(
        F.count(F.lit(1)).alias("nodes"),
        *[F.count_if(category(F.col("type")) == c).alias(c) for c in ("sources", "process", "outputs", "writing")])
    links = edges.groupBy(P).agg(F.count(F.lit(1)).alias("links"))
    status = states.groupBy(P).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("stale", "modified", "missing")])
    last = events.groupBy(P).agg(F.max("ts").alias("last_activity"))
    out = projects.select(P)
    for part in (counts, links, status.withColumnRenamed("missing", "missing_files"), last):
        out = out.join(part, P, "left")
    if analyses is not None:
        marks = [F.count_if("organized").alias("organized")] if "organized" in analyses.columns else []
        out = out.join(analyses.groupBy(P).agg(F.count(F.lit(1)).alias("analyses"), *marks), P, "left")
    if steps is not None:
        step = F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), "step", F.coalesce("step_label", F.lit("")).alias("label"))
        in_order = steps.groupBy(P).agg(F.transform(F.sort_array(F.collect_list(step)), lambda s: s["label"]).alias("steps"))
        out = out.join(in_order, P, "left")
    if copies is not None:
        out = out.join(copies.groupBy(P).agg(F.countDistinct("node_id").alias("copies")), P, "left")
    out = out.withColumn("missing", F.col("nodes").isNull())
    names = projects.select(P, F.coalesce("name", P).alias("_name") if "name" in projects.columns else F.col(P).alias("_name"))
    order = [F.col("last_activity").desc_nulls_last(), F.col("_name"), F.col(P)]
    placed = running_sum(order_slices(out.join(names, P), [], order), [], F.col("_part"), order, F.lit(1), "place")
    return placed.select(*out.columns, "place")


def file_kind(path: Column) -> Column:
    name = basename(F.coalesce(path, F.lit("")))
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def group_members(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, node_id, size) from rows (node_id, grp)."""
    sizes = groups.groupBy(P, "grp").agg(F.count(F.lit(1)).alias("size"))
    return nodes.select(*NODE).join(groups, NODE).join(sizes, [P, "grp"]).select(P, "grp", "node_id", "size")


def group_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, type, kind, way, process_id, node_id): artifacts without a group, tied to one process in one way."""
    free = nodes.where(F.col("grp").isNull() & ~F.col("type").isin("note", "article")).select(
        *NODE, "step", "type", file_kind(F.col("path")).alias("kind"))
    process = nodes.where(F.col("type").isin(PROCESS_TYPES)).select(P, F.col("node_id").alias("process_id"))
    links = edges.where(F.col("rel").isin(GROUPING_RELS))
    ends = [links.select(P, F.col(mine).alias("node_id"), F.col(other).alias("process_id"), F.lit(way).alias("way"))
            for mine, other, way in (("source", "target", "feed"), ("target", "source", "made by"))]
    return (ends[0].unionByName(ends[1]).join(process, [P, "process_id"], "left_semi").join(free, NODE)
            .select(P, "step", "type", "kind", "way", "process_id", "node_id").distinct())


def pack_groups(candidates: DataFrame, group_key: list[str], taken: DataFrame | None = None) -> DataFrame:
    """(group_key, node_id): candidate sets accepted largest first, every artifact used once, two members at least.

    The greedy order is followed without walking through the sets: an artifact whose best open set is sure of two
    such members joins it; a set that can no longer reach two is dropped; both repeat until nothing is open. Sets are
    numbered in that order once, so a round writes an artifact and a number for each row that is still open.
    """
    key = [P, *group_key]
    # written once: both the sizes of the sets and the open rows start from them
    rows, _ = cut(candidates.select(*key, "node_id").distinct(), "candidates")
    sizes, _ = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sets")
    order = [F.col("n").desc(), *[F.col(k) for k in [*group_key, P]]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ids of sorted ranges grow along the order and are unique
    names, _ = cut(sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        *[F.col(k).alias(f"_{k}") for k in key], F.monotonically_increasing_id().alias("set")), "numbered")
    forget(sizes)
    left = rows if taken is None else rows.join(taken.select(*NODE), NODE, "left_anti")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    open_rows, seen = cut(left.join(names, same).select(P, "node_id", "set"), "open")
    accepted_parts = []
    accepted = None
    while seen["rows"]:
        best, _ = cut(open_rows.groupBy(*NODE).agg(F.min("set").alias("set")), "best")
        sure = best.groupBy("set").agg(F.count(F.lit(1)).alias("tops")).where("tops > 1").select("set")
        accepted, _ = cut(sure if accepted is None else accepted.unionByName(sure).distinct(), "accepted")
        joined, _ = cut(best.join(accepted, "set", "left_semi").select(P, "node_id", "set"), "joined")
        accepted_parts.append(joined)
        was = open_rows
        rest = was.join(joined.select(*NODE), NODE, "left_anti")
        dropped = rest.groupBy("set").agg(F.count(F.lit(1)).alias("live")).where("live < 2").join(accepted, "set", "left_anti")
        open_rows, seen = cut(rest.join(dropped.select("set"), "set", "left_anti").select(P, "node_id", "set"), "open")
        forget(was, best)
    if not accepted_parts:
        return rows.where("false").select(*key, "node_id")
    forget(rows, open_rows)
    named = names.select("set", *[F.col(f"_{k}").alias(k) for k in group_key])
    return reduce(DataFrame.unionByName, accepted_parts).join(named, "set").select(*key, "node_id")


def group_suggestions(nodes: DataFrame, edges: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(name, step, source, node_id): sub-groups to propose for artifacts without one.

    First the labels of analyses that list them (`listed`: label, node_id), then sets of one type and file kind
    tied the same way to one process.
    """
    free = nodes.where(F.col("grp").isNull() & ~F.col("type").isin("note", "article"))
    parts, taken = [], None
    if listed is not None:
        rows = free.select(*NODE, "step").join(listed.select(*NODE, "label").distinct(), NODE)
        by_label, _ = cut(pack_groups(rows, ["label", "step"]), "labelled")
        parts.append(by_label.select(P, F.col("label").alias("name"), "step", F.lit("history").alias("source"), "node_id"))
        taken = by_label.select(*NODE)
    set_key = ["step", "type", "kind", "way", "process_id"]
    sets, _ = cut(pack_groups(group_candidates(nodes, edges), set_key, taken), "packed")
    labels = sets.join(nodes.select(*NODE, "label"), NODE)
    prefix = labels.groupBy(P, *set_key).agg(common_label(F.min("label"), F.max("label")).alias("prefix")).select(
        *[F.col(c).alias(f"_{c}") for c in [P, *set_key]], "prefix")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [P, *set_key]]
    words = F.when(F.col("way") == "feed", "feeding").otherwise("made by")
    name = F.when(F.length("prefix") >= 4, F.col("prefix")).otherwise(
        F.concat(F.col("type"), F.lit("s "), words, F.lit(" "), "process_id"))
    parts.append(sets.join(prefix, same).select(P, name.alias("name"), "step", F.lit("set").alias("source"), "node_id"))
    return reduce(DataFrame.unionByName, parts)


def article_components(nodes: DataFrame, edges: DataFrame, states: DataFrame, stale_links: DataFrame) -> DataFrame:
    """Parts of each article with versions and state; `section_rank` and `place` give the reading order."""
    rank = F.when(F.lit(False), 0)
    for kind, at in COMPONENT_RANK.items():
        rank = rank.when(F.col("type") == kind, at)
    parts = nodes.select(P, F.col("node_id").alias("source"), "type", "created", "current_version", "final_version")
    state = states.select(P, F.col("node_id").alias("source"), "state")
    stale = stale_links.select(P, "edge_id", F.lit(True).alias("stale_link")).distinct()
    rows = (edges.where("rel = 'part_of'").join(parts, [P, "source"]).join(state, [P, "source"], "left")
            .join(stale, [P, "edge_id"], "left").withColumn("section_rank", rank.otherwise(9)))
    by_time = F.when(F.col("section_rank") == 0, F.date_format("created", "yyyyMMddHHmmss")).otherwise(F.lit(""))
    by_label = F.when(F.col("section_rank") == 0, F.lit("")).otherwise(F.coalesce("label", F.lit("")))
    group, order = [P, "target", "section_rank"], [F.col("_order"), F.col("source")]
    rows = order_slices(rows.withColumn("_order", F.concat_ws("\u0001", by_time, by_label)), group, order)
    placed = running_sum(rows, group, F.col("_part"), order, F.lit(1), "place")
    return placed.select(P, F.col("target").alias("article"), F.col("source").alias("node_id"), "type", "label",
                         "section_rank", "place", "placed_version", "current_version", "final_version", "state",
                         F.coalesce("stale_link", F.lit(False)).alias("stale_link"))


def notes_of(notes: DataFrame, all_notes: bool = False) -> DataFrame:
    """(node_id, note_id, kind, status, rank): notes per artifact, open ones unless all; issues rank first."""
    rows = notes if all_notes else notes.where("status = 'open'")
    return rows.select(P, "note_id", "kind", "status", F.explode("nodes").alias("node_id"),
                       F.when(F.col("kind") == "issue", 0).otherwise(1).alias("rank")).distinct()


def note_status(updates: DataFrame) -> DataFrame:
    """(note_id, status): the status set last."""
    return updates.where("status IS NOT NULL").groupBy(P, "note_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"))


def pipeline_status(nodes: DataFrame, copy_states: DataFrame) -> DataFrame:
    """(node_id, pushed, code): is a process's code published (repo and commit), and is its copy up to date?"""
    saved = copy_states.select(*NODE, "state")
    code = F.when(F.col("state").isNull(), "not saved").when(F.col("state") == "ok", "saved").otherwise(F.col("state"))
    pushed = F.col("meta").getItem("repo").isNotNull() & F.col("meta").getItem("commit").isNotNull()
    return nodes.where("type = 'pipeline'").join(saved, NODE, "left").select(*NODE, pushed.alias("pushed"),
                                                                             code.alias("code"))


def project_slugs(projects: DataFrame, slices: Column) -> DataFrame:
    """(project_id, slug): short names, repeats numbered -2, -3 ... in order of registration (`seq`).

    Numbers that another project's own name already ends with are left out.
    """
    named = projects.select(P, "name", "seq", slug(F.col("name"), 40, "project").alias("base"))
    numbered = r"^(.*)-([0-9]+)$"
    own = named.select(F.regexp_extract("base", numbered, 1).alias("base"),
                       F.regexp_extract("base", numbered, 2).try_cast("long").alias("n")).where("n > 1")
    first = number_free(named, ["base"], slices, [F.col("seq")], own, "n")
    return first.select(P, F.when(F.col("n") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit("-"), "n")).alias("slug"))


def resolve_project(refs: DataFrame, projects: DataFrame) -> DataFrame:
    """(ref, project_id, problem): by id or name, else by path, else by a fragment only one project has.

    Exact matches are equi-joins; only references without one are looked for inside names.
    """
    known = projects.select(P, F.lower("name").alias("_name"), F.col("path").alias("_path"), F.lower("slug").alias("_slug"))
    forms = [known.select(P, F.col("_slug").alias("form"), F.lit(0).alias("rank")),
             known.select(P, F.col("_name").alias("form"), F.lit(0).alias("rank")),
             known.select(P, F.lower("_path").alias("form"), F.lit(1).alias("rank"))]
    exact = (refs.withColumn("form", F.lower("ref")).join(reduce(DataFrame.unionByName, forms), "form")
             .groupBy("ref").agg(F.min_by(P, F.struct("rank", P)).alias(P)))
    rest = refs.join(exact, "ref", "left_anti").withColumn("form", F.lower("ref"))
    # up to three letters of a reference lead to the names that hold them
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - k + 1)), lambda i: F.substr(F.col("text"), i, k)))))
    texts = known.select(P, F.explode(F.array("_name", "_slug")).alias("text"))
    indexed = texts.select(P, "text", F.explode(grams).alias("gram"))
    hits = (rest.where(F.length("form") > 0).withColumn("gram", F.substring("form", 1, 3)).join(indexed, "gram")
            .where(F.contains("text", F.col("form"))).groupBy("ref").agg(F.min(P).alias("a"), F.max(P).alias("b")))
    found = rest.select("ref").join(hits, "ref", "left").select(
        "ref", F.when(F.col("a") == F.col("b"), F.col("a")).alias(P),
        F.when(F.col("a").isNull(), "unknown").when(F.col("a") != F.col("b"), "ambiguous").alias("problem"))
    return exact.select("ref", P, F.lit(None).cast("string").alias("problem")).unionByName(found)


GROUPINGS = ("category", "type", "group", "step", "article", "state", "recency")


def group_nodes(nodes: DataFrame, now: Column, articles: DataFrame | None = None, states: DataFrame | None = None,
                steps: DataFrame | None = None, ways: tuple[str, ...] = GROUPINGS) -> DataFrame:
    """(node_id, by, grp): the group of every artifact for each of `ways` to group the view.

    `nodes` has type, step, updated (a time or null) and groups (a list) or grp (the first group). `articles` (node_id, article)
    and `states` (node_id, state) are asked for by the ways of these names. With `steps` (project_id, step) an unknown step counts as none.
    """
    key, columns = NODE, set(nodes.columns)
    first = F.get("groups", F.lit(0)) if "groups" in columns else F.col("grp")
    rows = nodes
    if steps is not None and "step" in ways:
        rows = rows.join(steps.select(P, F.col("step"), F.lit(True).alias("_known")).distinct(), [P, "step"], "left").withColumn(
            "step", F.when(F.col("_known"), F.col("step")))
    if "article" in ways:
        rows = rows.join(articles.select(*key, F.col("article").alias("_article")), key, "left")
    if "state" in ways:
        rows = rows.join(states.select(*key, F.col("state").alias("_state")), key, "left")
    values = {"category": lambda: category(F.col("type")), "type": lambda: F.col("type"),
              "group": lambda: F.coalesce(first, F.lit("(ungrouped)")), "step": lambda: F.coalesce("step", F.lit("(no step)")),
              "article": lambda: F.coalesce("_article", F.lit("(no article)")), "state": lambda: F.coalesce("_state", F.lit("ok")),
              "recency": lambda: recency(F.col("updated"), now)}
    return rows.select(*key, F.inline(F.array(*[F.struct(F.lit(w).alias("by"), values[w]().alias("grp")) for w in ways])))
