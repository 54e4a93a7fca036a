"""Questions about the network of artifacts: closures, layers, cycles, families, removals.

Tables carry `project_id`; `nodes` has node_id and type, `edges` has edge_id, source, target, rel.

Keys are listed with the column of most values first: sorts compare the first bytes of the first key, and rows of one project
would be equal in them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans import bits, cut, fixpoint, forget, if_few, keyed, least, saturate
from strandline.vocab import HARD_RELS, PROCESS_TYPES, SOFT_RELS


def is_process(kind: str | Column) -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin(PROCESS_TYPES)


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links into and out of every artifact."""
    ends = (edges.select("project_id", F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
            .unionByName(edges.select("project_id", F.col("target").alias("node_id"), F.lit(1).alias("i"),
                                      F.lit(0).alias("o"))))
    count = ends.groupBy("project_id", "node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    zero = F.lit(0).cast("long")
    return (nodes.select("project_id", "node_id").join(count, ["node_id", "project_id"], "left")
            .select("project_id", "node_id", F.coalesce("n_in", zero).alias("n_in"),
                    F.coalesce("n_out", zero).alias("n_out")))


def _arcs(edges: DataFrame, direction: str, skip_rels: list[str]) -> DataFrame:
    if skip_rels:
        edges = edges.where(~F.col("rel").isin(skip_rels))
    here, there = ("source", "target") if direction == "down" else ("target", "source")
    more = [c for c in ("edge_id", "rel") if c in edges.columns]
    return edges.select("project_id", F.col(here).alias("node_id"), F.col(there).alias("next"), *more)


SEEDS_PER_TASK = 1 << 16
FEW_SEEDS = 1 << 12


def _numbered(seeds: DataFrame) -> tuple[DataFrame, int]:
    """(project_id, seed, block, mask) and their number: neighbours in the order of seeds share a block of 64, one bit each."""
    distinct, seen = cut(seeds.select("project_id", "seed").distinct(), "seeds")
    parts = 1 + seen["rows"] // SEEDS_PER_TASK
    placed = distinct.repartitionByRange(parts, "project_id", "seed").sortWithinPartitions("project_id", "seed").withColumn(
        "n", F.monotonically_increasing_id())
    numbered, _ = cut(placed.select("project_id", "seed", F.shiftright("n", 6).alias("block"), F.expr("shiftleft(1L, CAST(n & 63 AS INT))").alias("mask")),
                      "numbered")
    return numbered, seen["rows"]


def _walk(arcs: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(node_id, block, bits, depth) met on `arcs` (node_id, next), which are `keyed` by node_id, and a function that gives such rows
    one by one to their seeds. The seeds have depth 0.

    Up to 64 seeds that reach an artifact in the same round are the bits of one row, so a link is followed once for all of them.
    """
    hops = arcs.select("project_id", "node_id", "next")
    numbered, n = _numbered(seeds)

    def step(frontier: DataFrame, ends: tuple[Column, Column]) -> DataFrame:
        return frontier.join(hops.where(F.col("node_id").between(*ends)), ["node_id", "project_id"]).select(
            "project_id", F.col("next").alias("node_id"), "block", "bits")

    def by_seed(rows: DataFrame) -> DataFrame:
        names = numbered.select("project_id", "block", "seed", "mask")
        # few seeds fit everywhere and their blocks would be few tasks; many have as many blocks
        names = F.broadcast(names) if n <= FEW_SEEDS else names
        return rows.join(names, ["block", "project_id"]).where("bits & mask <> 0").drop("block", "bits", "mask")

    start = numbered.select("project_id", F.col("seed").alias("node_id"), "block", F.col("mask").alias("bits"))
    met = fixpoint(start, step, ["node_id", "block", "project_id"], max_rounds=max_depth, stop_at_max=max_depth is not None, name="reach",
                   value=bits("bits"), ends="node_id")
    return met.withColumnRenamed("round", "depth"), by_seed


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "down", skip_rels: list[str] | None = None,
              max_depth: int | None = None) -> DataFrame:
    """Everything up- or downstream of each seed (project_id, seed), with the fewest hops to it."""
    arcs = keyed(_arcs(edges, direction, skip_rels or []).select("project_id", "node_id", "next"), ["node_id", "project_id"], "arcs")
    met, by_seed = _walk(arcs, seeds, max_depth)
    forget(arcs)
    return by_seed(met.where("depth > 0")).select("project_id", "seed", "node_id", "depth")


def traced_edges(edges: DataFrame, seeds: DataFrame, direction: str = "up", max_depth: int | None = None) -> DataFrame:
    """Each link met while walking from a seed, at the depth where its near end is first reached.

    Upstream walks leave out loose links; downstream walks follow every link.
    """
    skip = SOFT_RELS if direction == "up" else []
    near, far = ("target", "source") if direction == "up" else ("source", "target")
    # one stored table serves the rounds and the links of what they met
    arcs = keyed(_arcs(edges, direction, skip), ["node_id", "project_id"], "arcs")
    met, by_seed = _walk(arcs, seeds, max_depth)
    return (by_seed(met.join(arcs, ["node_id", "project_id"]).where(F.lit(True) if max_depth is None else F.col("depth") <= max_depth))
            .withColumnsRenamed({"node_id": near, "next": far})
            .select("project_id", "seed", "depth", "edge_id", "source", "target", "rel"))


def typed_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links that carry provenance (loose ones left out) with what their ends are; repeats are harmless.

    (source, target, hard, from_process, to_process); `hard` is false for placements in an article.
    """
    kinds = nodes.select("project_id", F.col("node_id").alias("_id"), is_process("type").alias("_process"))
    links = edges.where(~F.col("rel").isin(SOFT_RELS)).select("project_id", "source", "target",
                                                             F.col("rel").isin(HARD_RELS).alias("hard"))
    for end, name in (("source", "from_process"), ("target", "to_process")):
        links = links.join(kinds.withColumnsRenamed({"_id": end, "_process": name}), [end, "project_id"])
    return links


def effective_parents(nodes: DataFrame, edges: DataFrame, children: DataFrame | None = None,
                      links: DataFrame | None = None) -> DataFrame:
    """(node_id, parent_id, process): direct sources and, behind a process, that process's own sources.

    `children` (project_id, node_id) limits the question to those artifacts; `links` are stored `typed_links`, best `keyed` by target.
    """
    own = []
    if links is None:
        kinds = nodes.select("project_id", F.col("node_id").alias("source"), is_process("type").alias("from_process"))
        links = keyed(edges.where(F.col("rel").isin(HARD_RELS)).select("project_id", "source", "target", F.lit(True).alias("hard"))
                      .join(kinds, ["source", "project_id"]), ["target", "project_id"], "links")
        own.append(links)
    hard = links.where("hard").select("project_id", "target", F.col("source").alias("parent_id"),
                                      F.col("from_process").alias("process"))
    start = hard.withColumnRenamed("target", "node_id")
    if children is not None:
        start = start.join(children.select("project_id", "node_id").distinct(), ["node_id", "project_id"], "left_semi")
    behind = hard.withColumnRenamed("target", "via")

    def step(frontier: DataFrame) -> DataFrame:
        open_ends = frontier.where("process").select("project_id", "node_id", F.col("parent_id").alias("via"))
        return open_ends.join(behind, ["via", "project_id"])

    parents = fixpoint(start, step, ["parent_id", "node_id", "project_id"], name="parents", leads_on="process").drop("round")
    forget(*own)
    return parents


def effective_children(links: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """(key, node_id): data made from each of `parents` (column key), directly or through processes only. `links` are best `keyed` by source."""
    hard = links.where("hard").select("project_id", F.col("source").alias("via"), F.col("target").alias("node_id"),
                                      F.col("to_process").alias("process"))
    start = parents.select("project_id", key, F.col(key).alias("via")).join(hard, ["via", "project_id"]).drop("via")

    def step(frontier: DataFrame) -> DataFrame:
        open_ends = frontier.where("process").select("project_id", key, F.col("node_id").alias("via"))
        return open_ends.join(hard, ["via", "project_id"])

    pairs = fixpoint(start, step, ["node_id", key, "project_id"], name="children", leads_on="process")
    return pairs.where("NOT process").select("project_id", key, "node_id")


def process_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(process_id, node_id): data made by each process, also through processes it starts."""
    kinds = nodes.select("project_id", "node_id", is_process("type").alias("process"))
    links = keyed(edges.where(F.col("rel").isin(HARD_RELS)).select("project_id", "source", "target", F.lit(True).alias("hard"))
                  .join(kinds.where("process").select("project_id", F.col("node_id").alias("source")), ["source", "project_id"], "left_semi")
                  .join(kinds.withColumnsRenamed({"node_id": "target", "process": "to_process"}), ["target", "project_id"]),
                  ["source", "project_id"], "links")
    makers = nodes.where(is_process("type")).select("project_id", F.col("node_id").alias("process_id"))
    made = effective_children(links, makers, "process_id")
    forget(links)
    return made


def peel(nodes: DataFrame, arcs: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Take away artifacts without remaining incoming links, round by round: (node_id, depth).

    Depth is the longest path to the artifact. What lies on or behind a cycle never appears.
    `arcs` has project_id, source, target, `keyed` by source; of repeated pairs all rows count, as needed and as met.
    `total` are its `incoming` links, if they are stored already.
    """
    needs = arcs.select("project_id", F.col("target").alias("node_id"), F.col("source").alias("need"))
    return saturate(None, needs, nodes=nodes, stored=True, total=total).withColumnRenamed("round", "depth")


def incoming(arcs: DataFrame) -> DataFrame:
    """(node_id, total): the links into each artifact that has some, `keyed` by node_id."""
    return keyed(arcs.groupBy(F.col("target").alias("node_id"), "project_id").agg(F.count(F.lit(1)).alias("total")), ["node_id", "project_id"], "totals")


def stored_arcs(edges: DataFrame) -> DataFrame:
    """(source, target), a row for each link, `keyed` by source."""
    return keyed(edges.select("project_id", "source", "target"), ["source", "project_id"], "arcs")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path depth; an artifact without inputs sits one layer before its first consumer."""
    arcs = stored_arcs(edges)
    depth, _ = cut(peel(nodes, arcs), "depth")
    pure = depth.where("depth = 0").select("project_id", F.col("node_id").alias("source"))
    first_use = (arcs.join(pure, ["source", "project_id"], "left_semi").join(depth.select("project_id", F.col("node_id").alias("target"), "depth"),
                           ["target", "project_id"])
                 .groupBy("project_id", F.col("source").alias("node_id")).agg(F.min("depth").alias("first")))
    key = ["node_id", "project_id"]
    pulled = F.when(F.col("first").isNotNull(), F.greatest(F.lit(0), F.col("first") - 1))
    return (depth.join(first_use, key, "left").select(*key, F.coalesce(pulled, F.col("depth")).cast("int").alias("depth")))


def find_cycles(edges: DataFrame) -> DataFrame:
    """Artifacts on a cycle or between two cycles; empty when the links form no cycle."""
    arcs = stored_arcs(edges)
    key = ["node_id", "project_id"]
    total = incoming(arcs)
    # without incoming links there is only what some link starts at
    starts = arcs.select("project_id", F.col("source").alias("node_id")).distinct()
    behind, _ = cut(total.select(*key).join(peel(starts, arcs, total), key, "left_anti"), "residue")
    kept = arcs
    for end in ("source", "target"):
        kept = kept.join(behind.select("project_id", F.col("node_id").alias(end)), [end, "project_id"], "left_semi")
    back = keyed(kept.select("project_id", F.col("target").alias("source"), F.col("source").alias("target")), ["source", "project_id"], "back")
    free = peel(behind, back)
    forget(arcs, total, back)
    return behind.join(free, key, "left_anti")


def between(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """The links (source, target) on a way from any of `starts` to any of `ends` (project_id, node_id).

    Two walks from all of them at once visit each artifact at most once, so questions about single pairs can be asked of
    what is left, usually little or nothing.
    """
    key = ["node_id", "project_id"]
    arcs = stored_arcs(edges)

    def walk(links: DataFrame, start: DataFrame, here: str, there: str) -> DataFrame:
        def step(frontier: DataFrame) -> DataFrame:
            return frontier.withColumnRenamed("node_id", here).join(links, [here, "project_id"]).select(
                "project_id", F.col(there).alias("node_id"))

        return fixpoint(start.select(*key), step, key, name="walk").select("project_id", F.col("node_id").alias(here))

    ahead = keyed(arcs.join(walk(arcs, starts, "source", "target"), ["source", "project_id"], "left_semi"), ["target", "project_id"], "ahead")
    way = cut(ahead.join(walk(ahead, ends, "target", "source"), ["target", "project_id"], "left_semi").distinct(), "between")[0]
    forget(arcs, ahead)
    return way


def cycle_violations(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """New links (edge_id, source, target) whose target already leads to their source."""
    starts = new_edges.select("project_id", F.col("target").alias("node_id"))
    ends = new_edges.select("project_id", F.col("source").alias("node_id"))
    way = between(edges, starts, ends)
    seeds = starts.withColumnRenamed("node_id", "seed").distinct().join(
        way.select("project_id", F.col("source").alias("seed")).distinct(), ["seed", "project_id"], "left_semi")
    paths = reachable(way, seeds, "down").select("project_id", F.col("seed").alias("target"),
                                                 F.col("node_id").alias("source"))
    closing = new_edges.join(paths, ["target", "source", "project_id"], "left_semi")
    return closing.unionByName(new_edges.where("source = target")).dropDuplicates(["edge_id", "project_id"])


def branch_family(branches: DataFrame) -> DataFrame:
    """(node_id, root): the original each alternative goes back to, by pointer jumping.

    `branches` has node_id and `of` (null for an original). Each round halves the way to the root, and
    only rows that have not arrived are joined again.
    """
    key = ["node_id", "project_id"]
    known = branches.select("project_id", F.col("node_id").alias("of"), F.lit(True).alias("known")).distinct()
    start = (branches.select(*key, "of").join(known, ["of", "project_id"], "left")
             .select(*key, F.when(F.col("known"), F.col("of")).alias("ptr")))
    state, seen = cut(start.withColumn("root", F.when(F.col("ptr").isNull(), F.col("node_id"))), "family",
                      counts={"moving": F.col("ptr").isNotNull()})
    done = state.where("root IS NOT NULL").select(*key, "root")
    for _ in range(64):
        if seen["moving"] == 0:
            return done
        moving = state.where("root IS NULL").select(*key, "ptr")
        arrived = done.select("project_id", F.col("node_id").alias("ptr"), "root")
        ahead = moving.select("project_id", F.col("node_id").alias("ptr"), F.col("ptr").alias("next"))
        state, seen = cut(moving.join(arrived, ["ptr", "project_id"], "left").join(ahead, ["ptr", "project_id"], "left")
                          .select(*key, F.coalesce("next", "ptr").alias("ptr"), "root"),
                          "family", counts={"moving": F.col("root").isNull()})
        done = done.unionByName(state.where("root IS NOT NULL").select(*key, "root"))
    raise RuntimeError("branch_family: a family loops back to itself")


def removal_plan(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node_id, wave): what goes when the artifacts of a seed are removed; wave 0 are those artifacts.

    `seeds` has seed (a name for the what-if) and node_id; many what-ifs run at once.

    An artifact follows (wave 1) when every neighbour is gone and one of the gone ones leads to it. There is no wave 2: what
    follows has only removed neighbours, so it is no neighbour of anything that stays. One counted join answers all what-ifs;
    neighbours that have more neighbours than a what-if has artifacts can't follow and are not counted.
    """
    key, gone_key = ["node_id", "project_id"], ["node_id", "seed", "project_id"]
    there = edges.select("project_id", F.col("source").alias("node_id"), F.col("target").alias("next"), F.lit(1).alias("into"))
    back = edges.select("project_id", F.col("target").alias("node_id"), F.col("source").alias("next"), F.lit(0).alias("into"))
    pairs, _ = cut(there.unionByName(back).groupBy(*key, "next").agg(F.max("into").alias("into")), "around")
    gone, _ = cut(seeds.select(*gone_key).distinct(), "gone")
    sizes = gone.groupBy("project_id", "seed").agg(F.count(F.lit(1)).alias("size"))
    sized, asked = cut(gone.join(sizes, ["seed", "project_id"]), "sized", ends="size")
    # what can follow at all has an incoming link, and no more neighbours than the largest what-if has artifacts
    degree, able = cut(pairs.groupBy("project_id", "next").agg(F.count(F.lit(1)).alias("degree"), F.max("into").alias("fed")).where(
        (F.col("fed") == 1) & (F.col("degree") <= F.lit(asked["greatest"]))).drop("fed"), "degree")
    around, _ = cut(pairs.join(if_few(degree, able["rows"]), ["next", "project_id"]), "countable")
    forget(pairs, degree)
    lost = (if_few(sized, asked["rows"]).join(around, key).where("degree <= size")
            .groupBy("project_id", "seed", F.col("next").alias("node_id"))
            .agg(F.count(F.lit(1)).alias("lost"), F.max("into").alias("into"), F.max("degree").alias("degree")))
    follows = lost.where("lost = degree AND into = 1").join(gone, gone_key, "left_anti")
    return gone.withColumn("wave", F.lit(0)).unionByName(follows.select(*gone_key, F.lit(1).alias("wave")))


def removal_effects(edges: DataFrame, plan: DataFrame) -> dict[str, DataFrame]:
    """What else a removal plan touches: links lost, artifacts left without links, script references."""
    gone = plan.select("project_id", "seed", "node_id")
    by_end = [gone.withColumnRenamed("node_id", end).join(edges, [end, "project_id"])
              .select("project_id", "seed", "edge_id", "source", "target", "rel") for end in ("source", "target")]
    lost = by_end[0].unionByName(by_end[1]).dropDuplicates(["edge_id", "seed", "project_id"])
    ends = lost.select("project_id", "seed", F.explode(F.array("source", "target")).alias("node_id"))
    lost_links = ends.groupBy("project_id", "seed", "node_id").agg(F.count(F.lit(1)).alias("lost"))
    all_links = (edges.select("project_id", F.explode(F.array("source", "target")).alias("node_id"))
                 .groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("links")))
    orphaned = (lost_links.join(gone, ["node_id", "seed", "project_id"], "left_anti")
                .join(all_links, ["node_id", "project_id"]).where("lost = links")
                .select("project_id", "seed", "node_id"))
    out = {"edges": lost, "orphaned": orphaned}
    if "script" in edges.columns:
        out["script_refs"] = (gone.withColumnRenamed("node_id", "script").join(edges, ["script", "project_id"])
                              .join(lost.select("project_id", "seed", "edge_id"),
                                    ["edge_id", "seed", "project_id"], "left_anti")
                              .select("project_id", "seed", "edge_id"))
    return out


def apply_removal(table: DataFrame, gone: DataFrame, columns: list[str], clear: list[str] = ()) -> DataFrame:
    """`table` without rows that name a removed artifact in `columns`; references in `clear` become null."""
    removed, seen = cut(gone.select("project_id", "node_id").distinct(), "removed")
    removed = if_few(removed, seen["rows"])
    for column in columns:
        table = table.join(removed.withColumnRenamed("node_id", column), [column, "project_id"], "left_anti")
    for column in clear:
        names = table.columns
        table = (table.join(removed.select("project_id", F.col("node_id").alias(column), F.lit(True).alias("_gone")),
                            [column, "project_id"], "left")
                 .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*names))
    return table


def without_removed(lists: DataFrame, owner: str, members: str, gone: DataFrame) -> DataFrame:
    """Rows (owner, member) of listings such as analyses and notes, without removed artifacts."""
    removed = gone.select("project_id", F.col("node_id").alias(members)).distinct()
    return lists.select("project_id", owner, members).join(removed, [members, "project_id"], "left_anti")


def article_of(nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(node_id, article): the smallest article id downstream of each artifact, over all but loose links.

    Ids travel upstream from the articles; an artifact is visited again only when a smaller id arrives. `links` are stored
    `typed_links`, best `keyed` by target; ways over artifacts that `nodes` lacks don't count then.
    """
    key = ["node_id", "project_id"]
    articles, seen = cut(nodes.where("type = 'article'").select(*key, "label"), "articles")
    if links is None:
        arcs = keyed(edges.where(~F.col("rel").isin(SOFT_RELS)).select(
            "project_id", F.col("target").alias("node_id"), F.col("source").alias("next")), key, "arcs")
    else:
        arcs = links.select("project_id", F.col("target").alias("node_id"), F.col("source").alias("next"))
    # an article belongs to itself, whatever lies behind it
    own = if_few(articles.select(*key), seen["rows"])

    def step(frontier: DataFrame, ends: tuple[Column, Column]) -> DataFrame:
        return frontier.join(arcs.where(F.col("node_id").between(*ends)), key).select(
            "project_id", F.col("next").alias("node_id"), "article").join(own, key, "left_anti")

    met = fixpoint(articles.select(*key, F.col("node_id").alias("article")), step, key, name="article", value=least("article"), ends="node_id")
    if links is None:
        forget(arcs)
    # the labels of articles only, and at the found ids: an article leads to very many artifacts
    labels = if_few(articles.select("project_id", F.col("node_id").alias("article"), F.col("label").alias("article_label")), seen["rows"])
    best = met.groupBy(*key).agg(F.min("article").alias("article")).join(labels, ["article", "project_id"])
    return nodes.select(*key).join(best, key, "left").select(*key, F.coalesce("article_label", F.lit("(no article)")).alias("article"))


def visible_graph(nodes: DataFrame, edges: DataFrame, hidden_types: list[str] = (), show_refs: bool = True,
                  show_code: bool = True, hidden: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts that stay in view and the links between them."""
    keep = nodes
    if hidden_types:
        keep = keep.where(~F.col("type").isin(list(hidden_types)))
    if not show_refs:
        keep = keep.where(~((F.col("mode") == "ref") & F.col("type").isin("result", "table", "figure")))
    if hidden is not None:
        keep = keep.join(hidden.select("project_id", "node_id").distinct(), ["node_id", "project_id"], "left_anti")
    ids = keep.select("project_id", "node_id")
    links = edges if show_code else edges.where("rel <> 'code'")
    for end in ("source", "target"):
        links = links.join(ids.withColumnRenamed("node_id", end), [end, "project_id"], "left_semi")
    return keep, links
