"""Which artifacts are out of date, why, and what a change or a confirmation does to that.

`recorded` has node_id, parent_id, recorded: what the newest version of node_id was built from.
A missing number (null) says nothing about staleness.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import effective_children, effective_parents, is_process, peel, stored_arcs, typed_links
from strandline.plans import cut, fixpoint, forget, keyed, merge_spans
from strandline.vocab import HARD_RELS, SOFT_RELS

NODE = ["node_id", "project_id"]
LINK = ["edge_id", "project_id"]


def disk_state(versions: DataFrame, disk: DataFrame) -> DataFrame:
    """missing / modified per artifact with a file, from its newest version if `versions` has numbers `v`.

    Equal known sizes and times, or equal known hashes, mean unchanged. Otherwise a recorded hash is needed to say
    modified, and a hash of the file, or as long as it has none, a size that differs.
    """
    if "v" in versions.columns:
        versions = versions.groupBy(*NODE).agg(F.max_by(F.struct("path", "size", "mtime", "hash"), "v").alias("_n")).select(*NODE, "_n.*")
    now = disk.select("project_id", "path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"),
                      F.col("hash").alias("hash_now"), F.lit(True).alias("_there"))
    no = F.lit(False)
    same = F.coalesce((F.col("size") == F.col("size_now")) & (F.col("mtime") == F.col("mtime_now")), no) | F.coalesce(
        F.col("hash") == F.col("hash_now"), no)
    told = F.col("hash_now").isNotNull() | F.coalesce(F.col("size") != F.col("size_now"), no)
    there = F.coalesce("_there", no)
    return versions.where("path IS NOT NULL").join(now, ["path", "project_id"], "left").select(
        *NODE, (~there).alias("missing"), (there & ~same & F.col("hash").isNotNull() & told).alias("modified"))


def outdated_inputs(nodes: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded inputs that have moved on since: (node_id, parent_id, recorded, now). Usually few."""
    now = nodes.select("project_id", F.col("node_id").alias("parent_id"), F.col("current_version").alias("now"))
    return (recorded.where("recorded IS NOT NULL").join(now, ["parent_id", "project_id"])
            .where("now IS NOT NULL AND recorded <> now"))


def passed_marks(marks: DataFrame, links: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, mark) that follow from `marks` (node_id, mark) over one typed link each, with the columns `carry`."""
    stale = F.col("mark") == "stale"
    data_source = stale & ~F.col("from_process")
    passes = data_source | ((F.col("mark") == "carries") & F.col("from_process"))
    now_stale = ((F.col("hard") & ~F.col("to_process") & passes)
                 | (~F.col("hard") & ~F.col("to_process") & stale)
                 | (F.col("to_process") & data_source))
    now_carries = F.col("hard") & F.col("to_process") & passes
    found = F.array_compact(F.array(F.when(now_stale, F.lit("stale")), F.when(now_carries, F.lit("carries"))))
    return marks.join(links.withColumnRenamed("source", "node_id"), NODE).select(
        "project_id", F.col("target").alias("node_id"), F.explode(found).alias("mark"), *carry)


class Staleness:
    """One evaluation of the staleness rules; the expensive tables are written once and shared."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, recorded: DataFrame, also_stale: DataFrame | None = None,
                 links: DataFrame | None = None):
        """`also_stale` (node_id) are artifacts known to be stale for reasons outside these tables.

        `links` are stored `typed_links`; with them nothing of the size of the network is written, which suits questions about
        few artifacts.
        """
        self.edges, self.also_stale, self.links = edges, also_stale, links
        # the few columns the rules need
        self.nodes = nodes.select(*NODE, "type", F.col("current_version").cast("int").alias("current_version"),
                                  F.col("final_version").cast("int").alias("final_version"))
        if links is None:
            self.nodes, _ = cut(self.nodes, "nodes")
        self.recorded = recorded

    @cached_property
    def moved(self) -> DataFrame:
        return cut(outdated_inputs(self.nodes, self.recorded), "moved")[0]

    @cached_property
    def typed(self) -> DataFrame:
        """`typed_links`, by target: their second join leaves them in this order."""
        return self.links if self.links is not None else keyed(typed_links(self.nodes, self.edges), ["target", "project_id"], "links")

    @cached_property
    def onward(self) -> DataFrame:
        """The same links by source, for what walks down."""
        return self.links if self.links is not None else keyed(self.typed, ["source", "project_id"], "onward")

    @cached_property
    def parents(self) -> DataFrame:
        """Effective parents of the artifacts with a moved input: no others are needed."""
        return effective_parents(self.nodes, self.edges, self.moved, self.typed)

    def stale_placements(self) -> DataFrame:
        """Placed components whose final (else current) version is another one by now."""
        wanted = self.nodes.select("project_id", F.col("node_id").alias("source"), "current_version",
                                   F.coalesce("final_version", "current_version").alias("wanted"))
        return (self.edges.where("rel = 'part_of' AND placed_version IS NOT NULL")
                .join(wanted, ["source", "project_id"])
                .where("current_version IS NOT NULL AND wanted <> placed_version")
                .select(*LINK, "source", "target", "rel", F.col("placed_version").alias("from_v"),
                        F.col("wanted").alias("to_v")))

    @cached_property
    def _moved_pairs(self) -> DataFrame:
        """(source, target, from_v, to_v): what target, or something that the process target made, was built from."""
        moved = self.moved.select("project_id", "node_id", F.col("parent_id").alias("source"),
                                  F.col("recorded").alias("from_v"), F.col("now").alias("to_v"))
        data = self.nodes.where(~is_process("type")).select(*NODE)
        into_data = moved.join(data, NODE, "left_semi").withColumnRenamed("node_id", "target")
        into_process = (moved.join(self.parents.where("process").select(
            *NODE, F.col("parent_id").alias("target")), NODE).drop("node_id"))
        return cut(into_data.unionByName(into_process).groupBy("project_id", "source", "target").agg(
            F.max("from_v").alias("from_v"), F.max("to_v").alias("to_v")), "moved-pairs")[0]

    @cached_property
    def _stale_links(self) -> DataFrame:
        hard = self.edges.where(F.col("rel").isin(HARD_RELS)).select(*LINK, "source", "target", "rel")
        stale = hard.join(self._moved_pairs, ["target", "source", "project_id"]).select(
            *LINK, "source", "target", "rel", "from_v", "to_v")
        return cut(stale.unionByName(self.stale_placements()), "stale-links")[0]

    def stale_links(self) -> DataFrame:
        """Stale links: the target, or something the target process made, was built from an older source."""
        return self._stale_links

    @cached_property
    def _direct(self) -> DataFrame:
        data = self.nodes.where(~is_process("type")).select(*NODE)
        return cut(self.moved.join(self.parents.select(*NODE, "parent_id"), [*NODE, "parent_id"], "left_semi")
                   .join(data, NODE, "left_semi"), "direct")[0]

    def direct(self) -> DataFrame:
        """Data artifacts with an effective parent that moved on: (node_id, parent_id, recorded, now)."""
        return self._direct

    def seeds(self) -> DataFrame:
        """(node_id) of what is stale by itself, not through another stale artifact; repeats are harmless."""
        # whether a link is there tells the stored table, without the names of the links
        into_process = self.typed.where("hard AND to_process").select("project_id", "source", "target")
        seed = self.direct().select(*NODE).unionByName(
            self.stale_placements().select("project_id", F.col("target").alias("node_id"))).unionByName(
            self._moved_pairs.join(into_process, ["target", "source", "project_id"], "left_semi")
            .select("project_id", F.col("target").alias("node_id")))
        if self.also_stale is not None:
            seed = seed.unionByName(self.also_stale.select(*NODE))
        return seed

    def marks(self) -> DataFrame:
        """(node_id, mark): 'stale', or 'carries' for a process behind which a stale input lies.

        A stale input reaches data behind any number of processes, while the processes themselves
        are only flagged next to it. Carrying marks keeps the work at one visit per link.
        """
        return fixpoint(self.seeds().withColumn("mark", F.lit("stale")), lambda frontier: passed_marks(frontier, self.onward),
                        [*NODE, "mark"], name="stale")

    @cached_property
    def _stale_nodes(self) -> DataFrame:
        return self.marks().where("mark = 'stale'").select(*NODE)

    def stale_nodes(self) -> DataFrame:
        """(node_id) of everything out of date."""
        return self._stale_nodes

    def reasons(self) -> DataFrame:
        """One row per artifact and cause: (node_id, kind, src, from_v, to_v).

        The first rule that fits an input wins: it moved on, else it is stale itself.
        """
        nothing = F.lit(None).cast("int")
        kinds = self.nodes.select(*NODE, is_process("type").alias("process"))
        stale = self.stale_nodes().join(kinds, NODE)
        moved = self.direct().select(*NODE, F.lit("input_moved").alias("kind"), F.col("parent_id").alias("src"),
                                     F.col("recorded").cast("int").alias("from_v"), F.col("now").cast("int").alias("to_v"))
        sources = stale.where("NOT process").select("project_id", F.col("node_id").alias("src"))
        behind = effective_children(self.onward, sources, "src")
        upstream = (behind.join(self.direct().select(*NODE, F.col("parent_id").alias("src")), [*NODE, "src"], "left_anti")
                    .select(*NODE, F.lit("upstream_stale").alias("kind"), "src", nothing.alias("from_v"),
                            nothing.alias("to_v")))
        links = self.stale_links()
        to_data = kinds.where("NOT process").select("project_id", F.col("node_id").alias("target"))
        to_process = kinds.where("process").select("project_id", F.col("node_id").alias("target"))
        newer = (links.where("rel = 'part_of'").join(to_data, ["target", "project_id"], "left_semi").select(
            "project_id", F.col("target").alias("node_id"), F.lit("component_newer").alias("kind"),
            F.col("source").alias("src"), "from_v", "to_v"))
        fresh = self.edges.where(~F.col("rel").isin(SOFT_RELS)).join(links.select(*LINK), LINK, "left_anti").select(
            "project_id", F.col("source").alias("node_id"), "target", "rel")
        placed = (fresh.where("rel = 'part_of'").join(to_data, ["target", "project_id"], "left_semi")
                  .join(stale.select(*NODE), NODE, "left_semi").select(
                      "project_id", F.col("target").alias("node_id"), F.lit("component_stale").alias("kind"),
                      F.col("node_id").alias("src"), nothing.alias("from_v"), nothing.alias("to_v")))
        rerun = (links.join(to_process, ["target", "project_id"], "left_semi").select(
            "project_id", F.col("target").alias("node_id"), F.lit("rerun_needed").alias("kind"),
            F.col("source").alias("src"), nothing.alias("from_v"), nothing.alias("to_v")))
        waiting = (fresh.join(to_process, ["target", "project_id"], "left_semi")
                   .join(stale.where("NOT process").select(*NODE), NODE, "left_semi").select(
                       "project_id", F.col("target").alias("node_id"), F.lit("upstream_stale").alias("kind"),
                       F.col("node_id").alias("src"), nothing.alias("from_v"), nothing.alias("to_v")))
        out = moved
        for part in (upstream, newer, placed, rerun, waiting):
            out = out.unionByName(part)
        return out.distinct()


def node_state(nodes: DataFrame, stale: DataFrame, disk: DataFrame) -> DataFrame:
    """One state per artifact: missing before stale before modified before ok."""
    disk, _ = cut(disk.select(*NODE, "missing", "modified"), "disk")
    flagged = nodes.select(*NODE).join(stale.withColumn("stale", F.lit(True)), NODE, "left").join(disk, NODE, "left")
    state = (F.when(F.col("missing"), "missing").when(F.col("stale"), "stale")
             .when(F.col("modified"), "modified").otherwise("ok"))
    return flagged.select(*NODE, state.alias("state"))


def rebuild_order(nodes: DataFrame, edges: DataFrame, stale: DataFrame) -> DataFrame:
    """(node_id, place) of the artifacts `stale` (node_id): what has a lower place is rebuilt first, equal places do not wait
    for each other. Places are without holes in each project."""
    arcs = stored_arcs(edges)
    depth, _ = cut(peel(nodes, arcs).join(stale.select(*NODE), NODE, "left_semi"), "stale-depth")
    forget(arcs)
    # depths are few: ranking them, not the artifacts
    places = depth.select("project_id", "depth").distinct().withColumn(
        "place", F.row_number().over(Window.partitionBy("project_id").orderBy("depth")))
    return depth.join(places, ["depth", "project_id"]).select(*NODE, "place")


def with_current(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """`nodes` after new versions were saved: changes has node_id, new_version."""
    return (nodes.join(changes.select(*NODE, "new_version"), NODE, "left")
            .withColumn("current_version", F.coalesce("new_version", "current_version")).drop("new_version"))


def impact_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """Artifacts that are stale after a change and were not before."""
    return after.select(*NODE).join(before.select(*NODE), NODE, "left_anti")


def apply_confirmations(nodes: DataFrame, edges: DataFrame, recorded: DataFrame, confirmations: DataFrame,
                        modified: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Newest versions declared valid for the current inputs: (recorded after, refused requests).

    `confirmations` has node_id, why and parent_id (null: all effective parents). Refused are requests
    without a reason, about a process, about an artifact without versions or with an unsaved change,
    and requests naming an input the artifact is not built from.
    """
    kinds = nodes.select(*NODE, is_process("type").alias("process"), F.col("current_version").alias("has"))
    asked = confirmations.join(kinds, NODE, "left")
    if modified is not None:
        asked = asked.join(modified.select(*NODE, F.lit(True).alias("dirty")), NODE, "left")
    else:
        asked = asked.withColumn("dirty", F.lit(False))
    parents = effective_parents(nodes, edges, confirmations).select(*NODE, "parent_id")
    named = parents.withColumn("known", F.lit(True))
    asked = asked.join(named, [*NODE, "parent_id"], "left")
    problem = (F.when(F.trim(F.coalesce("why", F.lit(""))) == "", "no reason").when(F.col("has").isNull(), "no versions")
               .when(F.col("process"), "process").when(F.col("dirty"), "changed on disk")
               .when(F.col("parent_id").isNotNull() & F.col("known").isNull(), "not an input"))
    # written step by step, so the shuffles of one join are on the disks at a time
    asked, _ = cut(asked.withColumn("problem", problem).select(*NODE, "parent_id", "problem"), "asked")
    refused = asked.where("problem IS NOT NULL").select(*NODE, "parent_id", "problem")
    good = asked.join(refused.select(*NODE).distinct(), NODE, "left_anti")
    every = good.where("parent_id IS NULL").select(*NODE).distinct().join(parents, NODE)
    chosen = every.unionByName(good.where("parent_id IS NOT NULL").select(*NODE, "parent_id")).distinct()
    now = nodes.select("project_id", F.col("node_id").alias("parent_id"), F.col("current_version").alias("now"))
    key = [*NODE, "parent_id"]
    moved, _ = cut(chosen.join(now, ["parent_id", "project_id"]).where("now IS NOT NULL").select(*key, "now"), "confirmed")
    forget(parents)
    after, _ = cut(recorded.select(*key, "recorded").join(moved, key, "full_outer")
                   .select(*key, F.coalesce("now", "recorded").cast("int").alias("recorded")), "recorded")
    forget(moved)
    return after, refused


def adopt_parents(nodes: DataFrame, edges: DataFrame, recorded: DataFrame, touched: DataFrame) -> DataFrame:
    """Recorded inputs after new links: effective parents not recorded yet enter with their current version."""
    versioned = nodes.where("current_version IS NOT NULL").select(*NODE)
    fresh = effective_parents(nodes, edges, touched.join(versioned, NODE, "left_semi")).select(*NODE, "parent_id")
    now = nodes.select("project_id", F.col("node_id").alias("parent_id"), F.col("current_version").alias("recorded"))
    key = [*NODE, "parent_id"]
    added = fresh.join(recorded.select(*key), key, "left_anti").join(now, ["parent_id", "project_id"]).select(
        *key, F.col("recorded").cast("int").alias("recorded"))
    return recorded.select(*key, "recorded").unionByName(added)


def version_asof(versions: DataFrame, when: Column) -> DataFrame:
    """Newest version number per artifact at a point in time."""
    return (versions.where(F.col("ts") <= when).groupBy(*NODE)
            .agg(F.max("v").cast("int").alias("current_version")))


def version_spans(versions: DataFrame) -> DataFrame:
    """(node_id, v, since, until): when each version (node_id, v, ts) was the newest one. Times must not decrease along the numbers."""
    forever = F.lit("9999-12-31 00:00:00").cast(versions.schema["ts"].dataType)
    after = versions.select(*NODE, (F.col("v") - 1).cast("int").alias("v"), F.col("ts").alias("until"))
    spans = versions.select(*NODE, F.col("v").cast("int").alias("v"), F.col("ts").alias("since")).join(after, [*NODE, "v"], "left")
    return spans.withColumn("until", F.coalesce("until", forever)).where("since < until")


def _another_version(asked: DataFrame, spans: DataFrame, first: DataFrame) -> DataFrame:
    """`asked` (parent_id, wanted, since, until, ...) cut to the times when parent_id has versions and the newest is not `wanted`.

    That is all of its time but the span of one version: two pieces at most, found by equi-joins.
    """
    wanted = spans.select("project_id", F.col("node_id").alias("parent_id"), F.col("v").alias("wanted"), F.col("since").alias("_s"), F.col("until").alias("_u"))
    begin = first.select("project_id", F.col("node_id").alias("parent_id"), F.col("since").alias("_first"))
    met = asked.join(begin, ["parent_id", "project_id"]).join(wanted, ["wanted", "parent_id", "project_id"], "left")
    since = F.greatest("since", "_first")
    pieces = F.array(F.struct(since.alias("since"), F.least("until", F.coalesce("_s", "until")).alias("until")),
                     F.struct(F.greatest(since, F.coalesce("_u", "until")).alias("since"), F.col("until").alias("until")))
    rest = [c for c in asked.columns if c not in ("since", "until")]
    return met.select(*rest, F.explode(pieces).alias("p")).select(*rest, "p.since", "p.until").where("since < until")


def staleness_spans(nodes: DataFrame, edges: DataFrame, versions: DataFrame, recorded: DataFrame) -> DataFrame:
    """(node_id, since, until): when each artifact was out of date, at every moment in one run.

    `versions` has node_id, v, ts; `recorded` has node_id, v, parent_id, recorded: what version v was built from. The network, final
    versions and placements are taken as they are. Seeds get the times at which an input was another version than the
    recorded one, and carry them along the links; a link is followed again only for times that are new to its target.
    """
    spans, _ = cut(version_spans(versions), "spans")
    first = spans.groupBy(*NODE).agg(F.min("since").alias("since"))
    end = F.lit("9999-12-31 00:00:00").cast(spans.schema["until"].dataType)
    kinds, _ = cut(nodes.select(*NODE, "type", "final_version"), "nodes")
    links = keyed(typed_links(kinds, edges), ["target", "project_id"], "links")
    onward = keyed(links, ["source", "project_id"], "onward")
    built = recorded.where("recorded IS NOT NULL").select(*NODE, F.col("v").cast("int").alias("v"), "parent_id", F.col("recorded").cast("int").alias("wanted"))
    moved, _ = cut(_another_version(built.join(spans, [*NODE, "v"]).drop("v"), spans, first).drop("wanted"), "moved")
    parents = effective_parents(kinds, edges, moved, links)
    data = kinds.where(~is_process("type")).select(*NODE)
    direct = moved.join(parents.select(*NODE, "parent_id"), [*NODE, "parent_id"], "left_semi").join(data, NODE, "left_semi")
    hard = edges.where(F.col("rel").isin(HARD_RELS)).select("project_id", F.col("source").alias("parent_id"), F.col("target").alias("made_by")).distinct()
    reruns = moved.join(parents.where("process").select(*NODE, F.col("parent_id").alias("made_by")), NODE).join(
        hard, ["made_by", "parent_id", "project_id"], "left_semi").select("project_id", F.col("made_by").alias("node_id"), "since", "until")
    # a placed component with a final version is compared with that one as soon as it has versions
    placed = (edges.where("rel = 'part_of' AND placed_version IS NOT NULL").select("project_id", F.col("source").alias("parent_id"), F.col("target").alias("node_id"), F.col("placed_version").cast("int").alias("wanted"))
              .join(kinds.select("project_id", F.col("node_id").alias("parent_id"), "final_version"), ["parent_id", "project_id"])
              .join(first.select("project_id", F.col("node_id").alias("parent_id"), "since"), ["parent_id", "project_id"]).withColumn("until", end))
    newer = placed.where("final_version <> wanted").unionByName(
        _another_version(placed.where("final_version IS NULL"), spans, first))
    seeds = direct.select(*NODE, "since", "until").unionByName(reruns).unionByName(newer.select(*NODE, "since", "until"))
    time = ("since", "until")
    marks = fixpoint(seeds.select(*NODE, F.lit("stale").alias("mark"), *time), lambda frontier: passed_marks(frontier, onward, time),
                     [*NODE, "mark"], name="stale-spans", span=time)
    return merge_spans(marks.where("mark = 'stale'"), NODE, *time)


def staleness_asof(spans: DataFrame, when: Column) -> DataFrame:
    """(node_id) of what was out of date at a moment, from `staleness_spans`."""
    return spans.where((F.col("since") <= when) & (when < F.col("until"))).select(*NODE)
