"""Which artifacts are stale, kept up to date after saves and confirmations.

The verdict is kept as marks (`Staleness.marks`) and seeds, the artifacts that are stale by themselves. A change of some versions or
recorded inputs can only change the seeds around them. Marks that rested on lost seeds are deleted downstream; those
that another seed or mark still supports are derived again, and the marks of new seeds are added. Support in circles does not keep a
mark alive. Work and writing follow the marks that change and the seeds around the change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.graph import effective_children, effective_parents, typed_links
from strandline.operators.staleness import Staleness, passed_marks
from strandline.plans import cut, fixpoint, path_exists

P = "project_id"
NODE = ["project_id", "node_id"]
MARK = [*NODE, "mark"]
LOG = "project_id STRING, node_id STRING, mark STRING, on BOOLEAN, batch BIGINT"


def _at(df: DataFrame, column: str, name: str = "node_id") -> DataFrame:
    return df.select(P, F.col(column).alias(name))


def seeds_around(nodes: DataFrame, edges: DataFrame, recorded: DataFrame, links: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, seeds): the artifacts whose being a seed may depend on the versions or recorded inputs of `changed` (node_id),
    and those of them that are seeds now."""
    own = changed.select(*NODE).distinct()
    builds = recorded.join(_at(own, "node_id", "parent_id"), [P, "parent_id"], "left_semi").select(*NODE)
    data, _ = cut(own.unionByName(builds).distinct(), "upkeep-data")
    makers, _ = cut(_at(effective_parents(nodes, edges, data, links).where("process"), "parent_id").distinct(), "upkeep-makers")
    placed = _at(edges.where("rel = 'part_of' AND placed_version IS NOT NULL").join(_at(own, "node_id", "source"), [P, "source"], "left_semi"), "target")
    region, _ = cut(data.unionByName(makers).unionByName(placed).distinct(), "upkeep-region")
    # a process is a seed through anything that it made
    made = effective_children(links, _at(makers, "node_id", "maker"), "maker").select(*NODE)
    watched = data.unionByName(made).distinct()
    into = edges.join(_at(region, "node_id", "target"), [P, "target"], "left_semi")
    verdict = Staleness(nodes, into, recorded.join(watched, NODE, "left_semi"), links=links)
    seeds, _ = cut(verdict.seeds().join(region, NODE, "left_semi").distinct(), "upkeep-seeds")
    return region, seeds


def changed_marks(nodes: DataFrame, edges: DataFrame, recorded: DataFrame, links: DataFrame, changed: DataFrame, marks: DataFrame) -> DataFrame:
    """(node_id, mark, on): what a change of `changed` (node_id) does to `marks` (node_id, mark: seed, stale or carries).

    `nodes` and `recorded` are the tables after the change, `links` stored `typed_links`.
    """
    region, now = seeds_around(nodes, edges, recorded, links, changed)
    seeds, spread = marks.where("mark = 'seed'").select(*NODE), marks.where("mark <> 'seed'")
    lost, n_lost = cut(seeds.join(region, NODE, "left_semi").join(now, NODE, "left_anti"), "upkeep-lost")
    fresh, _ = cut(now.join(seeds, NODE, "left_anti"), "upkeep-fresh")
    follow = lambda frontier: passed_marks(frontier, links)
    gone = fixpoint(lost.withColumn("mark", F.lit("stale")), follow, MARK, name="upkeep-gone").select(*MARK)
    again = fresh
    back = fresh.withColumn("mark", F.lit("stale"))
    if n_lost["rows"]:
        again = fresh.unionByName(seeds.join(lost, NODE, "left_anti"))
        into_gone = links.join(_at(gone.distinct(), "node_id", "target").distinct(), [P, "target"], "left_semi")
        sources = spread.join(_at(into_gone, "source").distinct(), NODE, "left_semi").join(gone, MARK, "left_anti")
        supported = passed_marks(sources, into_gone).join(gone, MARK, "left_semi")
        back = back.unionByName(again.withColumn("mark", F.lit("stale")).join(gone, MARK, "left_semi")).unionByName(supported)

    def kept(candidates: DataFrame) -> DataFrame:
        """Without the marks that are there anyway."""
        there = spread.join(candidates, MARK, "left_semi").join(gone, MARK, "left_anti")
        return candidates.join(there, MARK, "left_anti")

    derived = fixpoint(kept(back.distinct()), lambda frontier: kept(follow(frontier).distinct()), MARK, name="upkeep-derived").select(*MARK)
    on, off = F.lit(True).alias("on"), F.lit(False).alias("on")
    return (gone.join(derived, MARK, "left_anti").select(*MARK, off).unionByName(derived.join(gone, MARK, "left_anti").select(*MARK, on))
            .unionByName(lost.select(*NODE, F.lit("seed").alias("mark"), off)).unionByName(fresh.select(*NODE, F.lit("seed").alias("mark"), on)))


def current_marks(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(node_id, mark) after all micro-batches below `before`: the newest full table and the changes since."""
    base = _newest_base(spark, path, before)
    parts = [spark.read.schema(LOG).parquet(f"{path}/{kind}") for kind in ("base", "changes") if path_exists(spark, f"{path}/{kind}")]
    if not parts:
        return spark.createDataFrame([], "project_id STRING, node_id STRING, mark STRING")
    upto = F.lit(True) if before is None else F.col("batch") < before
    rows = parts[0].where(F.col("batch") == base)
    if len(parts) > 1:
        rows = rows.unionByName(parts[1].where((F.col("batch") > base) & upto))
    return rows.groupBy(*MARK).agg(F.max_by("on", "batch").alias("on")).where("on").drop("on")


def _newest_base(spark: SparkSession, path: str, before: int | None) -> int | None:
    if not path_exists(spark, f"{path}/base"):
        return None
    told = spark.read.schema(LOG).parquet(f"{path}/base").where("mark IS NULL")  # the line that says that a full table is there
    return told.where(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch")).first()[0]


def _write_base(marks: DataFrame, path: str, n: int) -> None:
    none = F.lit(None).cast("string")
    line = marks.sparkSession.range(1).select(none.alias(P), none.alias("node_id"), none.alias("mark"), F.lit(False).alias("on"))
    marks.select(*MARK, F.lit(True).alias("on")).unionByName(line).write.mode("overwrite").parquet(f"{path}/base/batch={n}")


def upkeep_batch(read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch over saved or confirmed artifacts (project_id, node_id): keep `current_marks` and `stale_now` of `path` right.

    `read` returns nodes, edges and recorded inputs as they are now. The first micro-batch writes all marks and the links of the
    network; a network with other links or types needs another path. Later ones write `path`/changes/batch=n, and all marks anew only
    when the changes since the last time outnumber them. Repeating a micro-batch replaces what it wrote.
    """
    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        nodes, edges, recorded = read()
        base = _newest_base(spark, path, n)
        if base is None:
            typed_links(nodes, edges).write.mode("overwrite").parquet(f"{path}/links")
            links = spark.read.parquet(f"{path}/links")
            verdict = Staleness(nodes, edges, recorded, links=links)
            seeds = verdict.seeds().distinct().withColumn("mark", F.lit("seed"))
            _write_base(verdict.marks().select(*MARK).unionByName(seeds), path, n)
            return
        links, marks = spark.read.parquet(f"{path}/links"), current_marks(spark, path, n)
        if path_exists(spark, f"{path}/changes"):
            log = spark.read.schema(LOG).parquet(f"{path}/changes").where((F.col("batch") > base) & (F.col("batch") < n))
            if log.count() > spark.read.schema(LOG).parquet(f"{path}/base").where(F.col("batch") == base).count():
                _write_base(marks, path, n - 1)
                marks = current_marks(spark, path, n)
        changed_marks(nodes, edges, recorded, links, batch, marks).write.mode("overwrite").parquet(f"{path}/changes/batch={n}")

    return run


def stale_now(spark: SparkSession, path: str) -> DataFrame:
    """(node_id) of everything out of date."""
    return current_marks(spark, path).where("mark = 'stale'").select(*NODE)
