"""What a step leaves on the disks, and how large an unspillable hash table may get."""

import os
import time
from urllib.parse import urlparse

from conftest import as_set
from pyspark.sql import functions as F
from strandline.operators import dedup, graph, staleness, summary
from strandline.plans import Known, cut, forget, keyed, materialize, measured_joins, new_folder


def shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(i).toString() for i in range(blocks.size()) if blocks.apply(i).isShuffle()}


def test_a_step_removes_its_shuffles(spark):
    rows = spark.range(5000).selectExpr("'p' AS project_id", "concat('n', id % 700) AS node_id")
    before = shuffles(spark)
    stored, seen = cut(rows.groupBy("node_id").count(), "test")
    arcs = keyed(rows, ["node_id", "project_id"], "test")
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert seen["rows"] == stored.count() == 700 and arcs.count() == 5000
    assert spark.conf.get(materialize.CLEANUP) == "false"


def test_forgotten_tables_leave_no_files(spark):
    path = new_folder(spark, "test")
    stored, _ = cut(spark.range(10).toDF("n"), path=path)
    arcs = keyed(spark.range(10).toDF("n"), ["n"], "test")
    folders = {urlparse(f).path.rpartition("/")[0] for f in arcs.inputFiles()} | {urlparse(path).path}
    assert len(folders) == 2 and all(map(os.path.isdir, folders))
    forget(stored, arcs)
    assert not any(map(os.path.exists, folders))
    known = Known(spark, "test", ["n"], merge_rows=5)
    for lo in (0, 10, 40):
        path = new_folder(spark, "test")
        known.add(cut(spark.range(lo, lo + 10).toDF("n"), path=path)[0], path, 10)
    base = urlparse(known.base).path
    assert len(os.listdir(base)) == len(known.tables) == 1  # merged tables are gone
    known.close()
    assert os.listdir(base) == []


def test_hashed_partitions_are_small(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for wanted, got in (("64m", materialize.HASHED_BYTES), ("1m", 1 << 20)):
        spark.conf.set(name, wanted)
        try:
            measured_joins(spark)
            size = lambda s: int(s.replace("1m", str(1 << 20)))
            assert size(spark.conf.get(name)) == got
            assert spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") == spark.conf.get(name)
        finally:
            spark.conf.unset(name)


EDGES = "project_id string, edge_id string, source string, target string, rel string"


def test_few_removed_artifacts_go_to_the_links(spark, rows):
    edges = rows(EDGES, ("p", "1", "a", "b", "feeds"), ("p", "2", "b", "c", "feeds"), ("p", "3", "c", "d", "feeds"), ("p", "4", None, "d", "feeds"))
    gone = rows("project_id string, node_id string", ("p", "a"), ("p", "a"), ("p", "d"), ("q", "b"), ("p", None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = graph.apply_removal(edges, gone, ["source", "target"])
        assert as_set(left, "edge_id") == {"2"}
        assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neighbours_too_many_to_follow_are_not_counted(spark, rows, monkeypatch):
    """A hub with many neighbours can't follow a what-if of two artifacts: its links are gone before the links meet the what-ifs."""
    edges = rows(EDGES, *[("p", f"h{i}", f"s{i}", "hub", "feeds") for i in range(40)], ("p", "x", "s0", "x", "feeds"), ("p", "y1", "s0", "y", "feeds"),
                 ("p", "y2", "s1", "y", "feeds"))
    seeds = rows("project_id string, seed string, node_id string", ("p", "one", "s0"), ("p", "two", "s0"), ("p", "two", "s1"), ("p", "two", "s1"),
                 ("p", None, "s1"))
    sizes, real = {}, graph.cut
    def told(df, name="cut", **more):
        out = real(df, name, **more)
        sizes[name] = out[1]["rows"]
        return out
    monkeypatch.setattr(graph, "cut", told)
    want = {("one", "s0", 0), ("two", "s0", 0), ("two", "s1", 0), (None, "s1", 0), ("one", "x", 1), ("two", "x", 1), ("two", "y", 1)}
    for few_rows in (materialize.FEW_ROWS, 0):
        monkeypatch.setattr(materialize, "FEW_ROWS", few_rows)
        assert as_set(graph.removal_plan(edges, seeds), "seed", "node_id", "wave") == want
        assert sizes["countable"] == 3
    assert graph.removal_plan(edges, seeds.limit(0)).count() == 0


def test_merged_links_of_few_and_many_renames(spark, rows, monkeypatch):
    edges = rows(EDGES, ("p", "E2", "a", "x", "feeds"), ("p", "E10", "b", "x", "feeds"), ("p", "E3", "b", "a", "feeds"), ("p", "E4", "x", "b", "derives"),
                 ("p", "E5", "x", "a", "derives"), ("p", "E6", None, "x", "feeds"), ("q", "E7", "b", "x", "feeds"))
    renames = rows("project_id string, dup string, keep string", ("p", "b", "a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = dedup.merge_edges(edges, renames)
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        want = {("p", "E2", "a", "x", "feeds"), ("p", "E4", "x", "a", "derives"), ("q", "E7", "b", "x", "feeds")}
        assert as_set(merged, *edges.columns) == want
        monkeypatch.setattr(materialize, "FEW_ROWS", 0)
        assert as_set(dedup.merge_edges(edges, renames), *edges.columns) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_are_computed_once(spark, rows):
    """The sets' sizes and the open rows start from one written table."""
    tried = spark.sparkContext.accumulator(0)
    nodes = rows("project_id string, node_id string, step string, type string, grp string, path string, label string",
                 *[("p", f"r{i}", "out", "result", None, "r.tsv", f"label {i}") for i in range(6)], ("p", "pl", "run", "pipeline", None, None, "pl"))
    edges = rows(EDGES, *[("p", f"e{i}", "pl", f"r{i}", "produces") for i in range(6)])
    def count(row):
        tried.add(1)
        return row
    found = summary.group_candidates(nodes, edges)
    counted = spark.createDataFrame(found.rdd.map(count), found.schema)
    got = summary.pack_groups(counted, ["step", "type", "kind", "way", "process_id"])
    assert as_set(got, "node_id") == {f"r{i}" for i in range(6)} and tried.value == 6


def test_confirmations_and_states_are_written_step_by_step(spark, rows):
    """What comes after starts from few stored rows, not from all the joins before it."""
    nodes = rows("project_id string, node_id string, type string, current_version int", ("p", "raw", "raw", 3), ("p", "pl", "pipeline", 1), ("p", "res", "result", 1),
                 ("p", "tab", "table", 2))
    edges = rows(EDGES, ("p", "1", "raw", "pl", "feeds"), ("p", "2", "pl", "res", "produces"), ("p", "3", "res", "tab", "derives"))
    recorded = rows("project_id string, node_id string, parent_id string, recorded int", ("p", "res", "raw", 1), ("p", "tab", "res", 7), ("p", "tab", "gone", None))
    asked = rows("project_id string, node_id string, parent_id string, why string", ("p", "res", None, "checked"), ("p", "tab", None, " "))
    after, refused = staleness.apply_confirmations(nodes, edges, recorded, asked)
    assert "Exchange" not in after._jdf.queryExecution().executedPlan().toString()
    assert as_set(after, "node_id", "parent_id", "recorded") == {("res", "raw", 3), ("res", "pl", 1), ("tab", "res", 7), ("tab", "gone", None)}
    assert as_set(refused, "node_id", "problem") == {("tab", "no reason")}
    disk = rows("project_id string, node_id string, n int", ("p", "raw", 1), ("p", "tab", 2)).groupBy("project_id", "node_id").agg(F.max("n").alias("n")).selectExpr(
        "project_id", "node_id", "n = 1 AS missing", "n = 2 AS modified")
    states = staleness.node_state(nodes, nodes.where("node_id = 'res'").select("project_id", "node_id"), disk)
    assert "Aggregate" not in states._jdf.queryExecution().executedPlan().toString()
    assert as_set(states, "node_id", "state") == {("raw", "missing"), ("pl", "ok"), ("res", "stale"), ("tab", "modified")}
