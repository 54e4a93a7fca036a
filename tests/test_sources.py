import json

import pytest
from conftest import as_set
from pyspark.sql import functions as F
from strandline.operators import layout
from strandline.operators.staleness import Staleness
from strandline.sources import catalog, events, graph_dump, listing, registers

DUMP = {
    "schema": "x/1", "project": {"name": "Study", "created": "2024-01-01T00:00:00+00:00"},
    "nodes": {
        "IN1": {"id": "IN1", "type": "input", "label": "cov", "path": "data/cov.tsv", "mode": "ref", "groups": ["g", "h"], "tags": ["t"],
                "meta": {"n": 1.0, "url": "u", "also_at": ["a", "b"]}, "current_version": 2, "final_version": None, "versions": [
                    {"v": 1, "ts": "2024-01-01T00:00:00+00:00", "hash": "a", "size": 10, "parents": {}, "edge_params": {}},
                    {"v": 2, "ts": "2024-01-02T00:00:00+00:00", "hash": "b", "size": 11, "why": "new", "parents": {}, "edge_params": {}}]},
        "R1": {"id": "R1", "type": "result", "label": "ss", "path": None, "mode": "managed", "groups": [], "current_version": 1, "hidden": True,
               "versions": [{"v": 1, "ts": "2024-01-01T00:00:00+00:00", "hash": "c", "size": 5, "parents": {"IN1": 1},
                             "edge_params": {"E1": {"maf": 0.01, "list": [1, 2.0], "name": "1"}}}]},
    },
    "edges": [{"id": "E1", "source": "IN1", "target": "R1", "rel": "derives", "params": {"maf": 0.05, "L": 10.0, "s": "10"},
               "changes": [{"ts": "2024-01-03T00:00:00+00:00", "actor": "user", "why": "w", "params": {"maf": [0.01, 0.05]}}]}],
    "steps": {"gwas": {"label": "GWAS", "order": 1}}, "groups": {"g": {"label": "G", "color": None}},
    "analyses": {"raw": {"title": "Raw", "parent": None, "order": 1, "nodes": ["IN1"], "history": [{"date": "2024", "text": "x"}]}},
}


def test_graph_dumps(spark, tmp_path):
    for name, doc in (("one", DUMP), ("two", {"schema": "x/1", "nodes": {"A1": {"id": "A1", "type": "article"}}, "edges": []})):
        (tmp_path / name / ".state").mkdir(parents=True)
        (tmp_path / name / ".state" / "graph.json").write_text(json.dumps(doc, indent=1))
    t = graph_dump.read_graph_dumps(spark, f"{tmp_path}/*/.state/graph.json")
    assert as_set(t["node"], "project_id", "node_id", "type", "grp") == {
        ("one", "IN1", "input", "g"), ("one", "R1", "result", None), ("two", "A1", "article", None)}
    assert t["edge"].first()["params"] == {"maf": "0.05", "L": "10", "s": '"10"'}
    assert t["node"].where("node_id = 'IN1'").first()["meta"] == {"n": "1", "url": '"u"', "also_at": '["a","b"]'}
    assert as_set(t["version_param"], "edge_id", "key", "value") == {("E1", "maf", "0.01"), ("E1", "list", "[1,2]"), ("E1", "name", '"1"')}
    assert as_set(t["edge_change"], "key", "before", "after") == {("maf", "0.01", "0.05")}
    assert as_set(t["recorded"], "node_id", "parent_id", "recorded") == {("R1", "IN1", 1)}
    assert as_set(t["node_group"], "node_id", "grp") == {("IN1", "g"), ("IN1", "h")}
    assert as_set(t["analysis_node"], "key", "node_id") == {("raw", "IN1")} and t["analysis_event"].count() == 1
    assert as_set(t["step"], "step", "ord") == {("gwas", 1)} and t["project_note"].count() == 0
    assert as_set(Staleness(t["node"], t["edge"], t["recorded"]).stale_nodes(), "node_id") == {"R1"}


def test_events(spark, tmp_path):
    log = tmp_path / "history.jsonl"
    log.write_text('{"ts": "2024-01-01T00:00:00+00:00", "event": "node_added", "actor": "user", "node": "A"}\n\nnot json\n'
                   '{"ts": "2024-01-02T00:00:00+00:00", "event": "link", "actor": "user", "nodes": ["A", "B"], "more": 1}\n')
    got = events.read_events(spark, str(log))
    assert as_set(got, "event") == {"node_added", "link"} and events.corrupt_events(spark, str(log)).count() == 1
    out = str(tmp_path / "out")
    events.append_events(got.drop("file", "offset"), out)
    events.append_events(got.drop("file", "offset").limit(1), out)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert len(lines) == 3 and all("null" not in x for x in lines) and events.read_events(spark, out).count() == 3


def test_registers(spark, tmp_path):
    f = tmp_path / "evidence.tsv"
    f.write_text("﻿id\ttarget \tnote\nE1\t r1 \t\n\t\t\nE2\tdata/x\ta note\n", encoding="utf-8")
    rows = registers.read_register(spark, str(f))
    assert rows.columns == ["id", "target", "note"] and as_set(rows, "id", "target", "note") == {("E1", "r1", ""), ("E2", "data/x", "a note")}
    registers.write_register(rows.withColumn("other", F.lit(1)), str(tmp_path / "out"), registers.COLUMNS["evidence"])
    again = registers.read_register(spark, str(tmp_path / "out"))
    assert again.columns == registers.COLUMNS["evidence"] and as_set(again, "id") == {"E1", "E2"}


def test_listing(spark, tmp_path):
    for name, text in (("a/x.txt", "12345"), ("a/b/y.txt", "1"), (".hid/z.txt", "2"), ("a/.h", "3")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = listing.inventory(spark, str(tmp_path), "p")
    assert as_set(files, "path", "size") == {("a/x.txt", 5), ("a/b/y.txt", 1)}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    chosen, empty = layout.selected_files(files, ["a/b", "*.none"])
    assert as_set(chosen, "path") == {"a/b/y.txt"} and as_set(empty, "entry") == {"*.none"}


def catalog_tables(rows):
    nodes = rows("project_id string, node_id string, type string, label string, current_version int, final_version int, grp string, path string",
                 ("p", "PL1", "pipeline", "pl", 1, None, None, None), ("p", "T4", "table", "t", 1, None, None, None))
    edges = rows("project_id string, edge_id string, source string, target string, rel string, params map<string,string>", ("p", "E1", "PL1", "T4", "produces", {"a": "1"}))
    return {"nodes": nodes, "edges": edges}


def batch_tables(rows, rel):
    nodes = rows("project_id string, batch_id string, seq int, key string, id string, type string, label string, mode string, path string, step string, grp string",
                 ("p", "b", 1, "tab", None, "table", "New table", "ref", None, None, None), ("p", "b", 2, "five", "T5", "table", "Own id", "ref", None, None, None))
    edges = rows("project_id string, batch_id string, n string, src string, dst string, rel string, params map<string,string>, script string",
                 ("p", "b", "1", "PL1", "tab", rel, {"x": "1"}, None), ("p", "b", "2", "PL1", "T4", "produces", {"b": "2"}, None), ("p", "b", "3", "tab", "five", "derives", {"y": "1"}, "PL1"))
    return {"nodes": nodes, "edges": edges}


def test_load_is_all_or_nothing(spark, rows, tmp_path):
    root = str(tmp_path / "catalog")
    assert catalog.current_snapshot(spark, root) == 0
    catalog.write_snapshot(catalog_tables(rows), root)
    stored = catalog.read_snapshot(spark, root)
    findings, n = catalog.load_batch(batch_tables(rows, "makes"), stored, root)
    assert n is None and "unknown_relation" in as_set(findings, "rule") and catalog.current_snapshot(spark, root) == 1
    findings, n = catalog.load_batch(batch_tables(rows, "produces"), stored, root)
    assert n == 2 and findings.where("severity = 'ERROR'").count() == 0
    now = catalog.read_snapshot(spark, root)
    assert as_set(now["nodes"], "node_id") == {"PL1", "T4", "T5", "T6"}
    assert {(r["source"], r["target"], r["rel"], tuple(sorted(r["params"].items()))) for r in now["edges"].collect()} == {
        ("PL1", "T4", "produces", (("a", "1"), ("b", "2"))), ("PL1", "T6", "produces", (("x", "1"),)),
        ("T6", "T5", "derives", (("y", "1"),)), ("PL1", "T5", "code", ())}


def test_load_keeps_every_section(spark, rows, tmp_path):
    root = str(tmp_path / "catalog")
    tables = catalog_tables(rows)
    tables["edges"] = tables["edges"].selectExpr("*", "CAST(NULL AS STRING) AS script", "'old' AS label", "CAST(NULL AS STRING) AS note")
    tables["files"] = rows("project_id string, owner string, size long, hash string", ("p", "T4", 9, "x"))
    catalog.write_snapshot(tables, root)
    stored = catalog.read_snapshot(spark, root)
    batch = batch_tables(rows, "produces")
    batch["edges"] = rows(
        "project_id string, batch_id string, n string, src string, dst string, rel string, params map<string,string>, script string, "
        "label string, note string", ("p", "b", "10", "PL1", "T4", "produces", {"x": "3", "zz": "9"}, None, None, "ten"),
        ("p", "b", "2", "PL1", "T4", "produces", {"x": "1", "y": "2"}, "PL1", "two", "two"),
        ("p", "b", "3", "PL1", "tab", "produces", {"q": "1"}, None, "", None), ("p", "b", "4", "tab", "five", "derives", None, None, None, None))
    one = "project_id string, batch_id string, n string, node string, "
    batch["notes"] = rows(one + "text string", ("p", "b", "1", "tab", "see this"))
    batch["groups"] = rows(one + "name string", ("p", "b", "1", "five", "g"), ("p", "b", "2", "T4", "g"), ("p", "b", "3", "T4", "g"))
    batch["final"] = rows(one + "version int", ("p", "b", "1", "T4", None))
    batch["saves"] = rows(one + "why string", ("p", "b", "1", "T4", "again"))
    batch["steps"] = rows("project_id string, batch_id string, step string, label string", ("p", "b", "s", "Step"))
    batch["files"] = rows("project_id string, batch_id string, owner string, size long, hash string", ("p", "b", "tab", 9, "x"))
    findings, n = catalog.load_batch(batch, stored, root)
    assert n is None and as_set(findings.where("rule = 'same_content'"), "subject", "detail") == {("tab", "T4")}
    batch["files"] = batch["files"].where("false")
    findings, n = catalog.load_batch(batch, stored, root)
    now = catalog.read_snapshot(spark, root)
    assert n == 2 and {(r["source"], r["target"], r["label"], r["note"], r["script"], tuple(sorted(r["params"].items())))
                       for r in now["edges"].collect()} == {
        ("PL1", "T4", "two", "ten", "PL1", (("a", "1"), ("x", "3"), ("y", "2"), ("zz", "9"))),
        ("PL1", "T6", None, None, None, (("q", "1"),)), ("T6", "T5", None, None, None, ())}
    assert as_set(now["notes"], "node_id", "text") == {("T6", "see this")} and as_set(now["steps"], "step", "label") == {("s", "Step")}
    assert sorted(r["node_id"] for r in now["groups"].collect()) == ["T4", "T5"]
    assert as_set(now["nodes"].where("node_id = 'T4'"), "current_version", "final_version") == {(2, 2)}
    with pytest.raises(ValueError, match="derive_branch"):
        catalog.load_batch(batch | {"branches": batch["notes"]}, stored, root)


def test_catalog_snapshot(spark):
    from strandline.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    shot = catalog.catalog_snapshot(fx.nodes(), fx.edges(), fx.version_parents(), fx.node_versions(), fx.disk(), fx.analyses(),
                                    fx.analysis_nodes(), fx.events())
    states = dict(shot["nodes"].groupBy("state").count().collect())
    assert set(states) == {"ok", "stale", "missing", "modified"} and sum(states.values()) == fx.nodes().count()
    assert shot["events"].count() == min(2000, fx.events().count()) and shot["edges"].where("stale").count() > 0


def test_organized_copies(rows):
    key = "project_id string, node_id string, "
    nodes = rows(key + "step string, grp string", ("p", "a", "s", None), ("p", "b", "s", "g"), ("p", "c", None, None), ("p", "d", "s", None))
    copies = rows(key + "copy_path string, source string, source_hash string, size long, source_mtime long", *[
        ("p", n, f"01_S/{n}", f"src/{n}", "h", 1, 1) for n in "abc"])
    there = rows("project_id string, path string", ("p", "01_S/a"), ("p", "01_S/b"))
    disk = rows("project_id string, path string, size long, mtime long, hash string", ("p", "src/a", 1, 1, "h"), ("p", "src/b", 2, 2, "x"), ("p", "src/c", 1, 1, "h"))
    steps = rows("project_id string, step string, ord int, step_label string", ("p", "s", 1, "S"))
    assert as_set(catalog.organized_copies(nodes, copies, there, disk, steps), "node_id", "copy_path", "state", "folder") == {
        ("a", "01_S/a", "ok", "01_S"), ("b", "01_S/b", "source_changed", "01_S/g"), ("c", "01_S/c", "copy_missing", "00_No_step")}
