import pytest
from conftest import as_set
import model
from pyspark.sql import functions as F
from strandline.operators import staleness
from strandline.operators.staleness import Staleness
from strandline.operators.graph import typed_links
from strandline.streaming.upkeep import changed_marks
from test_graph import EDGE, NODE, network, tables

REC = "project_id string, node_id string, parent_id string, recorded int"


def chain(rows, current, recorded):
    """cov feeds a pipeline that makes two results; a table and a figure follow."""
    types = {"cov": "input", "pl": "pipeline", "ss": "result", "qc": "result", "tab": "table", "fig": "figure"}
    n = rows(NODE, *[("p", k, t, k, current.get(k, 1), None) for k, t in types.items()])
    e = rows(EDGE, *[("p", f"{a}>{b}", a, b, r, None) for a, b, r in (
        ("cov", "pl", "feeds"), ("pl", "ss", "produces"), ("pl", "qc", "produces"), ("ss", "tab", "derives"), ("tab", "fig", "derives"))])
    base = {("ss", "cov"): 1, ("ss", "pl"): 1, ("qc", "cov"): 1, ("qc", "pl"): 1, ("tab", "ss"): 1, ("fig", "tab"): 1}
    r = rows(REC, *[("p", a, b, v) for (a, b), v in {**base, **recorded}.items()])
    return n, e, r


def test_a_new_input_reaches_everything_behind_the_pipeline(rows):
    assert as_set(Staleness(*chain(rows, {"cov": 2}, {})).stale_nodes(), "node_id") == {"pl", "ss", "qc", "tab", "fig"}


def test_a_partial_rerun_leaves_the_sibling_stale(rows):
    n, e, r = chain(rows, {"cov": 2, "ss": 2}, {("ss", "cov"): 2})
    assert as_set(Staleness(n, e, r).stale_nodes(), "node_id") == {"pl", "qc", "tab", "fig"}
    n, e, r = chain(rows, {"cov": 2, "ss": 2, "tab": 2}, {("ss", "cov"): 2, ("tab", "ss"): 2})
    assert as_set(Staleness(n, e, r).stale_nodes(), "node_id") == {"pl", "qc", "fig"}


def test_unknown_recorded_version_is_not_stale(rows):
    n, e, r = chain(rows, {"ss": 2}, {("tab", "ss"): None})
    assert as_set(Staleness(n, e, r).stale_nodes(), "node_id") == set()


@pytest.mark.parametrize("seed", [11, 12])
def test_matches_the_model_on_random_networks(rows, seed):
    nodes, edges, rnd = network(seed, 16, 34)
    placed = {e: rnd.choice([None, 1, 2]) for e in edges if e[2] == "part_of"}
    recorded = {(x, p): rnd.choice([None, nodes[p]["current"], nodes[p]["current"], nodes[p]["current"], 1])
                for x in nodes for p in model.effective_parents(nodes, edges, x) if nodes[x]["type"] not in model.PROCESS}
    recorded[("X0", "X15")] = 99  # recorded once, no parent any more
    n, e = tables(rows, nodes, edges, placed)
    r = rows(REC, *[("p", a, b, v) for (a, b), v in recorded.items()])
    verdict = Staleness(n, e, r)
    want = model.stale(nodes, edges, recorded, placed)
    assert as_set(verdict.stale_nodes(), "node_id") == want
    links = {f"{s}>{t}:{k}" for s, t, k in edges if model.link_is_stale(nodes, edges, recorded, (s, t, k), placed)}
    assert as_set(verdict.stale_links(), "edge_id") == links
    assert as_set(verdict.reasons(), "node_id") == want
    # one artifact gets a new version: the affected part alone gives the same verdict
    changed = rnd.choice(sorted(nodes))
    nodes[changed]["current"] += 1
    after, _ = tables(rows, nodes, edges, placed)
    mark = ["project_id", "node_id", "mark"]
    before = verdict.marks().select(*mark).unionByName(verdict.seeds().distinct().withColumn("mark", F.lit("seed")))
    moves = changed_marks(after, e, r, typed_links(n, e), rows("project_id string, node_id string", ("p", changed)), before)
    moves = moves.where("mark = 'stale'")
    got = (want | as_set(moves.where("on"), "node_id")) - as_set(moves.where("NOT on"), "node_id")
    assert got == model.stale(nodes, edges, recorded, placed)


def test_rebuild_order(rows):
    n, e, r = chain(rows, {"cov": 2}, {})
    got = as_set(staleness.rebuild_order(n, e, Staleness(n, e, r).stale_nodes()), "node_id", "place")
    assert got == {("pl", 1), ("ss", 2), ("qc", 2), ("tab", 3), ("fig", 4)}


def test_confirmations(rows):
    n, e, r = chain(rows, {"cov": 2}, {})
    ask = "project_id string, node_id string, parent_id string, why string"
    after, refused = staleness.apply_confirmations(n, e, r, rows(
        ask, ("p", "ss", None, "checked"), ("p", "qc", None, " "), ("p", "pl", None, "x"), ("p", "tab", "cov", "x")))
    assert as_set(refused, "node_id", "problem") == {("qc", "no reason"), ("pl", "process"), ("tab", "not an input")}
    assert as_set(Staleness(n, e, after).stale_nodes(), "node_id") == {"pl", "qc"}


def test_confirming_needs_saved_content(rows):
    n, e, r = chain(rows, {"cov": 2}, {})
    ask = rows("project_id string, node_id string, parent_id string, why string", ("p", "ss", "cov", "checked"))
    dirty = rows("project_id string, node_id string", ("p", "ss"))
    _, refused = staleness.apply_confirmations(n, e, r, ask, dirty)
    assert as_set(refused, "problem") == {"changed on disk"}


def test_adopt_parents_fills_only_gaps(rows):
    n, e, r = chain(rows, {"cov": 3}, {})
    extra = rows(EDGE, ("p", "new", "qc", "tab", "derives", None))
    touched = rows("project_id string, node_id string", ("p", "tab"))
    after = staleness.adopt_parents(n, e.unionByName(extra), r, touched)
    assert as_set(after.where("node_id = 'tab'"), "parent_id", "recorded") == {("ss", 1), ("qc", 1)}


def test_disk_state(rows):
    v = rows("project_id string, node_id string, path string, size long, mtime long, hash string",
             ("p", "a", "a", 1, 1, "x"), ("p", "b", "b", 1, 1, "x"), ("p", "c", "c", 1, 1, "x"), ("p", "d", "d", None, None, None))
    d = rows("project_id string, path string, size long, mtime long, hash string",
             ("p", "a", 1, 1, "other"), ("p", "b", 1, 2, "y"), ("p", "d", 1, 1, "z"))
    got = {r[0]: (r[1], bool(r[2])) for r in staleness.disk_state(v, d).select("node_id", "missing", "modified").collect()}
    assert got == {"a": (False, False), "b": (False, True), "c": (True, False), "d": (False, False)}
    states = staleness.node_state(v, v.where("node_id in ('c', 'b')").select("project_id", "node_id"),
                                  staleness.disk_state(v, d))
    assert dict(as_set(states, "node_id", "state")) == {"a": "ok", "b": "stale", "c": "missing", "d": "ok"}


def test_nodes_without_versions(rows):
    n, e, r = chain(rows, {}, {})
    n = n.withColumn("current_version", F.when(F.col("node_id") == "cov", None).otherwise(F.col("current_version")))
    assert Staleness(n, e, r).stale_nodes().count() == 0


@pytest.mark.parametrize("seed", [21, 22])
def test_spans_answer_every_moment(rows, seed):
    """One run over all times next to the model at twenty moments."""
    nodes, edges, rnd = network(seed, 14, 28)
    placed = {e: rnd.choice([None, 1, 2, 3]) for e in edges if e[2] == "part_of"}
    saves = {x: sorted(rnd.sample(range(1, 100), rnd.randrange(0, 5))) for x in nodes}
    number = lambda x, t: sum(at <= t for at in saves[x]) or None
    recorded = {(x, v, p): rnd.choice([None, number(p, at), number(p, at), 1, 9]) for x in nodes if nodes[x]["type"] not in model.PROCESS
                for v, at in enumerate(saves[x], 1) for p in model.effective_parents(nodes, edges, x)}
    n, e = tables(rows, nodes, edges, placed)
    when = lambda df: df.selectExpr("project_id", "node_id", "v", "timestamp_seconds(t) AS ts")
    versions = when(rows("project_id string, node_id string, v int, t int", *[("p", x, v, at) for x in nodes for v, at in enumerate(saves[x], 1)]))
    built = rows("project_id string, node_id string, v int, parent_id string, recorded int", *[("p", x, v, p, r) for (x, v, p), r in recorded.items()])
    spans = [(r.node_id, r.a, r.b) for r in staleness.staleness_spans(n, e, versions, built).select(
        "node_id", F.unix_seconds("since").alias("a"), F.unix_seconds("until").alias("b")).collect()]
    changes = 0
    for t in rnd.sample(range(0, 110), 20):
        then = {x: {**rec, "current": number(x, t)} for x, rec in nodes.items()}
        inputs = {(x, p): r for (x, v, p), r in recorded.items() if number(x, t) == v}
        got = {x for x, a, b in spans if a <= t < b}
        assert got == model.stale(then, edges, inputs, placed), t
        changes += bool(got)
    assert changes >= 5
    assert len({(x, a) for x, a, _ in spans}) == len(spans) and all(a < b for _, a, b in spans)
