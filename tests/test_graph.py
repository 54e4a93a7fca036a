import random

import pytest
from conftest import as_set
import model
from strandline.operators import graph

NODE = "project_id string, node_id string, type string, label string, current_version int, final_version int"
EDGE = "project_id string, edge_id string, source string, target string, rel string, placed_version int"
TYPES = ["input", "result", "table", "pipeline", "script", "step", "figure", "article"]
RELS = ["feeds", "produces", "derives", "code", "part_of", "documents", "related", "variant"]


def network(seed, n=14, m=30):
    rnd = random.Random(seed)
    nodes = {f"X{i}": {"type": rnd.choice(TYPES), "current": rnd.choice([1, 2, 3]), "final": rnd.choice([None, 1])}
             for i in range(n)}
    edges = set()
    while len(edges) < m:
        a, b = sorted(rnd.sample(range(n), 2))
        edges.add((f"X{a}", f"X{b}", rnd.choice(RELS)))
    return nodes, sorted(edges), rnd


def tables(rows, nodes, edges, placed=None):
    n = rows(NODE, *[("p", k, v["type"], k, v["current"], v["final"]) for k, v in nodes.items()])
    e = rows(EDGE, *[("p", f"{s}>{t}:{r}", s, t, r, (placed or {}).get((s, t, r))) for s, t, r in edges])
    return n, e


def closure(edges, start, forward=True, skip=()):
    out, todo = set(), [start]
    while todo:
        here = todo.pop()
        for s, t, r in edges:
            a, b = (s, t) if forward else (t, s)
            if r not in skip and a == here and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_and_parents(rows, seed):
    nodes, edges, _ = network(seed)
    n, e = tables(rows, nodes, edges)
    seeds = rows("project_id string, seed string", ("p", "X0"), ("p", "X13"))
    for direction, forward in (("down", True), ("up", False)):
        got = as_set(graph.reachable(e, seeds, direction), "seed", "node_id")
        assert got == {(s, x) for s in ("X0", "X13") for x in closure(edges, s, forward)}
        near = as_set(graph.reachable(e, seeds, direction, max_depth=1), "seed", "node_id")
        assert near == {(s, b if forward else a) for s in ("X0", "X13") for a, b, _ in edges if (a if forward else b) == s}
    got = as_set(graph.effective_parents(n, e), "node_id", "parent_id")
    assert got == {(x, p) for x in nodes for p in model.effective_parents(nodes, edges, x)}
    got = as_set(graph.process_outputs(n, e), "process_id", "node_id")
    assert got == {(x, o) for x in nodes if nodes[x]["type"] in model.PROCESS for o in model.process_outputs(nodes, edges, x)}


@pytest.mark.parametrize("seed", [3, 4])
def test_removal(rows, seed):
    nodes, edges, rnd = network(seed, 12, 14)
    starts = {f"s{i}": rnd.sample(sorted(nodes), 1 + i % 4) for i in range(10)}
    _, e = tables(rows, nodes, edges)
    seeds = rows("project_id string, seed string, node_id string", *[("p", s, x) for s, xs in starts.items() for x in xs])
    got = as_set(graph.removal_plan(e, seeds), "seed", "node_id")
    assert got == {(s, x) for s, xs in starts.items() for x in model.removal(edges, xs)}


def test_removal_of_a_process(rows):
    """The output goes along; inputs left without links are reported, not removed."""
    _, e = tables(rows, {}, [("res", "raw", "related"), ("raw", "pipe", "feeds"), ("other", "pipe", "feeds"),
                             ("cfg", "pipe", "feeds"), ("pipe", "out", "produces")])
    plan = graph.removal_plan(e, rows("project_id string, seed string, node_id string", ("p", "w", "pipe")))
    assert as_set(plan, "node_id") == {"pipe", "out"}
    effects = graph.removal_effects(e, plan)
    assert as_set(effects["orphaned"], "node_id") == {"other", "cfg"}
    assert as_set(effects["edges"], "source", "target") == {("raw", "pipe"), ("other", "pipe"), ("cfg", "pipe"), ("pipe", "out")}
    assert as_set(graph.apply_removal(e, plan, ["source", "target"]), "source", "target") == {("res", "raw")}


def test_layers_and_cycles(rows):
    nodes, edges, _ = network(5)
    n, e = tables(rows, nodes, edges)
    depth = {}
    for x in sorted(nodes, key=lambda k: int(k[1:])):
        depth[x] = max([depth[s] + 1 for s, t, _ in edges if t == x], default=0)
    first = {x: min([depth[t] for s, t, _ in edges if s == x], default=None) for x in nodes}
    fed = {t for _, t, _ in edges}
    want = {x: depth[x] if x in fed or first[x] is None else max(0, first[x] - 1) for x in nodes}
    assert dict(as_set(graph.layers(n, e), "node_id", "depth")) == want
    assert graph.find_cycles(e).count() == 0
    loop = rows(EDGE, ("p", "1", "a", "b", "feeds", None), ("p", "2", "b", "c", "feeds", None), ("p", "3", "c", "b", "feeds", None),
                ("p", "4", "c", "d", "feeds", None))
    assert as_set(graph.find_cycles(loop), "node_id") == {"b", "c"}
    new = rows(EDGE, ("p", "n1", "d", "a", "feeds", None), ("p", "n2", "a", "d", "feeds", None), ("p", "n3", "a", "a", "feeds", None))
    assert as_set(graph.cycle_violations(loop, new), "edge_id") == {"n1", "n3"}


def test_branch_family_long_chain_and_star(rows, spark):
    data = [("p", f"c{i}", f"c{i - 1}" if i else None) for i in range(50)] + [("p", f"s{i}", "c0") for i in range(50)] + [
        ("p", "lost", "nowhere")]
    got = dict(as_set(graph.branch_family(rows("project_id string, node_id string, of string", *data)), "node_id", "root"))
    assert got.pop("lost") == "lost" and set(got.values()) == {"c0"} and len(got) == 100
    with pytest.raises(RuntimeError):
        graph.branch_family(rows("project_id string, node_id string, of string", ("p", "a", "b"), ("p", "b", "a"))).count()


def test_traces_differ_on_loose_links(rows):
    _, e = tables(rows, {}, [("a", "b", "feeds"), ("b", "c", "documents"), ("c", "d", "derives")])
    seeds = rows("project_id string, seed string", ("p", "d"), ("p", "a"))
    assert as_set(graph.traced_edges(e, seeds, "up"), "seed", "source") == {("d", "c")}
    assert as_set(graph.traced_edges(e, seeds, "down"), "seed", "depth", "target") == {("a", 0, "b"), ("a", 1, "c"), ("a", 2, "d")}


def test_independent_of_order_and_partitions(rows, spark):
    nodes, edges, _ = network(6)
    n, e = tables(rows, nodes, edges)
    one = as_set(graph.effective_parents(n, e), "node_id", "parent_id")
    many = as_set(graph.effective_parents(n.repartition(7), e.orderBy("edge_id", ascending=False).repartition(5)), "node_id", "parent_id")
    assert one == many


def test_cycle_question_is_asked_of_the_way_only(rows):
    chain = [("p", f"e{i}", f"n{i}", f"n{i + 1}", "feeds", None) for i in range(40)]
    off = [("p", f"o{i}", "n5", f"off{i}", "feeds", None) for i in range(30)] + [("q", "x", "n9", "n3", "feeds", None)]
    edges = rows(EDGE, *chain, *off)
    new = rows(EDGE, ("p", "a", "n9", "n3", "feeds", None), ("p", "b", "n3", "n9", "feeds", None), ("q", "c", "n9", "n3", "feeds", None))
    assert as_set(graph.cycle_violations(edges, new), "edge_id") == {"a"}
    point = "project_id string, node_id string"
    way = graph.between(edges, rows(point, ("p", "n3")), rows(point, ("p", "n9")))
    assert as_set(way, "source", "target") == {(f"n{i}", f"n{i + 1}") for i in range(3, 9)}
