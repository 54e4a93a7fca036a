"""Queries over their whole tables against plain models, where the SQL of their smaller forms cannot follow."""

from collections import defaultdict
from itertools import takewhile

from conftest import as_set

import __spark_entry__ as entry_point
from strandline.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()


def cascade(around, into, start):
    """{artifact: wave} for the removal of the artifacts `start`."""
    gone, wave = dict.fromkeys(start, 0), 0
    fresh = set(gone)
    while fresh:
        wave += 1
        near = {b for a in fresh for b in around[a]} - gone.keys()
        fresh = {b for b in near if around[b] <= gone.keys() and into[b] & gone.keys()}
        gone.update(dict.fromkeys(fresh, wave))
    return gone


def test_removals_over_all_links_and_seeds(spark):
    fx = Fixtures(spark, SF)
    around, into = defaultdict(set), defaultdict(set)
    for a, b in as_set(fx.edges(), "source", "target"):
        around[a].add(b)
        around[b].add(a)
        into[b].add(a)
    seeds = {n: {n} for n in as_set(fx.nodes(), "node_id")}
    nation = dict(as_set(fx.table("customer"), "c_custkey", "c_nationkey"))
    for customer, order in as_set(fx.table("orders"), "o_custkey", "o_orderkey"):
        n = nation[customer]
        seeds.setdefault(f"all of {customer}", set()).add(f"O{order}")
        seeds.setdefault(f"article of {n}", set()).update((f"O{order}", f"A{n}"))
        seeds.setdefault(f"tables of {n}", set()).update((f"T{customer}", f"N{n}"))
    want = {(seed, n, wave) for seed, start in seeds.items() for n, wave in cascade(around, into, start).items()}
    assert as_set(QUERIES["removal_cascade_all"](spark, SF), "seed", "node_id", "wave") == want
    assert {"T", "A"} <= {n[0] for _, n, wave in want if wave}


def edited(text, steps):
    """(text, failed, problem) after the (find, replace, nth) of a document."""
    now = text
    for n, (find, replace, nth) in enumerate(steps, 1):
        hits = now.count(find) if find else 0
        problem = "not found" if not hits else "ambiguous" if nth is None and hits > 1 else "no such occurrence" if (nth or 1) > hits else None
        if problem:
            return text, n, problem
        parts = now.split(find)
        k = nth or 1
        now = find.join(parts[:k]) + replace + find.join(parts[k:])
    return now, None, None


def test_all_edits(spark):
    want = set()
    for doc, text, lang in as_set(Fixtures(spark, SF).table("documents"), "doc_id", "text", "lang"):
        steps = [(text.split(" ")[0], "<0>", None), (" the ", "<1>", 2), (" der " if lang == "de" else " le ", "<2>", None)]
        want.add((f"d{doc}", *edited(text, steps)))
    assert as_set(QUERIES["applied_edits_all"](spark, SF), "file", "text", "failed", "problem") == want
    assert {"no such occurrence"} <= {problem for _, _, n, problem in want if n == 2} and any(n == 3 for _, _, n, _ in want)


def test_staleness_behind_stale_pages(spark):
    fx = Fixtures(spark, SF)
    users = sorted(int(n[1:]) for n in as_set(fx.snapshots(), "node_id"))
    direct = {int(n[1:]) for n in as_set(QUERIES["stale_asof"](spark, SF), "node_id")}
    want = set()
    for user in users:
        if user in direct or user - 1 in want:
            want.add(user)
    assert as_set(QUERIES["stale_asof_all"](spark, SF), "node_id") == {f"U{u}" for u in want}
    assert direct < want


def test_labels_of_all_sets(spark):
    sets = defaultdict(set)
    for name, brand in as_set(Fixtures(spark, SF).table("part"), "p_name", "p_brand"):
        sets[name.split(" ")[0], brand].add(name)
    want = set()
    for (first, brand), names in sets.items():
        words = [n.split(" ") for n in names]
        shared = list(takewhile(lambda w: len(set(w)) == 1, zip(*words, strict=False)))
        want.add((first, brand, " ".join(w[0] for w in shared)))
    got = as_set(QUERIES["common_label_all"](spark, SF), "first", "p_brand", "label")
    assert got == want and got > as_set(QUERIES["common_label"](spark, SF), "first", "p_brand", "label")
