import random

import pytest
from conftest import as_set
from pyspark.sql import functions as F
from strandline.functions.digest import set_digest
from strandline.operators import versions
from strandline.plans import Known, cut, fixpoint, keyed, new_folder, number_free, order_slices, running_sum, saturate, with_previous


def test_ordered_helpers_with_one_hot_key(rows):
    rnd = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 5}", i, rnd.choice("abc")) for i in range(300)]
    rnd.shuffle(data)
    df = rows("k string, at int, c string", *data)
    by = F.floor(F.col("at") / 7)
    got = {(r["k"], r["at"]): (r["n"], r["p"]["value"] if r["p"] else None) for r in with_previous(
        running_sum(df, ["k"], by, [F.col("at")], F.lit(1), "n"), ["k"], by, [F.col("at")], F.col("c"), "p").collect()}
    for key in {k for k, _, _ in data}:
        before = None
        for n, (_, at, c) in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: d[1]), 1):
            assert got[(key, at)] == (n, before)
            before = c


@pytest.mark.parametrize("slice_rows", [1, 30, 1000])
def test_slices_of_a_hot_key_without_natural_order(rows, slice_rows):
    rnd = random.Random(2)
    data = [("hot" if i % 3 else None, f"Table {rnd.randrange(50)}", i) for i in range(400)]
    df = rows("k string, label string, id int", *data)
    order = [F.col("label"), F.col("id")]
    sliced = order_slices(df, ["k"], order, slice_rows)
    got = {(r["k"], r["id"]): r["n"] for r in running_sum(sliced, ["k"], F.col("_part"), order, F.lit(1), "n").collect()}
    assert got == {(k, i): n for key in ("hot", None) for n, (k, _, i) in enumerate(sorted(
        (d for d in data if d[0] == key), key=lambda d: d[1:]), 1)}
    sizes = sorted(r["count"] for r in sliced.groupBy("_part").count().collect())
    if slice_rows == 30:
        assert len(sizes) > 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert order_slices(df.limit(0), ["k"], order).count() == 0


def test_number_free(rows):
    df = rows("k string, seq int", *[("a", i) for i in range(10)], ("b", 1))
    taken = rows("k string, n long", ("a", 1), ("a", 3), ("a", 4), ("a", 12), ("a", 50), ("b", 2))
    got = as_set(number_free(df, ["k"], F.floor(F.col("seq") / 3), [F.col("seq")], taken, "n"), "k", "n")
    assert got == {("a", n) for n in (2, 5, 6, 7, 8, 9, 10, 11, 13, 14)} | {("b", 1)}


def test_fixpoint_reports_endless_growth(rows, spark):
    with pytest.raises(RuntimeError):
        fixpoint(rows("n int", (1,)), lambda f: f.select((F.col("n") + 1).alias("n")), ["n"], max_rounds=3)


def test_fixpoint_with_bucketed_tables(rows, spark):
    """A chain with shortcuts and a loop, and spans: the same rows and rounds whether known rows are merged into tables or not."""
    arcs = rows("n int, next int", *[(i, i + 1) for i in range(12)], (3, 9), (12, 0), (5, 5)).cache()
    step = lambda f: f.join(arcs, "n").select(F.col("next").alias("n"))
    got = [as_set(fixpoint(rows("n int", (0,), (1,)), step, ["n"], merge_rows=m), "n", "round") for m in (2, 5, 10**9)]
    assert got[0] == got[1] == got[2] and {n for n, _ in got[0]} == set(range(13))
    spans = lambda f: f.join(arcs, "n").select(F.col("next").alias("n"), "a", "b")
    seed = rows("n int, a int, b int", (0, 0, 5), (2, 3, 9))
    got = [as_set(fixpoint(seed, spans, ["n"], span=("a", "b"), merge_rows=m), "n", "a", "b", "round") for m in (2, 10**9)]
    assert got[0] == got[1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("known_")]


def test_known_rows_are_not_shuffled(rows, spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    known = Known(spark, "test", ["p", "n"], merge_rows=50)
    try:
        for lo, hi in ((0, 100), (100, 160), (160, 600), (600, 610)):
            path = new_folder(spark, "test")
            known.add(cut(spark.range(lo, hi).select((F.col("id") % 3).alias("p"), F.col("id").alias("n")), path=path)[0], path, hi - lo)
        assert [size for _, size in known.tables] == [600] and known.young_rows == 10
        known.young = []
        left = known.without(spark.range(0, 700).select((F.col("id") % 3).alias("p"), F.col("id").alias("n"), F.lit(1).alias("v")).dropDuplicates(["p", "n"]))
        assert sorted(r["n"] for r in left.collect()) == list(range(600, 700))
        plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 1
    finally:
        known.close()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_saturate(rows):
    key = "project_id string, node_id string"
    seed = rows(key, ("p", "a"), ("p", "b"))
    needs = rows(key + ", need string", ("p", "c", "a"), ("p", "c", "b"), ("p", "d", "c"), ("p", "e", "c"), ("p", "e", "x"), ("p", "f", "c"))
    got = as_set(saturate(seed, needs, rows(key, ("p", "f"))), "node_id", "round")
    assert got == {("a", 0), ("b", 0), ("c", 1), ("d", 2)}


def test_set_digest_ignores_order_and_partitions(rows):
    data = [("x", str(i)) for i in range(50)] + [("y", str(i)) for i in range(49, -1, -1)] + [("z", str(i)) for i in range(49)]
    df = rows("o string, m string", *data)
    a = dict(as_set(df.groupBy("o").agg(set_digest(F.col("m")).alias("d")), "o", "d"))
    b = dict(as_set(df.repartition(7).groupBy("o").agg(set_digest(F.col("m")).alias("d")), "o", "d"))
    assert a == b and a["x"] == a["y"] != a["z"]


SNAP = "project_id string, node_id string, ts timestamp, seq long, hash string"


def snaps(rows, spark, *data):
    return rows("project_id string, node_id string, day int, seq long, hash string", *data).selectExpr(
        "project_id", "node_id", "timestamp_seconds(day * 86400) AS ts", "seq", "hash")


def test_a_b_a_gives_three_versions(rows, spark):
    df = snaps(rows, spark, ("p", "n", 1, 1, "A"), ("p", "n", 1, 2, "A"), ("p", "n", 3, 3, "B"), ("p", "n", 9, 4, "B"), ("p", "n", 9, 5, "A"))
    got = as_set(versions.assign_versions(df, F.date_trunc("day", "ts")), "v", "hash", "seq")
    assert got == {(1, "A", 1), (2, "B", 3), (3, "A", 5)}


def test_version_changes(rows):
    v = rows("project_id string, node_id string, v int, size long", ("p", "ss", 1, 10), ("p", "ss", 2, 12))
    parents = rows("project_id string, node_id string, v int, parent_id string, version int",
                   ("p", "ss", 1, "cov", 1), ("p", "ss", 2, "cov", 2), ("p", "ss", 1, "old", 1), ("p", "ss", 2, "pl", 1))
    params = rows("project_id string, node_id string, v int, edge_id string, key string, value string",
                  ("p", "ss", 1, "E2", "maf", "0.01"), ("p", "ss", 2, "E2", "maf", "0.05"), ("p", "ss", 1, "E9", "x", "1"))
    nodes = rows("project_id string, node_id string, type string", ("p", "cov", "input"), ("p", "pl", "pipeline"))
    got = as_set(versions.version_changes(v, parents, params, nodes), "kind", "subject", "key", "before", "after")
    assert got == {("input", "cov", None, "1", "2"), ("dropped_input", "old", None, "1", None), ("added_script", "pl", None, None, "1"),
                   ("param", "E2", "maf", "0.01", "0.05"), ("content", None, None, "10", "12")}


def test_merged_params(rows):
    edges = rows("project_id string, edge_id string, params map<string,string>", ("p", "e", {"a": "1", "b": "2"}), ("p", "f", {"c": "3"}))
    edits = rows("project_id string, edge_id string, params map<string,string>, why string", ("p", "e", {"b": "5", "d": "6"}, "x"))
    got = {r["edge_id"]: r["params"] for r in versions.merged_params(edges, edits).collect()}
    assert got == {"e": {"a": "1", "b": "5", "d": "6"}, "f": {"c": "3"}}
    assert as_set(versions.edge_param_changes(edges, edits), "key", "before", "after") == {("b", "2", "5"), ("d", None, "6")}


def test_keyed_tables_are_joined_without_a_shuffle(spark, rows):
    """What the rounds join again and again is shuffled once, when it is written."""
    arcs = keyed(rows("node_id string, project_id string, next string", *[(f"n{i % 50}", "p", f"m{i}") for i in range(500)]), ["node_id", "project_id"])
    found = rows("node_id string, project_id string", *[(f"n{i}", "p") for i in range(0, 60, 2)])
    met = found.hint("shuffle_merge").join(arcs, ["node_id", "project_id"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert met.count() == 250
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("keyed_")]
    twice = rows("node_id string, next string", ("a", "b"), ("a", "b"), ("a", "c"), ("d", "b"))
    assert sorted(map(tuple, keyed(twice, ["node_id"], distinct=True).collect())) == [("a", "b"), ("a", "c"), ("d", "b")]
