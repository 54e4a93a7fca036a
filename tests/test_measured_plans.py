"""Plans that follow sizes in memory, batch rules one at a time, and links that are listed twice."""

from pyspark.sql import functions as F
from strandline.operators import graph
from strandline.plans import bits, cut, fixpoint, keyed, least
from strandline.queries import all_queries


def test_sizes_follow_rows_in_memory(spark):
    ids = spark.range(300_000).selectExpr("'p0' AS project_id", "concat('PL', id) AS node_id")
    stored, _ = cut(ids, "ids")
    # two short strings take at least 40 bytes a row, whatever their file takes
    assert int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 300_000 * 40


def test_measured_partitions_are_hashed(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        arcs = keyed(spark.range(2000).selectExpr("'p' AS project_id", "concat('n', id) AS node_id", "id AS next"), ["node_id", "project_id"])
        frontier, _ = cut(spark.range(50).selectExpr("'p' AS project_id", "concat('n', id) AS node_id"))
        met = frontier.join(arcs, ["node_id", "project_id"])
        assert len(met.collect()) == 50
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan.split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_of_a_batch_run_one_after_another(spark):
    report = all_queries()["v_report"](spark, "/root/testdata/sf0.001")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 60 and plan.count("BroadcastExchange") <= 2


def test_repeated_links_do_not_block(spark):
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "c"), ("d", "e"), ("x", "y")]
    edges = spark.createDataFrame([("p", *x) for x in links], "project_id string, source string, target string")
    assert {r.node_id for r in graph.find_cycles(edges).collect()} == {"c", "d"}
    arcs = graph.stored_arcs(edges.where("NOT (source = 'd' AND target = 'c')"))
    nodes = spark.createDataFrame([("p", n) for n in "abcdexy"], "project_id string, node_id string")
    assert {r.node_id: r.depth for r in graph.peel(nodes, arcs).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "x": 0, "y": 1}


def test_no_round_follows_rows_that_lead_nowhere(spark):
    asked = []

    def step(frontier):
        asked.append(1)
        return frontier.where("open").selectExpr("id + 1 AS id", "id < 3 AS open")

    seed = spark.createDataFrame([(1, True), (7, False)], "id long, open boolean")
    got = fixpoint(seed, step, ["id"], leads_on="open")
    assert sorted((r.id, r.round) for r in got.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3), (7, 0)]
    assert len(asked) == 3


def test_seeds_that_meet_walk_as_one_row(spark):
    """150 seeds lead to one hub and along a chain with a way back; each link behind the hub is followed once for 64 seeds."""
    links = [(f"s{i:03d}", "hub") for i in range(150)] + [("hub", "a"), ("a", "b"), ("b", "hub"), ("s003", "b"), ("b", "s149")]
    edges = spark.createDataFrame([("p", a, b) for a, b in links], "project_id string, source string, target string")
    seeds = spark.createDataFrame([("p", f"s{i:03d}") for i in range(150)] + [("p", "s000")], "project_id string, seed string")
    arcs = keyed(graph._arcs(edges, "down", []), ["node_id", "project_id"])
    met, by_seed = graph._walk(arcs, seeds)
    assert met.where("depth > 0 AND node_id IN ('hub', 'a')").count() <= 12
    want = {}
    for seed in (f"s{i:03d}" for i in range(150)):
        near, depth = {seed: 0}, 0
        while fresh := {b for a, b in links if near.get(a) == depth} - set(near):
            depth += 1
            near |= dict.fromkeys(fresh, depth)
        want |= {(seed, node): d for node, d in near.items()}
    assert {(r.seed, r.node_id): r.depth for r in by_seed(met).collect()} == want
    got = {(r.seed, r.node_id): r.depth for r in graph.reachable(edges, seeds).collect()}
    assert got == {k: d for k, d in want.items() if d}


def test_values_grow_over_merged_tables(spark):
    """Bits and least values of a key that is found again and again, whether known rows are merged into tables or not."""
    arcs = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0), (2, 7), (5, 5)], "n int, next int")
    seed = spark.createDataFrame([(0, 1), (4, 2), (8, 4)], "n int, v long")
    step = lambda f: f.join(arcs, "n").select(F.col("next").alias("n"), "v")
    for value, want in ((bits("v"), {n: 7 for n in range(10)}), (least("v"), {n: 1 for n in range(10)})):
        got = [fixpoint(seed, step, ["n"], value=value, merge_rows=m) for m in (2, 5, 10**9)]
        rows = [sorted(tuple(r) for r in g.collect()) for g in got]
        assert rows[0] == rows[1] == rows[2]
        assert {r.n: r.v for r in got[0].groupBy("n").agg(value.merge("v").alias("v")).collect()} == want


def test_articles_do_not_deal_out_artifacts(spark):
    """Few articles lead to all artifacts, so these must not be shuffled by article; stored links give the same."""
    links = [("T1", "A2", "part_of"), ("T1", "A1", "part_of"), ("O1", "T1", "derives"), ("A1", "A0", "part_of"), ("T2", "A2", "part_of"),
             ("O2", "T2", "derives"), ("O1", "O2", "derives"), ("O2", "O1", "derives"), ("X", "A0", "documents"), ("R", "O2", "feeds")]
    edges = spark.createDataFrame([("p", f"e{i}", *x) for i, x in enumerate(links)], "project_id string, edge_id string, source string, target string, rel string")
    kinds = {n: "article" if n.startswith("A") else "result" for a, b, _ in links for n in (a, b)}
    nodes = spark.createDataFrame([("p", n, k, f"label {n}") for n, k in kinds.items()], "project_id string, node_id string, type string, label string")
    want = {"A0": "label A0", "A1": "label A1", "A2": "label A2", "T1": "label A1", "T2": "label A2", "O1": "label A1", "O2": "label A1", "R": "label A1",
            "X": "(no article)"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for stored in (None, keyed(graph.typed_links(nodes, edges), ["target", "project_id"], "links")):
            got = graph.article_of(nodes, edges, stored) if stored is not None else graph.article_of(nodes, edges)
            assert {r.node_id: r.article for r in got.collect()} == want
            assert "hashpartitioning(article" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_are_written_without_a_sort(spark):
    """A task writes one bucket, so a sort by bucket would only cost time."""
    rows = spark.range(1000).selectExpr("'p' AS project_id", "concat('n', id) AS node_id")
    stored = keyed(rows, ["node_id", "project_id"])
    assert stored.count() == 1000 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "1"
    met = stored.groupBy("node_id", "project_id").count()
    assert len(met.collect()) == 1000 and "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
