"""Cases across projects and articles, odd numbers, and answers that must be whole."""

from pyspark.sql import functions as F

from strandline.operators import dedup, graph, history, manuscript, markup, monitor, search, staleness, summary, trees
from strandline.sources import catalog
from tests.conftest import as_set

A = "project_id string, article string, "


def test_articles_do_not_mix(rows):
    files = rows(A + "file string, text string", ("p", "one", "s.tex", "alpha beta"), ("p", "two", "s.tex", "alpha beta"), ("q", "one", "s.tex", "beta"))
    gaps = rows(A + "file string, anchor string, cause string", ("p", "one", "s.tex", "alpha", "x"), ("q", "one", "s.tex", "alpha", None))
    assert as_set(markup.gap_locations(gaps, files), "project_id", "line", "stale") == {("p", 1, False), ("q", None, True)}
    evidence = rows(A + "id string, target string, note string", ("p", "one", "E1", "f.pdf", ""), ("p", "two", "E1", "f.pdf", ""))
    uses = rows(A + "name string, file string, line int", ("p", "one", "E1", "s.tex", 1))
    assets = rows(A + "key string, file string")
    assert as_set(markup.evidence_problems(evidence, uses, assets), "article", "problem", "name") == {("two", "unused", "E1")}
    present = rows(A + "path string", ("p", "one", "f.pdf"))
    cited = rows(A + "key string, file string")
    targets = markup.evidence_targets(evidence, cited, assets, present)
    assert as_set(targets, "article", "path") == {("one", "f.pdf"), ("two", None)}
    assert as_set(markup.evidence_missing(evidence, targets), "article", "kind") == {("two", "nofile")}
    hunks = rows(A + "proposal string, state string", ("p", "one", "P1", "accepted"), ("p", "two", "P1", "open"))
    status = manuscript.proposal_status(hunks)
    assert as_set(status, "article", "status") == {("one", "accepted"), ("two", "open")}
    revisions = rows(A + "r_id string, proposal string, status string, before string, reviewer_text string", ("p", "one", "R1", "P1", "proposed", "a", "b"),
                     ("p", "two", "R1", "P1", "proposed", "a b", "a"))
    assert as_set(manuscript.revision_status(revisions, status), "article", "status") == {("one", "accepted"), ("two", "proposed")}
    assert as_set(manuscript.words_changed(revisions), "article", "r_id", "words_changed") == {("one", "R1", 1), ("two", "R1", 1)}
    edits = rows(A + "file string, n int, find string, replace string, nth int", ("p", "two", "s.tex", 1, "beta", "B", None))
    assert as_set(manuscript.apply_edits(files, edits), "project_id", "article", "text") == {
        ("p", "one", "alpha beta"), ("p", "two", "alpha B"), ("q", "one", "beta")}


def test_occurrences_count_from_one(rows):
    files = rows("file string, text string", ("a", "hello world"), ("b", "x"))
    edits = rows("file string, n int, find string, replace string, nth int", ("a", 1, "world", "X", 0))
    assert as_set(manuscript.edit_checks(files, edits), "hits", "problem") == {(1, "no such occurrence")}
    assert as_set(manuscript.apply_edits(files, edits), "file", "text", "problem") == {("a", "hello world", "no such occurrence"), ("b", "x", None)}


def test_logs_are_read_whole(rows):
    logs = rows("log string, text string", ("L", "! Stop.\n" + "x" * 5000 + "\nl.7 end"), ("M", "LaTeX Warning: " + "y" * 500 + ".\n\n"))
    assert as_set(manuscript.log_errors(logs), "log", "line") == {("L", 7)}
    assert [len(r.message) for r in manuscript.log_warnings(logs).collect()] == [500]


def test_disk_state_with_unknown_values(rows):
    v = rows("project_id string, node_id string, path string, size long, mtime long, hash string, v int",
             ("p", "a", "a", 1, 1, "old", 1), ("p", "a", "a", 2, 2, "x", 2), ("p", "b", "b", None, None, "x", 1), ("p", "c", "c", 1, 1, "x", 1),
             ("p", "d", "d", 5, 1, "x", 1), ("p", "e", "e", 1, 1, None, 1), ("p", "f", None, None, None, None, 1))
    d = rows("project_id string, path string, size long, mtime long, hash string", ("p", "a", 2, 2, None), ("p", "b", 1, 1, "y"), ("p", "c", 1, 1, None),
             ("p", "d", 6, 9, None), ("p", "e", 9, 9, "z"))
    got = staleness.disk_state(v, d)
    assert as_set(got, "node_id", "missing", "modified") == {("a", False, False), ("b", False, True), ("c", False, False), ("d", False, True), ("e", False, False)}


def test_removed_analyses_in_a_loop_and_in_a_chain(rows):
    tree = rows("project_id string, key string, parent string", ("p", "a", "b"), ("p", "b", "a"), ("p", "c", "a"), ("p", "top", None),
                *[("p", f"k{i}", f"k{i - 1}" if i else "top") for i in range(40)], ("p", "leaf", "k39"))
    gone = tree.where("key IN ('a', 'b') OR key LIKE 'k%'").select("project_id", "key")
    assert as_set(trees.remove_analysis(tree, gone), "key", "parent") == {("c", None), ("top", None), ("leaf", "top")}


def test_positions_keep_their_order_beyond_a_million(spark):
    path = spark.range(1).select(*[F.lpad(F.lit(str(n)), 10, "0").alias(f"c{i}") for i, n in enumerate((999_999, 1_000_000, 2_147_483_647))]).first()
    assert path.c0 < path.c1 < path.c2


def test_limits_count_per_project(rows):
    events = rows("project_id string, ts int, seq int, event string, actor string, node string", *[(p, t, t, "e", "u", "n") for p in "ab" for t in range(5)])
    assert as_set(history.history(events, limit=1), "project_id", "seq") == {("a", 4), ("b", 4)}
    assert history.timeline(events.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))).count() == 10
    files = rows("project_id string, path string", *[(f"p{i}", f"d{j}/f") for i in range(5) for j in range(3)])
    assert monitor.baseline_folders(files, 2).groupBy("project_id").count().where("count = 2").count() == 5


def test_search_reads_descriptions_and_lists(rows):
    nodes = rows("project_id string, node_id string, label string, type string, path string, grp string, description string, tags array<string>",
                 ("p", "T1", "Sets", "table", None, None, "fine mapping", ["bayes", "v2"]))
    edges = rows("project_id string, edge_id string, source string, target string, params map<string,string>")
    assert as_set(search.search_all_terms(nodes, edges, "mapping bayes"), "node_id") == {"T1"}
    assert as_set(search.search_scored(nodes, edges, "what about bayes"), "node_id", "score") == {("T1", 1)}


def test_merge_keeps_the_first_link_by_number(rows):
    edges = rows("project_id string, edge_id string, source string, target string, rel string", ("p", "E10", "a", "x", "feeds"), ("p", "E2", "b", "x", "feeds"))
    renames = rows("project_id string, dup string, keep string", ("p", "b", "a"))
    assert as_set(dedup.merge_edges(edges, renames), "edge_id") == {"E2"}


def test_every_overlap_is_named(rows):
    schema = "project_id string, owner string, path string, size long, hash string"
    old = rows(schema, *[("p", o, h, 1, h) for o, hs in {"A": "xy", "B": "yz", "C": "w", "D": "xyz"}.items() for h in hs])
    new = rows(schema, *[("p", "N", h, 1, h) for h in "xyz"], ("p", "M", "q", 1, "q"))
    got = {r.owner: (r.same_as, r.overlaps, r.all_overlaps) for r in dedup.classify_new(new, old).collect()}
    assert got == {"N": ("D", "A", ["A", "B"]), "M": (None, None, [])}
    big = rows(schema, ("p", "N", "f", 3_000_000_000, "h"), ("p", "O", "f", 3_000_000_000, "h"))
    assert as_set(dedup.batch_signature(big), "owner", "first") == {("N", "N"), ("O", "N")}


def test_traces_and_short_references_are_whole(rows):
    chain = rows("project_id string, edge_id string, source string, target string, rel string", *[("p", f"E{i}", f"n{i}", f"n{i + 1}", "feeds") for i in range(60)])
    seeds = rows("project_id string, seed string", ("p", "n60"))
    assert graph.traced_edges(chain, seeds, "up").count() == 60
    projects = rows("project_id string, name string, path string, slug string", ("1", "Lipids qz", "/a", "lipids-qz"), ("2", "Heart", "/b", "heart"))
    refs = rows("ref string", ("qz",), ("h",), ("i",))
    assert as_set(summary.resolve_project(refs, projects), "ref", "project_id", "problem") == {("qz", "1", None), ("h", "2", None), ("i", "1", None)}


def test_snapshot_numbers_are_not_used_twice(spark, rows, tmp_path):
    root = str(tmp_path / "catalog")
    assert catalog.current_snapshot(spark, root) == 0
    rows("n int", (1,)).write.parquet(f"{root}/snapshot-000001/nodes")  # begun by another load
    assert catalog.write_snapshot({"nodes": rows("n int", (2,))}, root) == 2
    assert [r.n for r in catalog.read_snapshot(spark, root)["nodes"].collect()] == [2]
