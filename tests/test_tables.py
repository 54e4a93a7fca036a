import random

from conftest import as_set
from pyspark.sql import functions as F
from strandline.functions.words import canonical_value, common_label, looks_cosmetic
from strandline.operators import history, search, summary, trees, validate

TREE = "project_id string, key string, parent string, ord int, start string, title string, hidden boolean"


def tree(rows):
    return rows(TREE, ("p", "raw", None, 1, "", "Raw", False), ("p", "raw.qc", "raw", 1, "", "QC", True), ("p", "raw.pca", "raw", 2, "", "PCA", None),
                ("p", "gwas", None, 2, "", "GWAS", False), ("p", "gwas.rerun", "gwas", 1, "", "Rerun", False), ("p", "pre", "gwas.rerun", 0, "", "Pre", False))


def test_numbers_references_and_edits(rows):
    t = tree(rows)
    assert dict(as_set(trees.analysis_numbers(t), "key", "number")) == {
        "raw": "1", "raw.qc": "1.1", "raw.pca": "1.2", "gwas": "2", "gwas.rerun": "2.1", "pre": "2.1.0"}
    texts = rows("project_id string, id int, text string", ("p", 1, "see @raw.qc. and @nope (@gwas)"), ("p", 2, "none"))
    assert as_set(trees.expand_refs(texts, t), "id", "text") == {(1, "see 1.1 “QC”. and @nope (2 “GWAS”)"), (2, "none")}
    renamed, clashes = trees.rename_analysis(t.withColumn("summary", F.lit("@raw, @raw.qc, @rawer")), "raw", "input", ["summary"])
    assert as_set(renamed, "key") == {"input", "input.qc", "input.pca", "gwas", "gwas.rerun", "pre"}
    assert as_set(renamed.where("key = 'input.qc'"), "parent", "summary") == {("input", "@input, @input.qc, @rawer")} and clashes.count() == 0
    assert trees.rename_analysis(t, "raw", "gwas")[1].count() == 1
    gone = rows("project_id string, key string", ("p", "gwas"), ("p", "gwas.rerun"))
    assert as_set(trees.remove_analysis(t, gone).where("key = 'pre'"), "parent") == {None}
    checks = rows("project_id string, key string, parent string, status string", ("p", "raw", "raw.qc", None), ("p", "two words", None, None),
                  ("p", "x", "absent", None), ("p", "y", "raw", "odd"), ("p", "z", "raw", "done"))
    assert as_set(trees.check_analyses(checks, t), "key", "problem") == {
        ("raw", "loop"), ("two words", "key must be one word"), ("x", "unknown parent"), ("y", "unknown status")}


def test_nested_load(rows):
    doc = '[{"key": "raw", "children": [{"key": "qc", "children": [{"key": "deep"}]}, {"key": "pca", "order": 7}]}, {"key": "late", "parent": "qc"}]'
    flat = trees.flatten_tree(rows("project_id string, id int, json string", ("p", 1, doc)))
    ordered = trees.default_order(flat, F.lit(0))
    assert as_set(ordered, "key", "parent", "ord") == {("raw", None, 1), ("qc", "raw", 1), ("pca", "raw", 7), ("deep", "qc", 1), ("late", "qc", 2)}
    known = rows(TREE, ("p", "other", None, 1, "", "", False))
    assert trees.unknown_parents(flat, known).count() == 0
    lost = flat.where("key <> 'qc'")
    assert as_set(trees.unknown_parents(lost, known), "key") == {"deep", "late"}


def test_a_list_is_loaded_whole_or_not_at_all(rows):
    known = rows(TREE + ", color string", *[(p, k, None, n, "", k.upper(), False, "red") for p in "pqrstu" for n, k in enumerate(("raw", "old"))])
    doc = '[{"key": "raw", "order": 4, "children": [{"key": "qc"}, {"key": "pca", "title": "PCA"}]}, {"key": "late", "parent": "qc"}%s]'
    docs = rows("project_id string, id int, json string", ("p", 1, doc % ""), ("q", 1, doc % ', {"key": "x", "parent": "absent"}'),
                ("r", 1, doc % ', {"title": "no key"}'), ("s", 1, doc % ', {"key": "qc", "parent": "late"}'), ("t", 1, "[]"))
    problems, tree = trees.load_analysis_tree(docs, known)
    assert as_set(problems, "project_id", "problem") == {("q", "unknown parent"), ("r", "key must be one word"), ("s", "loop")}
    assert as_set(tree.where("project_id IN ('q', 'r', 's', 't', 'u')"), *tree.columns) == as_set(known.where("project_id <> 'p'"), *known.columns)
    assert as_set(tree.where("project_id = 'p'"), "key", "parent", "ord", "title", "color") == {
        ("raw", None, 4, "RAW", "red"), ("old", None, 1, "OLD", "red"), ("qc", "raw", 1, None, None), ("pca", "raw", 2, "PCA", None), ("late", "qc", 1, None, None)}
    _, tree = trees.load_analysis_tree(docs, known, replace=True)
    assert as_set(tree.where("project_id = 'p'"), "key", "title") == {("raw", None), ("qc", None), ("pca", "PCA"), ("late", None)}
    assert as_set(tree.where("project_id IN ('q', 't', 'u')"), "project_id", "key") == {("q", "raw"), ("q", "old"), ("u", "raw"), ("u", "old")}


def test_hiding(rows):
    """What only feeds hidden work goes too; things with no use, pinned or listed in visible work stay."""
    nodes = rows("project_id string, node_id string, hidden boolean", *[("p", n, h) for n, h in (
        ("cov", None), ("pl", None), ("script", None), ("qc", None), ("alone", None), ("pin", False), ("hand", True))])
    edges = rows("project_id string, source string, target string, rel string, script string", ("p", "cov", "pl", "feeds", "script"),
                 ("p", "pl", "qc", "documents", None), ("p", "pin", "pl", "feeds", None))
    analyses = rows(TREE, ("p", "prep", None, 1, "", "", True), ("p", "prep.sub", "prep", 1, "", "", False), ("p", "main", None, 2, "", "", False))
    listed = rows("project_id string, key string, node_id string", ("p", "prep.sub", "pl"), ("p", "main", "qc"), ("p", "prep", "qc"))
    got = dict(as_set(trees.hidden_nodes(nodes, edges, analyses, listed), "node_id", "reason"))
    assert got == {"pl": "part of hidden analysis prep.sub", "hand": "hidden", "cov": "only used by hidden items", "script": "only used by hidden items"}


def greedy(candidates):
    sets = {}
    for key, node in candidates:
        sets.setdefault(key, set()).add(node)
    taken, out = set(), set()
    for key, nodes in sorted(sets.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        left = nodes - taken
        if len(left) >= 2:
            out |= {(key, n) for n in left}
            taken |= left
    return out


def test_packing_follows_the_greedy_order(rows):
    rnd = random.Random(3)
    data = sorted({(f"s{rnd.randrange(25):02d}", f"n{rnd.randrange(40)}") for _ in range(150)})
    df = rows("project_id string, grp string, node_id string", *[("p", g, n) for g, n in data])
    assert as_set(summary.pack_groups(df, ["grp"]), "grp", "node_id") == greedy(data)


def test_group_suggestions(rows):
    nodes = rows("project_id string, node_id string, type string, step string, grp string, path string, label string", *[("p", *n) for n in (
        ("r1", "raw", "s", None, "a.vcf", "Cohort A genotypes"), ("r2", "raw", "s", None, "b.vcf", "Cohort B genotypes"), ("r3", "raw", "s", None, "c.vcf", "Other"),
        ("f1", "figure", "s", None, "x.png", "Manhattan one"), ("f2", "figure", "s", None, "y.png", "Manhattan two"), ("t", "table", "s", None, "t.tsv", "T"),
        ("pl", "pipeline", "s", None, "pl", "Pipe"))])
    edges = rows("project_id string, source string, target string, rel string", *[("p", *e) for e in (
        ("r1", "pl", "feeds"), ("r2", "pl", "feeds"), ("r3", "pl", "feeds"), ("pl", "f1", "produces"), ("pl", "f2", "produces"), ("pl", "t", "produces"))])
    listed = rows("project_id string, node_id string, label string", ("p", "r1", "cohorts"), ("p", "r2", "cohorts"))
    got = as_set(summary.group_suggestions(nodes, edges, listed), "name", "source", "node_id")
    assert got == {("cohorts", "history", "r1"), ("cohorts", "history", "r2"), ("Manhattan", "set", "f1"), ("Manhattan", "set", "f2")}


def test_words(rows):
    df = rows("a string, b string", ("Figure 1 (left)", "Figure 1 (right)"), ("alpha", "alpine"), ("same", "same"), ("run (a)", "run (b)"), ("plot", "plot two"))
    assert as_set(df.select("a", common_label(F.col("a"), F.col("b")).alias("l")), "a", "l") == {
        ("Figure 1 (left)", "Figure 1"), ("alpha", ""), ("same", "same"), ("run (a)", "run"), ("plot", "plot")}
    keys = ["font_size", "alpha", "la_marker", "point-size", "window_kb", "legendPos", "fig.size", "size"]
    got = dict(as_set(rows("k string", *[(k,) for k in keys]).select("k", looks_cosmetic(F.col("k")).alias("c")), "k", "c"))
    assert {k for k, c in got.items() if c} == {"font_size", "point-size", "fig.size"}
    raw = ["1", "1.0", "0.05", "abc", "true", '"1"', "[1, 2]", "5e-8"]
    got = dict(as_set(rows("k string", *[(k,) for k in raw]).select("k", canonical_value(F.col("k")).alias("c")), "k", "c"))
    assert got["1"] == got["1.0"] == "1" and got["abc"] == '"abc"' and got['"1"'] == '"1"' and got["true"] == "true" and got["[1, 2]"] == "[1,2]"


def test_projects(rows):
    df = rows("project_id string, name string, seq int, path string", ("a", "My Study", 1, "/x"), ("b", "My study!", 2, "/y"), ("c", "my study 2", 3, "/z"),
              ("d", "***", 4, "/w"))
    slugs = summary.project_slugs(df, F.lit(0))
    assert as_set(slugs, "project_id", "slug") == {("a", "my-study"), ("b", "my-study-3"), ("c", "my-study-2"), ("d", "project")}
    refs = rows("ref string", ("my-study",), ("/Z",), ("stud",), ("***",), ("none",), ("dy 2",))
    got = summary.resolve_project(refs, df.join(slugs, "project_id"))
    assert {(r["ref"], r["project_id"], r["problem"]) for r in got.collect()} == {
        ("my-study", "a", None), ("/Z", "c", None), ("stud", None, "ambiguous"), ("***", "d", None), ("none", None, "unknown"), ("dy 2", "c", None)}


def test_notes_log_and_pipelines(rows):
    log = rows("project_id string, key string, date string, seq int", ("p", "a", "2024-02", 1), ("p", "a", None, 2), ("p", "a", "2023", 3), ("p", "a", "2024-02", 4))
    assert as_set(history.analysis_log(log), "seq", "position") == {(2, 1), (3, 2), (1, 3), (4, 4)}
    updates = rows("project_id string, note_id string, status string, ts int, seq int", ("p", "n", "open", 1, 1), ("p", "n", "resolved", 2, 2), ("p", "n", None, 3, 3))
    assert as_set(summary.note_status(updates), "status") == {"resolved"}
    nodes = rows("project_id string, node_id string, type string, meta map<string,string>", ("p", "a", "pipeline", {"repo": "r", "commit": "c"}), ("p", "b", "pipeline", {"repo": "r"}))
    states = rows("project_id string, node_id string, state string", ("p", "a", "ok"))
    assert as_set(summary.pipeline_status(nodes, states), "node_id", "pushed", "code") == {("a", True, "saved"), ("b", False, "not saved")}
    events = rows("ts int, seq int, event string, actor string, node string, nodes array<string>", (1, 1, "save", "u", "a", None), (2, 2, "link", "u", None, ["a", "b"]), (3, 3, "save", "u", "c", None))
    assert as_set(history.history(events, "a"), "seq") == {1, 2} and as_set(history.history(events, limit=2), "seq") == {2, 3}
    assert summary.node_list(rows("node_id string, type string", ("z", "raw"), ("a", "table"), ("b", "raw"))).collect()[0]["node_id"] == "b"


def test_batch_rules(rows):
    B = "project_id string, batch_id string"
    head = rows(B + ", protocol int, summary string", ("p", "b1", 1, "x"), ("p", "b2", None, " "))
    assert as_set(validate.header(head), "batch_id", "rule") == {("b2", "protocol"), ("b2", "no_summary")}
    item = B + ", n string, label string, why string, text string, name string"
    t = rows(item, ("p", "b", "1", "", None, "", None), ("p", "b", "2", "l", "w", "t", "n"))
    assert as_set(validate.small_items(t, t, t, t), "rule", "subject") == {(r, "1") for r in (
        "save_without_reason", "branch_without_label", "branch_without_reason", "empty_note", "group_without_name")}
    listing = rows("project_id string, path string, size long, is_dir boolean", ("p", "big", 300_000_000, False), ("p", "dir", 0, True))
    nodes = rows(B + ", key string, type string, mode string, path string, dest string", ("p", "b", "k1", "raw", "managed", "big", None), ("p", "b", "k2", "table", "managed", "dir", "big"))
    assert as_set(validate.paths(nodes, listing), "subject", "rule") == {
        ("k1", "too_big_to_store"), ("k1", "raw_is_copied"), ("k2", "managed_folder"), ("k2", "destination_taken")}


def test_search(rows):
    nodes = rows("project_id string, node_id string, label string, type string, path string, grp string", ("p", "T1", "Credible sets", "table", None, None), ("p", "F1", "Plot", "figure", "a/locus.png", None))
    edges = rows("project_id string, edge_id string, source string, target string, params map<string,string>", ("p", "E1", "T1", "F1", {"coverage": "0.95"}))
    assert as_set(search.search_all_terms(nodes, edges, "LOCUS 0.95"), "node_id") == {"F1"}
    assert search.search_all_terms(nodes, edges, "locus credible").count() == 0
    assert as_set(search.search_scored(nodes, edges, "how was the credible coverage made"), "node_id", "score") == {("T1", 2), ("F1", 1)}
    assert search.search_params(nodes, edges, "which params").count() == 1


def test_subtree_sizes_in_doubling_steps(rows):
    import pytest
    chain = [("p", f"a{i}", f"a{i - 1}" if i else None) for i in range(20)]
    star = [("p", f"s{i}", "a19") for i in range(9)] + [("q", "a0", None), ("q", "z", "unknown")]
    got = as_set(trees.subtree_sizes(rows("project_id string, key string, parent string", *chain, *star)), "project_id", "key", "below")
    assert got == ({("p", f"a{i}", 19 - i + 9) for i in range(20)} | {("p", f"s{i}", 0) for i in range(9)}
                   | {("q", "a0", 0), ("q", "z", 0)})
    with pytest.raises(RuntimeError, match="loop"):
        trees.subtree_sizes(rows("project_id string, key string, parent string", ("p", "x", "y"), ("p", "y", "x")))


def test_packing_rounds_write_numbers(rows, monkeypatch):
    """What a round keeps of an open row is the artifact and the number of a set, not the set's names."""
    rnd, kept = random.Random(5), []
    data = sorted({(f"s{rnd.randrange(60):02d}", f"n{rnd.randrange(40)}") for _ in range(400)})
    written = summary.cut
    monkeypatch.setattr(summary, "cut", lambda df, name="cut", **more: (kept.append((name, set(df.columns))), written(df, name, **more))[1])
    df = rows("project_id string, grp string, node_id string", *[("p", g if g != "s00" else None, n) for g, n in data])
    named = {(g or "s00", n) for g, n in as_set(summary.pack_groups(df, ["grp"]), "grp", "node_id")}
    assert named == greedy(data)
    assert {frozenset(c) for name, c in kept if name == "open"} == {frozenset({"project_id", "node_id", "set"})}
