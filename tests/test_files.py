import difflib
import fnmatch
import hashlib
import random
import re

from conftest import as_set
from pyspark.sql import functions as F
from strandline.functions.paths import glob_regex, guess_type, matches_any, stem, suffix
from strandline.operators import dedup, layout, monitor

FILE = "project_id string, owner string, path string, size long, hash string"


def test_owner_overlap_against_all_pairs(rows):
    rnd = random.Random(4)
    data = {f"o{i}": {f"h{rnd.randrange(6)}" for _ in range(rnd.randrange(1, 4))} for i in range(12)}
    data["o12"], data["o13"] = set(data["o0"]), set(data["o0"])
    files = rows(FILE, *[("p", o, f"{o}/{h}", 5000, h) for o, hs in data.items() for h in hs])
    classes, sets = dedup.owner_classes(files), dedup.shared_sets(files)
    asked = files.select("project_id", "owner").distinct()
    got = as_set(dedup.overlap_of(asked, classes, sets), "a", "b", "relation", "shared")
    want = {(a, b, "whole" if data[a] == data[b] else "partial", len(data[a] & data[b]))
            for a in data for b in data if a != b and data[a] & data[b]}
    assert got == want


def test_duplicates_need_size_and_another_place(rows):
    files = rows(FILE, ("p", "a", "x/1", 5000, "h"), ("p", "b", "y/2", 5000, "h"), ("p", "c", "z", 5000, "k"), ("p", "d", "t1", 10, "s"),
                 ("p", "e", "t2", 10, "s"))
    assert as_set(dedup.duplicate_members(files, 4096), "path") == {"x/1", "y/2"}


def test_contents_are_hashed_above_the_join_on_sizes(rows):
    listing = [("a", "x/1", 5, "apple"), ("b", "x/2", 5, "apple"), ("b", "x/3", 5, "peach"), ("c", "x/4", 9, "elsewhere"), ("c", "X/1", 5, "apple")]
    files = rows("project_id string, owner string, path string, size long", *[("p", o, p, s) for o, p, s, _ in listing])
    content = rows("project_id string, owner string, path string, content string", *[("p", o, p, c) for o, p, _, c in listing])
    groups = dedup.duplicate_groups(files, 1, content)
    assert as_set(groups, "hash", "size", "files", "owners_differ") == {(hashlib.sha256(b"apple").hexdigest(), 5, 3, True)}
    assert as_set(dedup.duplicate_members(files, 1, content), "owner", "path") == {("a", "x/1"), ("b", "x/2"), ("c", "X/1")}
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("sha2(") < plan.index("Join") and "sha2(" not in plan[plan.index("Join"):]


def test_merge(rows):
    edges = rows("project_id string, edge_id string, source string, target string, rel string, script string",
                 ("p", "E1", "a", "x", "feeds", None), ("p", "E2", "d", "x", "feeds", "d"), ("p", "E3", "d", "a", "derives", None),
                 ("p", "E4", "x", "d", "produces", "d"))
    renames = rows("project_id string, keep string, dup string", ("p", "a", "d"))
    assert as_set(dedup.merge_edges(edges, renames), "edge_id", "source", "target", "script") == {
        ("E1", "a", "x", None), ("E4", "x", "a", "a")}
    rec = rows("project_id string, node_id string, parent_id string, recorded int", ("p", "x", "d", 3), ("p", "x", "a", 1), ("p", "y", "d", 2))
    assert as_set(dedup.merge_recorded(rec, renames), "node_id", "parent_id", "recorded") == {("x", "a", 1), ("y", "a", 2)}


def test_hash_cache(rows):
    meta = "project_id string, path string, size long, mtime long"
    files = rows(meta, ("p", "a", 3, 1), ("p", "b", 3, 9), ("p", "c", 3, 99))
    content = rows("project_id string, path string, content binary", ("p", "a", b"aaa"), ("p", "b", b"bbb"), ("p", "c", b"ccc"))
    cache = rows(meta + ", hash string", ("p", "a", 3, 1, "known"), ("p", "b", 3, 8, "old"), ("p", "c", 3, 99, "racy"))
    got = {r["path"]: (r["hash"], r["reused"]) for r in dedup.content_hash(files, content, cache, F.lit(50)).collect()}
    import hashlib
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"a": ("known", True), "b": (sha(b"bbb"), False), "c": (sha(b"ccc"), False)}


def test_paths_and_globs(rows):
    names = ["a.TSV", "x/b.tsv.gz", "c.R", "d.tex", "noext", ".bashrc", "e.tar.gz", "x/.hidden/f.png"]
    got = dict(as_set(rows("p string", *[(n,) for n in names]).select("p", guess_type(F.col("p")).alias("t")), "p", "t"))
    assert got == {"a.TSV": "table", "x/b.tsv.gz": "table", "c.R": "script", "d.tex": "section", "noext": "result", ".bashrc": "result",
                   "e.tar.gz": "result", "x/.hidden/f.png": "figure"}
    for pattern in ("*.pyc", "*/logs/*", "a?[bc].txt", "x[!a]y", "~$*", "a+b(1).t"):
        for name in ("m.pyc", "a/b/m.pyc", "run/logs/x", "logs/x", "axb.txt", "axd.txt", "xby", "xay", "~$doc", "a+b(1).t"):
            assert bool(re.match(glob_regex([pattern]), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)
    df = rows("p string", ("deep/x.log",), ("ok.txt",)).select("p", matches_any(F.col("p"), ["*.log"]).alias("m"))
    assert dict(as_set(df, "p", "m")) == {"deep/x.log": True, "ok.txt": False}
    df = rows("p string", ("a.b.c",), (".x",)).select(stem(F.col("p")).alias("s"), suffix(F.col("p")).alias("e"))
    assert as_set(df, "s", "e") == {("a.b", ".c"), (".x", "")}


def test_version_candidates_against_every_pair(rows):
    rnd = random.Random(7)
    words = ["figure", "table", "plot", "final", "v2", "v10", "old", "gwas", "qc", "2024", "copy"]
    name = lambda: "_".join(rnd.sample(words, rnd.randrange(1, 4)))
    new = sorted({f"{rnd.choice(['a', 'a/b'])}/{name()}{rnd.choice(['.png', '.PNG', '.tsv'])}" for _ in range(60)})
    old = sorted({f"{rnd.choice(['a', 'a/b'])}/{name()}{rnd.choice(['.png', '.tsv'])}" for _ in range(60)})
    ids = {p: f"N{i:03d}" for i, p in enumerate(old)}
    got = {r["path"]: (r["node_id"], round(r["ratio"], 9)) for r in monitor.version_candidates(
        rows("project_id string, path string", *[("p", x) for x in new]),
        rows("project_id string, path string, node_id string", *[("p", x, i) for x, i in ids.items()])).collect()}
    split = lambda p: (p.rsplit("/", 1)[0], *[s.lower() for s in p.rsplit("/", 1)[1].rsplit(".", 1)])
    want = {}
    for p in new:
        folder, stem_, ext = split(p)
        best = [(-difflib.SequenceMatcher(None, stem_, split(o)[1]).ratio(), ids[o]) for o in old if split(o)[0] == folder and split(o)[2] == ext]
        if best and -min(best)[0] >= 0.72:
            want[p] = (min(best)[1], round(-min(best)[0], 9))
    assert got == want and want


def test_nearest_and_untracked(rows):
    tracked = rows("project_id string, path string, node_id string", ("p", "res/a.tsv", "T1"), ("p", "res/sub/deep/b.tsv", "T2"), ("p", "top.txt", "T0"))
    files = rows("project_id string, path string", ("p", "res/x"), ("p", "res/sub/x"), ("p", "res/sub/deep/er/x"), ("p", "other/x"), ("p", "results/x"),
                 ("p", "res/a.tsv"))
    assert dict(as_set(monitor.nearest_node(files, tracked), "path", "node_id")) == {
        "res/x": "T1", "res/sub/x": "T1", "res/sub/deep/er/x": "T2", "other/x": "T0", "results/x": "T0", "res/a.tsv": "T1"}
    folders = rows("project_id string, path string", ("p", "res"))
    assert as_set(monitor.untracked(files, tracked, folders), "path") == {"other/x", "results/x"}
    found = monitor.suggestions(files.where("path = 'res/x'"), tracked, rows("project_id string, node_id string, step string", ("p", "T1", "gwas")))
    assert as_set(found, "near", "step", "type") == {("T1", "gwas", "result")}


def test_relocate_leaves_siblings(rows):
    df = rows("path string", ("old_place/sub/x.tsv",), ("old_place_2/y.tsv",), ("old_place",), ("old_place\\w.tsv",))
    assert as_set(layout.relocated(df, "path", "old_place/", "/new"), "before", "after") == {
        ("old_place/sub/x.tsv", "/new/sub/x.tsv"), ("old_place", "/new"), ("old_place\\w.tsv", "/new/w.tsv")}


def test_rounds(rows):
    r = rows("project_id string, updated long, new long, stale long, missing long", ("p", 0, 0, 3, 0), ("q", 0, 1, 0, 0))
    assert as_set(r.withColumn("news", monitor.has_news(r)), "project_id", "news") == {("p", False), ("q", True)}
    log = rows("project_id string, t int", ("p", 0), ("p", 600)).selectExpr("project_id", "timestamp_seconds(t) AS ts")
    assert as_set(monitor.minutes_since_last(log, F.expr("timestamp_seconds(1200)")), "minutes") == {10.0}
    seen = rows("project_id string, path string", ("p", "a"), ("p", "b"), ("p", "c.log"))
    assert as_set(monitor.open_suggestions(seen, rows("project_id string, path string", ("p", "b"))), "path") == {"a"}


def test_numbered_names_meet_few(rows):
    """Numbered names meet those that differ in a digit; the best match is still that of all pairs."""
    def tables(n):
        names = [f"sample_{i:05d}" for i in range(n)]
        known = rows("place string, known string, node_id string", *[("f", x, f"N{x[-5:]}") for x in names])
        return rows("place string, stem string", *[("f", x) for x in names]), known

    # one of 5 digits goes and one of 10 comes in at one of 5 places: at most 250 for each name, whatever their number
    for n in (400, 6400):
        assert monitor.near_names(*tables(n), ["place"]).count() <= 250 * n
    stems = [f"run{i}" for i in range(0, 300, 2)] + ["run1x", "a", "ab", "xrun10y"]
    known = [f"run{i}" for i in range(1, 300, 2)] + ["run", "abcd", "xxrun10yy", "b"]
    got = {r["path"]: (r["node_id"], round(r["ratio"], 9)) for r in monitor.version_candidates(
        rows("project_id string, path string", *[("p", f"d/{x}.t") for x in stems]),
        rows("project_id string, path string, node_id string", *[("p", f"d/{x}.t", x) for x in known])).collect()}
    want = {}
    for x in stems:
        ratio, node = min((-difflib.SequenceMatcher(None, x, k).ratio(), k) for k in known)
        if -ratio >= 0.72:
            want[f"d/{x}.t"] = (node, round(-ratio, 9))
    assert got == want


def test_descriptions_of_merged_artifacts(rows):
    nodes = rows("project_id string, node_id string, description string", ("p", "D1", "keep"), ("p", "D2", "two"), ("p", "D10", "ten"), ("p", "D3", "keep"),
                 ("p", "E1", None), ("p", "E2", "only "), ("p", "F1", "same"), ("p", "F2", "am"), ("p", "F3", None))
    names = rows("project_id string, dup string, keep string", ("p", "D10", "D1"), ("p", "D2", "D1"), ("p", "D3", "D1"), ("p", "E2", "E1"), ("p", "F2", "F1"), ("p", "F3", "F1"))
    assert as_set(dedup.merge_descriptions(nodes, names), "node_id", "description") == {
        ("D1", "keep\n[also, as D2] two\n[also, as D10] ten"), ("E1", "[also, as E2] only")}
