import random
import re

from conftest import as_set
from pyspark.sql import functions as F
from strandline.functions import markup as marks
from strandline.operators import manuscript, markup
from strandline.plans import materialize

TEXTS = [
    "", "plain words here -- and more", r"We \textbf{found} 5\% of % a comment \n" + "\nnew line", r"see \figref[A]{1} and \ref{x}, $a+b$ \AUCJoint{} ok~now",
    "\\begin{table}\\caption{A title}\\begin{tabular}{ll}\n1 & 2\\\\\n\\end{tabular}\\end{table} tail", r"\cite{a,b}\ev{E1,E2} word \section{Head} x",
    r"\label{a}[b]{c} \citep[see][p. 3]{k} end", "caf\u00e9\u00a0au lait 3-4",
]


def python_count(text):
    for pattern, by in marks.STRIPPING:
        flags = re.S if pattern.startswith("(?s)") else 0
        text = re.sub(pattern.replace("(?d)", "").replace("(?s)", "").replace("*+", "*"), by, text, flags=flags)
    return sum(1 for w in re.split(r"[\s{}\[\]]+|--+", text) if re.search("[A-Za-z0-9]", w))


def test_word_count(rows):
    df = rows("id int, text string", *enumerate(TEXTS)).select("id", marks.markup_word_count(F.col("text")).alias("n"))
    assert dict(as_set(df, "id", "n")) == {i: python_count(t) for i, t in enumerate(TEXTS)}
    long = rows("text string", ("\\cite" + "{a}" * 20000 + " end",)).select(marks.markup_word_count(F.col("text")).alias("n"))
    assert long.first()["n"] == 1


def test_sections(rows):
    df = rows("article string, file string, text string", ("a", "f", r"intro \section{One} a b \subsection*{Two} c \section{Three}"))
    assert as_set(markup.section_words(df), "pos", "heading", "words") == {(0, "(opening)", 1), (1, "One", 2), (2, "\u2003Two", 1), (3, "Three", 0)}


def test_unmarked_gaps_and_tables(rows):
    text = "\n".join([
        r"\section{Results 2024}", r"We saw 12 cases. Here is \ev{E1} 13. Then 14 more.", r"Locus chr6 and rs123 and TP53 do not count.",
        r"\begin{tabular}{l}", r"15 \ev{E2}\\ 16", r"17 & 18", r"\end{tabular} and 19", r"plain 20 here", "% 21", r"\item 22", r"Odd 23 gap here"])
    files = rows("article string, file string, text string", ("a", "f", text), ("a", "g", "no markers 5"), ("a", "h", "% GENERATED\n\\ev{E1} 7\n 8"))
    got = as_set(markup.unmarked_numbers(files), "line", "claim")
    assert got == {(2, "We saw 12 cases."), (2, "Then 14 more."), (8, "plain 20 here"), (11, "Odd 23 gap here")}
    gaps = rows("file string, anchor string, cause string", ("f", "Odd 23", ""), ("f", "14 more.\nLocus", "known"), ("f", "absent", ""), ("f", "1", ""))
    located = markup.gap_locations(gaps, files)
    assert as_set(located, "anchor", "line", "stale", "explained") == {
        ("Odd 23", 11, False, False), ("14 more.\nLocus", 2, False, True), ("absent", None, True, False), ("1", None, True, False)}
    assert as_set(markup.unmarked_numbers(files, markup.gap_spans(located)), "line", "claim") == {(2, "We saw 12 cases."), (8, "plain 20 here")}


def test_markers_and_evidence(rows):
    files = rows("article string, file string, text string", ("a", "f.tex", "x \\ev{E1, E2} % \\ev{E9}\n5\\% \\ev{E3} \\tabref{1}\\figref[A]{2} \\supref{S1}"))
    uses = markup.marker_uses(files)
    assert as_set(uses, "name", "line") == {("E1", 1), ("E2", 1), ("E3", 2), ("@T1", 2), ("@F2", 2), ("@S1", 2)}
    evidence = rows("id string, target string, note string", ("E1", "r1", ""), ("E1", "r1", ""), ("E2", "T1", "MISMATCH x"), ("E4", "../x", ""), ("bad", "", ""))
    assets = rows("key string, file string", ("T1", "Tables/t1.tsv"), ("F2A", "Figures/f.pdf"))
    assert as_set(markup.evidence_problems(evidence, uses, assets), "problem", "name") == {
        ("bad id", "bad"), ("listed twice", "E1"), ("not in the register", "E3"), ("asset not registered", "S1"), ("unused", "E4")}
    present = rows("path string", ("CitedArticles/r1.pdf",), ("../x",))
    targets = markup.evidence_targets(evidence.dropDuplicates(["id"]), rows("key string, file string", ("r1", "r1.pdf")), assets, present)
    assert as_set(targets, "id", "kind", "path", "problem") == {
        ("E1", "cite", "CitedArticles/r1.pdf", None), ("E2", "asset", "Tables/t1.tsv", "asset missing"),
        ("E4", "file", None, "not a file in the folder"), ("bad", "file", None, "no target")}


def test_quotes(rows):
    pages = rows("doc string, page_no long, text string", ("d", 1, "The quick brown\n fox jumps over it."), ("d", 2, "quick brown fox jumps high; of\ufb01ce hours"),
                 ("e", 7, "nothing but hyphen-\nation and \u201cquoted\u201d text"))
    quotes = rows("quote_id string, quote string, want long, doc string", ("long", "quick brown fox jumps", None, None), ("want", "QUICK brown fox jumps", 2, None),
                  ("edge", "ick brown fox ju", None, "d"), ("lig", "office hours", None, None), ("hyph", "hyphenation and 'quoted' te", None, None),
                  ("one", "igh", None, None), ("two", "ox jum", None, "d"), ("none", "quick fox brown jumps", None, None), ("other", "brown fox", None, "e"))
    assert as_set(markup.match_quotes(quotes, pages), "quote_id", "doc", "page_no", "how") == {
        ("long", "d", 1, "text"), ("want", "d", 2, "text"), ("edge", "d", 1, "text"), ("lig", "d", 2, "text"), ("hyph", "e", 7, "text"),
        ("one", "d", 2, "text"), ("two", "d", 1, "text"), ("none", None, None, "not found"), ("other", "e", None, "not found")}


def plain_quotes(quotes, pages):
    """(quote, document, page, how) by looking at every page for every quote."""
    glued = ".,;:()[]'\""
    normal = lambda s: re.sub(r"\s+", " ", re.sub(r"-\s*\n\s*", "", s)).strip().lower()
    bare = lambda s: [w.strip(glued) for w in normal(s).split(" ")]
    out = set()
    for name, quote, want, asked in quotes:
        hits = {}
        for doc, page, text in pages:
            if normal(quote) and asked in (None, doc):
                q, words = bare(quote), bare(text)
                follow = any(words[i:i + len(q)] == q for i in range(len(words) - len(q) + 1))
                how = "text" if normal(quote) in normal(text) else "words" if follow else None
                if how:
                    hits.setdefault(doc, []).append((how, page != want, page))
        out |= {(name, doc, min(found)[2], min(found)[0]) for doc, found in hits.items()} or {(name, asked, None, "not found")}
    return out


def test_quotes_against_every_page(rows):
    rnd = random.Random(6)
    words = ["alpha", "be", "c", "(be)", "be,", "alphabet", "c.", "\"c", "d;e", "...", "ab", "(", "al"]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    pages = [(rnd.choice("xyz"), n, some(rnd.randrange(0, 25)).replace(" ", rnd.choice([" ", "\n", "  "]))) for n in range(40)]
    quotes = [(f"q{i}", some(rnd.choice([1, 1, 2, 2, 3, 4, 5, 6])), rnd.choice([None, 3, 7]), rnd.choice([None, None, "x", "w"])) for i in range(70)]
    quotes += [("blank", " \n", None, None), ("inside", "ph", None, None), ("across", "ha b", None, None)]
    got = markup.match_quotes(rows("quote_id string, quote string, want long, doc string", *quotes), rows("doc string, page_no long, text string", *pages))
    assert as_set(got, "quote_id", "doc", "page_no", "how") == plain_quotes(quotes, pages)
    assert {"text", "words", "not found"} == {h for *_, h in plain_quotes(quotes, pages)}


def test_a_long_list_of_quotes_gives_the_same(rows, monkeypatch):
    monkeypatch.setattr(materialize, "FEW_ROWS", 0)
    test_quotes(rows)
    test_quotes_against_every_page(rows)


def test_few_quotes_leave_the_pages_in_place(spark, rows):
    rnd = random.Random(11)
    pages = [("d", n, " ".join(f"{rnd.getrandbits(32):08x}" for _ in range(200))) for n in range(300)]
    words = pages[7][2].split(" ")
    quotes = [("two", f"{words[3][4:]} {words[4][:1]}", None, None), ("long", " ".join(words[10:16]), None, None)]
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    got = markup.match_quotes(rows("quote_id string, quote string, want long, doc string", *quotes), rows("doc string, page_no long, text string", *pages))
    assert as_set(got, "quote_id", "doc", "page_no", "how") == plain_quotes(quotes, pages)
    assert shuffled() - before < sum(len(text) for *_, text in pages) / 4


def test_where(rows):
    lines = rows("table string, line int, text string", ("t", 1, "Gene\tP"), ("t", 2, "TP53\t0.01"), ("t", 3, "BRCA1\t0.5"), ("u", 1, "x"))
    places = rows("table string, where string", ("t", "sheet=S1; find=tp53&0.01|nothing ; row=3"), ("u", ""))
    assert as_set(markup.find_rows(lines, places), "table", "line") == {("t", 2), ("t", 3)}


def test_edits_in_order(rows):
    files = rows("file string, text string", ("a", "one two two three"), ("b", "x"), ("c", "aaa"), ("d", "same"))
    edit = "file string, n int, find string, replace string, nth int"
    edits = rows(edit, ("a", 1, "two", "2", 2), ("a", 2, "two", "TWO", None), ("a", 3, "TWO 2", "both", None), ("b", 1, "x", "y", None), ("b", 2, "x", "z", None),
                 ("c", 1, "a", "b", None))
    for per_round in (256, 1, 2):
        got = as_set(manuscript.apply_edits(files, edits, per_round), "file", "text", "failed", "problem")
        assert got == {("a", "one both three", None, None), ("b", "x", 2, "not found"), ("c", "aaa", 1, "ambiguous"), ("d", "same", None, None)}


def test_revisions(rows):
    hunks = rows("proposal string, state string", ("P1", "accepted"), ("P1", "accepted"), ("P2", "rejected"), ("P3", "accepted"), ("P3", "conflict"), ("P4", "open"))
    status = manuscript.proposal_status(hunks)
    assert as_set(status, "proposal", "status", "conflicts") == {("P1", "accepted", 0), ("P2", "rejected", 0), ("P3", "resolved", 1), ("P4", "open", 0)}
    revisions = rows("r_id string, proposal string, status string", ("R1", "P1", "proposed"), ("R2", "P1, P2", "proposed"), ("R3", "P2", "accepted"), ("R4", "P1, P9", "proposed"),
                     ("R5", "", "proposed"), ("R6", "P1", "open question"))
    assert dict(as_set(manuscript.revision_status(revisions, status), "r_id", "status")) == {
        "R1": "accepted", "R2": "proposed", "R3": "rejected", "R4": "proposed", "R5": "proposed", "R6": "open question"}
    pairs = rows("id int, before string, after string", (1, "AUC was 0.765 in all", "AUC was 0.80 in all sets"), (2, "a b", "c d e"), (3, "", "new"))
    assert as_set(manuscript.change_profile(pairs), "id", "removed", "added", "kept", "rewrite") == {(1, 1, 2, 4, False), (2, 2, 3, 0, True), (3, 0, 1, 0, False)}


def test_doi_and_logs(rows):
    texts = rows("text_id int, text string", (1, "see 10.1 and doi: 10.1000/ab c"), (2, "10.1000/abc 10.2000/x"), (3, "10.100 0/ABCD"), (4, "no"))
    refs = rows("ref string, doi string", ("r1", "10.1000/ABC"), ("r2", "10.2000/x"), ("r3", "https://doi.org/10.1000/abc"))
    assert as_set(markup.match_doi(texts, refs), "text_id", "ref") == {(1, "r1"), (3, "r1")}
    logs = rows("log string, text string", ("a", "./s/x.tex:12: Bad thing\nx\n./s/x.tex:12: Bad thing\nmain.tex:3: Other"), ("b", "! Stop.\nmore\nl.45 here\n! Again.\n"), ("c", "fine"))
    assert as_set(manuscript.log_errors(logs), "log", "file", "line", "message") == {
        ("a", "s/x.tex", 12, "Bad thing"), ("a", "main.tex", 3, "Other"), ("b", None, 45, "Stop."), ("b", None, None, "Again.")}


def test_doi_of_any_length_against_brute_force(rows):
    rnd = random.Random(6)
    piece = lambda n: "".join(rnd.choice("ab1./") for _ in range(n))
    dois = [(f"r{i}", "10." + piece(rnd.randrange(3, 12))) for i in range(40)] + [("long", "10." + "x" * 10000), ("far", "doi:10.ab"), ("none", "x"), ("null", None)]
    texts = [(i, " ".join(piece(rnd.randrange(6)) + rnd.choice(dois[:40])[1].upper() + piece(rnd.randrange(4)) for _ in range(rnd.randrange(3)))) for i in range(80)]
    texts += [(80, "see 10." + "x" * 10001), (81, "x 10." + "x" * 9000), (82, None), (83, "doi: 10. ab"), (84, "")]
    want = set()
    for i, text in texts:
        flat = "".join((text or "").split()).lower()
        hits = [r for r, d in dois if d and "10." in d and d in flat]
        want |= {(i, hits[0])} if len(hits) == 1 else set()
    got = markup.match_doi(rows("text_id int, text string", *texts), rows("ref string, doi string", *dois))
    assert as_set(got, "text_id", "ref") == want and (80, "long") in want and len(want) > 20
    assert markup.match_doi(rows("text_id int, text string", *texts), rows("ref string, doi string")).count() == 0
