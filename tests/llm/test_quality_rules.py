import random
import re

from pyspark.sql import functions as F

from strandline.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_exclaims": text.count("!"),
            "n_adjacent": sum(a == b for a, b in zip(words, words[1:], strict=False)), "n_letters": len(re.findall("[A-Za-z]", text)),
            "n_upper": len(re.findall("[A-Z]", text))}


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "one", "é# ü x y", "a b c d e f g h a b c d e f g h", "x " * 500, "l1 a\nl1 a\n l1 a\n\n\n", "A!\x0bB!\x0cC\rD", "w\n" * 30]
    for _ in range(40):
        out.append(rng.choice([" ", "\n"]).join(rng.choice(["a", "b", "Cé", "#", "d!"]) for _ in range(rng.randrange(60))))
    return out


def test_measures_against_a_plain_model(spark, rows, monkeypatch):
    docs = rows("doc_id long, text string, n_words int", *[(i, t, 1) for i, t in enumerate(texts())])
    got = {r.doc_id: r.asDict() for r in qr.ledger(docs).collect()}
    for i, t in enumerate(texts()):
        assert {k: got[i][k] for k in qr.MEASURES} == plain(t), t


def test_colliding_windows_are_counted_again():
    words = [[b"%d" % i for i in range(40)], [b"a"] * 20]
    assert [qr._repeated_words(w) for w in words] == [0, 20]


def test_policies_and_ablations(spark, rows):
    docs = rows("doc_id long, text string, kept string", (1, "### " * 30, "x"), (2, " ".join(f"w{i}" for i in range(30)), "y"), (None, None, None))
    entries = qr.ledger(docs)
    assert {r.doc_id: r.ok for r in qr.apply_policy(entries, qr.STRICT, "ok").collect()} == {1: False, 2: True, None: False}
    found = {r.rule: (r.n_failed, r.n_only) for r in qr.ablations(entries, qr.STRICT).collect()}
    assert found["symbols"] == (1, 0) and found["few_words"] == (1, 1) and found["capitals"] == (0, 0)
    assert {r.n_failed for r in qr.ablations(entries.limit(0), qr.STRICT).collect()} == {0}
    left = qr.reject_documents(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, " ".join(f"w{i}" for i in range(30)), "y")]
    assert qr.reject_documents(docs.limit(0)).count() == 0 and qr.BASE.mask == 3
    assert entries.agg(F.bit_or("fail_bits")).first()[0] == 0b100111
