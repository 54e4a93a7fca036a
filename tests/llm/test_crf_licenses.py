import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import license_scan as ls
from strandline.llm import line_crf as crf


def test_marginals_against_every_labelling():
    rng = np.random.default_rng(1)
    pairs = rng.normal(size=(2, 2))
    sizes = [1, 4, 2, 5]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    unary = rng.normal(size=offsets[-1])
    ahead, back = crf.Chains(offsets).messages(unary, pairs)
    got = 1 / (1 + np.exp(-(ahead + back)))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        weight = np.zeros((b - a, 2))
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            value = sum(unary[a + t] * y for t, y in enumerate(labels)) + sum(pairs[x, y] for x, y in zip(labels, labels[1:], strict=False))
            for t, y in enumerate(labels):
                weight[t, y] += np.exp(value)
        assert np.allclose(got[a:b], weight[:, 1] / weight.sum(axis=1))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = crf.score(docs, crf.train(docs, labels)).join(labels, "doc_id").where(crf.held_out(F.col("doc_id")))
    right, n = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_scores_of_odd_rows(spark, rows):
    docs = rows("doc_id long, text string, score int, quality int", (1, "good line of words here\n" * 3, 1, 1), (2, None, 1, 1), (3, "", 1, 1), (None, " \n\t", 1, 1),
                (1, "good line of words here\n" * 3, 1, 1), (4, "### $$$ ***\n" * 2000, 1, 1))
    labels = rows("doc_id long, quality int, toxic int", (1, 1, 0), (4, 0, 0), (3, None, 0), (None, 1, 0))
    for field in (crf.Field.blank(), crf.train(docs, labels)):
        got = crf.score(docs, field).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and sum(r.n_lines for r in got) == 3 + 3 + 3 + 2000
    assert crf.score(docs, crf.train(docs, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.5
    assert crf.score(docs.limit(0), crf.Field.blank()).count() == 0


def slow_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_against_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        template = [b"%d" % rng.randrange(30) for _ in range(rng.randrange(1, 20))]
        text = [w for w in template if rng.random() < 0.9] + [b"%d" % rng.randrange(60) for _ in range(rng.randrange(5))]
        pairs = ls.aligned(text, template)
        assert all(text[i] == template[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= slow_common(text, template)
        # where no word is unique, all equal words compete
        assert len(ls.aligned([b"x", *text, *text, b"y"], template * 2)) == slow_common([b"x", *text, *text, b"y"], template * 2)
        assert ls.matched_words(template, template) == len(template)


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_planted_licenses_are_found(name):
    rng = random.Random(name)
    known = [ls.Template(*x) for x in sorted(ls.TEMPLATES.items())]
    noise = ["the", "of", "license", "under", "software", "to", "and", "word", "this"]
    words = ls.TEMPLATES[name].split()
    for drop in (0, len(words) // 10):
        kept = list(words)
        for _ in range(drop):
            kept.pop(rng.randrange(len(kept)))
        for size in (0, 50, 3000):
            text = " ".join([rng.choice(noise) for _ in range(size)] + kept + [rng.choice(noise) for _ in range(size)])
            assert name in [h["license"] for h in ls.scan_text(text.encode(), known)[1]]
    clean = " ".join(rng.choice(noise) for _ in range(3000))
    assert ls.scan_text(clean.encode(), known)[1] == []


def test_the_alignment_decides(monkeypatch):
    text = b"This file is Licensed under the Apache License, Version 2.0 and that is all"
    known = [ls.Template(*x) for x in sorted(ls.TEMPLATES.items())]
    assert [h["license"] for h in ls.scan_text(text, known)[1]] == ["Apache-2.0"]
    monkeypatch.setattr(ls, "aligned", lambda text, template: [])
    assert ls.scan_text(text, known)[1] == []


def test_long_texts_with_many_statements():
    words = ls.TEMPLATES["BSD-3-Clause"]
    known = [ls.Template(*x) for x in sorted(ls.TEMPLATES.items())]
    n, hits = ls.scan_text(("the of and software " * 50000 + words + " license under the " * 50000 + words).encode(), known)
    by_name = {h["license"]: h for h in hits}
    assert by_name["BSD-3-Clause"]["coverage"] == 1.0 and by_name["BSD-3-Clause"]["first_word"] == 200000 and n > 350000


def test_scan_of_odd_rows(spark, rows):
    docs = rows("doc_id long, text string, licenses int", (1, None, 0), (2, "", 0), (None, "Released under the MIT License.", 0), (2, "", 0))
    got = sorted(((r.doc_id, r.n_words, [x.license for x in r.licenses]) for r in ls.scan(docs).collect()), key=repr)
    assert got == [(1, 0, []), (2, 0, []), (2, 0, []), (None, 5, ["MIT"])]
    assert ls.scan(docs.limit(0)).count() == 0
