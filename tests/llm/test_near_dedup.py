import random

import numpy as np
import pytest

from strandline.llm import near_dedup as nd

DOCS = "doc_id long, text string, component_id int"


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain(docs, n):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingle_set(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(80)]
    docs = [[rng.choice(words) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    passage = [rng.choice(words) for _ in range(50)]
    docs += [passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 16))] for _ in range(40)]
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        docs.append(copy)
    texts = [" ".join(d) for d in docs]
    texts += [texts[0], texts[0].upper(), "", None, " \n", "a", "A", "a b", "a b c d", "a b c d e", "a b c d e f", "x y z y x y z"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n", [2, 5])
def test_components_against_all_pairs(spark, rows, n):
    docs = corpus()
    got = {r.doc_id: r for r in nd.near_duplicates(rows(DOCS, *[(i, t, 1) for i, t in docs]), n).collect()}
    want = plain(docs, n)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) and r.n_shingles == len(shingle_set(dict(docs)[i], n)) for i, r in got.items())


def test_odd_rows(spark, rows):
    text = "one two three four five six"
    docs = rows(DOCS, (3, text, 1), (3, text, 1), (None, text, 1), (1, text + " seven", 1), (2, None, 1))
    got = sorted((tuple(r) for r in nd.near_duplicates(docs, 2).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == [(1, 1, True), (2, 2, True), (3, 1, False), (3, 1, False), (None, None, True)]
    kept = nd.keep_one(docs, 2)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, None]
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.keep_one(docs.limit(0)).count() == 0


def test_estimate_and_compression():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)))
    registers = nd._registers(np.concatenate((a, b)), np.array([0, 400, 800]))
    jaccard, filled = nd.estimated_jaccard(registers[:1], registers[1:])
    assert abs(jaccard[0] - 0.6) < 0.12 and filled[0] == nd.REGISTERS
    zeros = nd._leading_zeros(np.array([1 << 60, (1 << 60) - 1, 1 << 20], np.uint64))
    assert zeros.tolist() == [0, 1, 40]


def test_columns_with_clashing_names(spark, rows):
    docs = rows("doc_id long, text string, _kept long, kept boolean", (1, "a b c d e f", 1, True), (2, "a b c d e f", 2, False), (None, "x", 3, None))
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns and sorted((tuple(r) for r in kept.collect()), key=repr) == [(1, "a b c d e f", 1, True), (None, "x", 3, None)]
