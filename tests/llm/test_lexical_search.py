import math
import random
import re
from collections import Counter

import numpy as np

from strandline.llm import lexical_search as ls

DOCS = "doc_id long, text string, n long, terms string, score int"
ITEMS = "item_id long, text string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t, *_ in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    asked = {}
    for item, text, _ in items:
        asked.setdefault(item, set()).update(terms_of(text))
    for item, terms in asked.items():
        found = []
        for i, c in counted:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            found += [(-score, i is None, i)] if score > 0 else []
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    pick = lambda: words[int(299 * rng.random() ** 3)]
    texts = [" ".join(pick() for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    texts += [texts[0]] * 15 + ["", None, "...", "É é ÀB àb", "W1-w1_W1 w2\x00w3\x7fw4", "日本語 w1 日本語"]
    docs = [(i, t, 0, "x", 1) for i, t in enumerate(texts)] + [(7, texts[0], 0, "x", 1), (None, texts[0], 0, "x", 1), (None, "w1", 0, "x", 1)]
    items = [(k, " ".join(pick() for _ in range(rng.randrange(1, 40))), 0) for k in range(25)]
    items += [(50, None, 0), (51, "", 0), (52, "unseen", 0), (53, "É à", 0), (1, "日本語 w299", 0), (None, "w5 W6", 0), (54, texts[0], 0)]
    rng.shuffle(docs)
    return docs, items


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_against_adding_up_everything(spark, rows):
    docs, items = corpus()
    want = plain(docs, items)
    assert found(ls.search(rows(DOCS, *docs), rows(ITEMS, *items))) == want
    # many shards and blocks
    assert found(ls.search(rows(DOCS, *docs), rows(ITEMS, *items), shard=500, block=100)) == want
    assert found(ls.search(rows(DOCS, *docs), rows(ITEMS, *items), top=3)) == plain(docs, items, 3)


def test_empty_tables_and_long_texts(spark, rows):
    docs, items = corpus()
    assert ls.search(rows(DOCS, *docs).limit(0), rows(ITEMS, *items)).count() == 0
    assert ls.search(rows(DOCS, *docs), rows(ITEMS, *items).limit(0)).count() == 0
    long = [(1, "Wx " * 800_000 + "end", 0, "", 0), (2, "wx", 0, "", 0), (3, "other", 0, "", 0)]
    asked = [(1, "wx END", 0)]
    assert found(ls.search(rows(DOCS, *long), rows(ITEMS, *asked))) == plain(long, asked)


def test_walks_only_what_can_enter():
    rng = np.random.default_rng(5)
    for short, accumulated, step, top in [(1024, 1 << 16, 4096, 10), (0, 0, 64, 10), (300, 500, 16, 3), (10**9, 10**9, 512, 1)]:
        for _ in range(30):
            lists = []
            for _ in range(rng.integers(1, 9)):
                docs = np.flatnonzero(rng.random(5000) < rng.random() ** 4)
                lists += [(docs, rng.integers(0, 50, len(docs)) * 10)] if len(docs) else []
            docs, sums = ls.add_up(lists) if lists else (np.zeros(0, int), np.zeros(0, int))
            order = np.lexsort((docs, -sums))[:top]
            want = [(d, s) for d, s in zip(docs[order].tolist(), sums[order].tolist(), strict=True) if s > 0]
            got = ls.best(lists, top, short, accumulated, step)
            order = np.lexsort((got[0], -got[1]))
            assert list(zip(got[0][order].tolist(), got[1][order].tolist(), strict=True)) == want
    # a rare heavy term beside a frequent light one: the long list is looked up, not walked
    every = np.arange(100_000)
    rare = np.arange(0, 100_000, 50)
    walked = []
    ls.best([(every, np.full(100_000, 1)), (rare, np.arange(len(rare)) + 1000)], walked=walked)
    assert sum(walked) < 15_000


def test_filter_knows_every_query_term(spark, rows):
    terms = [f"t{i}é" for i in range(3000)]
    known = ls._Filter(ls._bitmap(rows("term string", *[(t,) for t in terms])))
    assert all(known[t.encode()] for t in terms)
    assert sum(known[f"other{i}".encode()] for i in range(3000)) < 10
