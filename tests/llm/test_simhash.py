import random

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash as sh
from tests.llm.brute import WORD

DOCS = "doc_id long, text string, fp string, n int"


def plain_fp(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items):
    """smallest key of each component of (key, fingerprint) within 3 bits"""
    root = {k: k for k, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if (x ^ y).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in root}


def corpus():
    rng = random.Random(9)
    words = [f"w{i}É" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    base = [rng.choice(words) for _ in range(700)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper().lower(), texts[1].replace(" ", "\n\t"), "", None, " \x0c", "one", "one two", "ONE two", "one two three", "é" * 9]
    return texts


def test_against_all_pairs(spark, rows):
    texts = corpus()
    docs = list(enumerate(texts)) + [(3, texts[50]), (3, texts[50]), (40, "one two three")]
    got = sh.near_duplicates(rows(DOCS, *[(i, t, "z", 0) for i, t in docs], (None, texts[0], "z", 0)))
    got = got.select("doc_id", sh.as_hex(sh.F.col("fp")).alias("fp"), "component_id").collect()
    want = groups([(i, plain_fp(t)) for i, t in docs])
    assert sorted((r.doc_id, r.fp, r.component_id) for r in got if r.doc_id is not None) == sorted((i, f"{plain_fp(t):016x}", want[i]) for i, t in docs)
    assert [(r.fp, r.component_id) for r in got if r.doc_id is None] == [(f"{plain_fp(texts[0]):016x}", None)]
    assert len({want[i] for i in range(30, 90)}) < 40  # copies meet


def family(rng, n=400):
    """Fingerprints around a few centers, with chains of near ones and lonely ones."""
    found = {int(x) for x in rng.integers(0, 2**63, 50)} | {0, 1, 2**64 - 1, 2**63}
    center = int(rng.integers(0, 2**63))
    while len(found) < n:
        near = center
        for _ in range(int(rng.integers(1, 8))):
            near ^= 1 << int(rng.integers(0, 64))
        found.add(near)
        if rng.random() < 0.05:
            center = near
    return sorted(found)


@pytest.mark.parametrize(("chunk", "chunks"), [(sh.CHUNK, sh.CHUNKS), (3, 10**6), (2, 1)])
def test_links_connect_what_is_near(spark, rows, chunk, chunks):
    fps = family(np.random.default_rng(chunk))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = sh.block_links(rows("fp long", *[(f,) for f in signed]).repartition(3), chunk=chunk, chunks=chunks)
    pairs = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert {f: find(f) for f in fps} == groups([(f, f) for f in fps])


def test_a_dense_group_gives_a_forest():
    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 3000).astype(np.uint64))
    a, b = sh._forest(fps, fps, 3)
    assert len(a) == len(fps) - 1 and (np.bitwise_count(a ^ b) <= 3).all()
    one, two = fps[::2], fps[1::2]
    a, b = sh._forest(one, two, 3)
    assert (np.isin(a, one) != np.isin(b, one)).all()


def test_long_text_in_runs_and_empty_table(spark, rows, monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    assert sh.simhash(text.encode()) == plain_fp(text)
    one, two = np.random.default_rng(2).integers(0, 2**63, (2, 1000)).astype(np.uint64)
    assert (sh._bit_sums(one) + sh._bit_sums(two) == sh._bit_sums(np.concatenate((one, two)))).all()
    assert sh.near_duplicates(rows(DOCS, (1, "a", "", 0)).limit(0)).count() == 0
    alone = sh.near_duplicates(rows(DOCS, (None, None, "", 0), (None, "", "", 0), (5, "a b c", "", 0))).collect()
    assert sorted((r.component_id for r in alone), key=repr) == [5, None, None]
