import random

import numpy as np
import pytest

from strandline.llm import suffix_dedup as sd
from tests.llm import brute

DOCS = "doc_id long, text string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage, line = words(rng, 120), words(rng, 12)
    base = words(rng, 300)
    texts = [words(rng, rng.randrange(5, 300)) for _ in range(25)]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(8)]
    texts += [f"{words(rng, 20)} {passage[rng.randrange(200):rng.randrange(300, 700)]}" for _ in range(12)]
    texts += [f"{words(rng, 20)}\n{line}\n{words(rng, 20)}" for _ in range(6)]
    for _ in range(8):
        edited = base.split()
        for _ in range(6):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(edited))
    texts += [base, base, "a" * 1000, "ab" * 300, "", None, "short", "short", "é" * 150, line * 9]
    return texts


def got(df):
    from pyspark.sql import functions as F

    rows = df.select("doc_id", "n_bytes", F.length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(((r[0], r[1], r[1] - r[2], r[3], r[4]) for r in rows), key=repr)


@pytest.mark.parametrize("group_max", [sd.GROUP_MAX, 2])
def test_against_brute_force(spark, rows, group_max):
    texts = corpus()
    docs = rows(DOCS, *[(i, t, 0) for i, t in enumerate(texts)])
    want = sorted(((i, *x) for i, x in enumerate(brute.remove_repeats(texts))), key=repr)
    assert sum(x[2] > 0 for x in want) > 30
    assert got(sd.remove_repeats(docs, group_max=group_max)) == want


def test_long_text_in_segments_and_null_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 500)
    rng = random.Random(6)
    passage = words(rng, 90)
    texts = [f"{words(rng, 200)} {passage} {words(rng, 200)}", f"{words(rng, 100)} {passage}", "z" * 2500]
    docs = rows(DOCS, (None, texts[0], 0), (None, texts[1], 0), (7, texts[2], 0)).repartition(3)
    want = sorted(brute.remove_repeats(texts))
    assert sorted(x[1:] for x in got(sd.remove_repeats(docs))) == want


def test_repeated_rows_and_empty_table(spark, rows):
    text = words(random.Random(1), 100)
    docs = rows(DOCS, (1, text, 0), (1, text, 0), (2, "tiny", 4))
    assert [x[2] for x in got(sd.remove_repeats(docs))] == [len(text.encode())] * 2 + [0]
    assert sd.remove_repeats(docs.limit(0)).count() == 0
    empty = sd.without_repeats(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def test_without_repeats_keeps_whole_characters_and_columns(spark, rows):
    shared = "é" * 150
    docs = rows("doc_id long, text string, n_chars long, spans string, kept int", (1, "a" + shared + "b", 152, "s", 1),
                (2, "cc" + shared + "d", 153, "t", 2), (3, None, None, None, None))
    left = {r.doc_id: r for r in sd.without_repeats(docs).collect()}
    assert left[1].text == "ab" and left[1].n_chars == 2 and left[2].text == "ccd" and left[2].spans == "t"
    assert left[3].text is None and left[3].kept is None


def test_sort_survives_colliding_hashes():
    rng = np.random.default_rng(3)
    chars = rng.integers(97, 99, (40, 30)).astype(np.uint8)
    group = np.repeat(np.arange(4), 10)
    suffixes = sd._Suffixes(chars, np.full(40, 30), group)
    suffixes.hashes[:] = 0  # every comparison is misled
    order, extent = suffixes.checked()
    plain = sorted(range(40), key=lambda i: (group[i], chars[i].tobytes()))
    assert [chars[i].tobytes() for i in order] == [chars[i].tobytes() for i in plain]
    assert all(extent[np.flatnonzero(np.diff(group) > 0)] == 0)
