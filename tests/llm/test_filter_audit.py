import math
import random
from itertools import permutations

from strandline.llm import filter_audit as fa
from tests.llm.brute import WORD

DOCS = "doc_id long, text string, source string, mask int, n long, good int"
LABELS = "doc_id long, quality int, toxic int, n int"


def failed(docs):
    """(row, set of letters) by the definitions."""
    for i, text, source, *_ in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)}
        yield i, source or "", {k for k, v in fails.items() if v}


def plain(docs, labels):
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    rows = list(failed(docs))
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for i, p, f in rows if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = [(i, f) for i, f in mine if not f & set(order[:step])]
                gone = [(i, f) for i, f in before if letter in f]
                removed_by[letter] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(before) - len(gone), len(gone), sum(letter in f for _, f in mine) - len(gone), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


def corpus():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.randrange(30, 90))]
        words += rng.choice([[], ["#1"], ["A" * 30], ["ÉÀÜ" * 9]])
        texts.append(" ".join(words) if rng.random() < 0.8 else "\n\t".join(f"w{i}" for i in range(len(words))))
    texts += [texts[0], texts[0], texts[1], "", None, " \x0b\x0c", "é" * 100]
    docs = [(i, t, rng.choice(["a", "b", None, ""]), 1, 2, 3) for i, t in enumerate(texts)]
    docs += [(None, texts[0], "a", 1, 2, 3), (None, "", None, 1, 2, 3), (0, texts[0], "b", 1, 2, 3), (2, texts[0], "b", 9, 9, 9)]
    labels = [(i, rng.randrange(2), rng.randrange(2), 5) for i in range(0, 70, 2)] + [(2, 1, None, 5), (4, None, 1, 5), (None, 1, 1, 5), (999, 1, 1, 5)]
    rng.shuffle(docs)
    return docs, labels


def test_against_counting_every_order(spark, rows):
    docs, labels = corpus()
    assert got(fa.audit(fa.mask_weights(rows(DOCS, *docs), rows(LABELS, *labels)))) == plain(docs, labels)


def test_long_text_and_empty_table(spark, rows):
    long = " ".join(f"w{i % 700_000}" for i in range(1_000_000))
    docs = rows(DOCS, (1, long, "s", 0, 0, 0), (2, long, "s", 0, 0, 0), (3, long + " more", "t", 0, 0, 0))
    labels = rows(LABELS, (2, 1, 0, 0))
    weights = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in fa.mask_weights(docs, labels).collect()}
    assert weights == {("s", 0): (1, 0, 0), ("s", 16): (1, 1, 0), ("t", 0): (1, 0, 0)}
    assert fa.audit(fa.mask_weights(docs.limit(0), labels)).count() == 0
    assert fa.audit(fa.mask_weights(docs, labels.limit(0))).count() == 1200


def test_swaps_keep_the_weights_and_visit_every_order():
    rng = random.Random(8)
    for n in (1, 2, 3, 4):
        weights = {m: (rng.randrange(4), rng.randrange(3), rng.randrange(2)) for m in range(1 << n) if rng.random() < 0.7}
        total = tuple(sum(w[i] for w in weights.values()) for i in range(3))
        diagram = fa.Diagram(weights, n)
        seen = {tuple(diagram.order)}
        for place in fa.plain_changes(n):
            diagram.swap(place)
            seen.add(tuple(diagram.order))
            assert diagram.root.weight == total
            assert all(len(level) <= 1 << k for k, level in enumerate(diagram.levels[:-1]))
        assert len(seen) == math.factorial(n)
    # equal parts of a level are one node: a filter that tells nothing apart has one node
    assert [len(x) for x in fa.Diagram(dict.fromkeys(range(8), (1, 0, 0)), 3).levels] == [1, 1, 1, 1]
