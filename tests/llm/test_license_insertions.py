import math
import random

import pytest

from strandline.llm import license_scan as ls

KNOWN = [ls.Template(*x) for x in sorted(ls.TEMPLATES.items())]


def found(text):
    return {h["license"]: h for h in ls.scan_text(text.encode(), KNOWN)[1]}


def slow_best(text, words, gap):
    """(words, first place) of the best chain, from all pairs of equal words."""
    ends = {}
    for i, x in enumerate(text):
        for j, y in enumerate(words):
            if x == y:
                n, first = max((v for (k, m), v in ends.items() if m < j and i - gap - 1 <= k < i), default=(0, i))
                ends[i, j] = n + 1, first
    return min(((-n, i - first, first) for (i, _), (n, first) in ends.items()), default=(0, 0, 0))


def test_words_inserted_into_a_notice():
    hit = found("one two licensed under the terms of the GNU General Public License as published by the Free Software Foundation, version 3")["GPL-3.0"]
    assert (hit["n_matched"], hit["coverage"], hit["first_word"]) == (9, 1.0, 2)


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_insertions_up_to_the_gap(name):
    rng = random.Random(name)
    words = ls.TEMPLATES[name].split()
    for most in (1, 5, len(words) // 2):
        text = [f"before{k}" for k in range(200)]
        for k, word in enumerate(words):
            text += [f"line{k}x{n}" for n in range(rng.randrange(most + 1) if k else 0)] + [word]
        hit = found(" ".join(text + ["after"] * 200))[name]
        assert (hit["coverage"], hit["first_word"]) == (1.0, 200)


def test_insertions_of_any_length_without_a_gap():
    text = "x licensed under the GNU General Public License " + "and so on " * 500 + "version 3 end"
    assert "GPL-3.0" not in found(text)
    hits = ls.scan_text(text.encode(), [ls.Template("GPL-3.0", ls.TEMPLATES["GPL-3.0"], math.inf)])[1]
    assert [(h["license"], h["coverage"], h["first_word"]) for h in hits] == [("GPL-3.0", 1.0, 1)]


@pytest.mark.parametrize("gap", [None, 3, math.inf])
def test_chains_and_alignments_against_all_pairs(gap):
    rng = random.Random(4)
    hits = lost = 0
    for _ in range(300):
        size = rng.randrange(1, 9)
        template = ls.Template("x", " ".join(str(rng.randrange(12)) for _ in range(size)), gap)
        text, wide = [], 12 if gap == math.inf else template.gap
        for _ in range(rng.randrange(1, 4)):
            for word in template.words:
                text += [b"%d" % rng.randrange(40) for _ in range(rng.choice((0, 0, 1, 3, wide, wide + 1)))]
                text += [word] if rng.random() < 0.9 else []
        places = {}
        for i, word in enumerate(text):
            if word in template.counts:
                places.setdefault(word, []).append(i)
        n, _, first = slow_best(text, template.words, template.gap)
        chains, got = template.candidates(places), template.best(text, places)
        if -n < template.need:
            assert chains == [] and got is None
            continue
        assert (chains[0][0], chains[0][1]) == (-n, first)
        most = max(len(ls.aligned(text[a:b + 1], template.words)) for _, a, b in chains)
        assert got is None and most < template.need or template.need <= got[0] <= most
        hits, lost = hits + 1, lost + (got is None)
    assert 100 < hits <= 300 and lost < hits / 10
