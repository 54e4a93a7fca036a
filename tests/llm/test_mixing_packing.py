import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(rows, n=120, seed=2):
    rng = random.Random(seed)
    data = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 40, 200]))), "en",
             rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(n)]
    data += [(n, None, None, "tiny", None), (None, "one two", None, "b", None), (5, "again x", "en", "b", 0), (5, "again x", "en", "b", 0)]
    return rows(DOCS, *data)


def water(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        now = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and now[s] > 3 * sizes[s]}
        if not over:
            return now
        capped |= over


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_targets_and_taken(spark, rows, block):
    docs = make(rows)
    out = mixing.taken_words(docs, block).collect()
    source = {r.source_no: r for r in out}
    sizes = {}
    for r in docs.select("source", mixing.word_count(F.col("text")).alias("n")).collect():
        sizes[r.source] = sizes.get(r.source, 0) + r.n
    want = water(sizes)
    names = {i + 1: s for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    assert len(out) == docs.count() and set(source) == set(names)
    for no, name in names.items():
        taken = sum(r.taken for r in out if r.source_no == no)
        assert source[no].target == pytest.approx(want[name]) and taken == int(source[no].target)
    assert all(0 <= r.taken <= 3 * r.size for r in out)


def test_schedule_keeps_shares_in_every_stretch(spark, rows):
    targets = rows("source_no int, target double", (1, 5000.0), (2, 2000.0), (3, 1000.0), (4, 0.0))
    slots = sorted(tuple(r) for r in mixing.schedule(targets, 4).collect())
    for no, blocks in ((1, 1250), (2, 500), (3, 250)):
        assert sorted(r for _, s, r in slots if s == no) == list(range(blocks))
    for at in range(0, 1800, 200):
        part = [s for _, s, _ in slots[at:at + 200]]
        assert abs(part.count(1) - 125) <= 4 and abs(part.count(3) - 25) <= 4
    assert mixing.schedule(targets.where("source_no = 4"), 4).count() == 0


def test_documents_as_the_mix_takes_them(spark, rows):
    docs = make(rows)
    mixed = mixing.mix_documents(docs, 16)
    assert mixed.columns == docs.columns
    got = {r[0]: r[1] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    want = {r[0]: r[1] for r in mixing.taken_words(docs, 16).groupBy("doc_id").agg(F.sum("taken")).collect() if r[1]}
    assert got == want
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.taken_words(docs.limit(0)).count() == 0


def plain_slots(targets, block):
    """(source, rank) -> slot, from golden-ratio points taken one by one; `targets` are (source number, target) in order."""
    blocks = {no: -(-int(t) // block) for no, t in targets}
    total, upto, bounds = sum(t for _, t in targets if t), 0.0, []
    for no, t in targets:
        if blocks[no]:
            upto += t
            bounds.append((int(upto / total * 2**32), no))
    n = sum(blocks.values())
    n += n // 64 + 64
    next_rank, slots = dict.fromkeys(blocks, 0), {}
    for slot in range(n):
        point = slot * mixing.GOLDEN % 2**32
        no = next((no for high, no in bounds if point < high), bounds[-1][1])
        if next_rank[no] < blocks[no]:
            slots[no, next_rank[no]] = slot
        next_rank[no] += 1
    for no in blocks:
        for rank in range(min(next_rank[no], blocks[no]), blocks[no]):
            slots[no, rank] = n + no
    return slots


def test_the_schedule_decides_slots_and_order(spark, rows):
    """First slots against the points; the mixed documents stand in the order of their slots."""
    data = [(i, " ".join(f"d{i}w{k}" for k in range(5 + i % 7)), "en", "abc"[i % 5 % 3], 0) for i in range(90)]
    docs, block = rows(DOCS, *data), 16
    out = mixing.taken_words(docs, block).collect()
    targets = sorted({(r.source_no, r.target) for r in out})
    slots = plain_slots(targets, block)
    placed, _ = mixing._placed(docs, 0)
    at = {r.doc_id: (r.source_no, r.start) for r in placed.collect()}
    want = {i: slots.get((no, start // block)) for i, (no, start) in at.items()}
    got = {r.doc_id: r.first_slot for r in out if r.taken}
    assert got == {i: want[i] for i in got} and len(set(got.values())) > 20
    # not the ranks of the blocks: sources take turns
    assert any(slot != at[i][1] // block for i, slot in got.items())
    mixed = [(r.doc_id, r.text) for r in mixing.mix_documents(docs, block).collect()]
    seen, places = {}, []
    for i, _ in mixed:
        no, start = at[i]
        size = next(r.source_size for r in out if r.doc_id == i)
        places.append(slots[no, (seen.get(i, 0) * size + start) // block])
        seen[i] = seen.get(i, 0) + 1
    assert places == sorted(places)
    assert sum(a != b for a, b in itertools.pairwise(at[i][0] for i, _ in mixed)) > len(mixed) // 3


def test_a_cut_document_keeps_its_lines(spark, rows):
    text = " one\ttwo \n\n three  four\x0b"
    got = rows("t string, n int", *[(text, n) for n in range(1, 6)]).select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [" one", " one\ttwo", " one\ttwo \n\n three", " one\ttwo \n\n three  four", None]
    long = rows("t string, n int", ("w " * 200_000, 150_000)).select(F.length(mixing.first_words(F.col("t"), F.col("n"))).alias("x")).first().x
    assert long == 299_999


def padding(cells, bounds):
    return sum(min(b for b in bounds if b >= end) * n - words for end, n, words in cells)


def test_optimal_bounds_against_every_choice():
    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        cells = [(x, n := rng.randrange(1, 9), x * n) for x in lengths]
        for k in (1, 2, 3, 5):
            best = min(padding(cells, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
            bounds = packing.optimal_bounds(cells, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1] and padding(cells, bounds) == best
    assert packing.optimal_bounds([], 4) == []


def test_cells(spark):
    lengths = [0, 1, 4096, 4097, 4100, 8192, 8193, 10**9, 2**40, 2**40 + 1]
    rows = spark.createDataFrame([(x,) for x in lengths], "length long").select("length", packing.cell_end(F.col("length")).alias("e"))
    for length, end in rows.collect():
        assert length <= end <= max(1, length * 1.001) and (length > 4096 or end == max(1, length))


def test_batches(spark, rows):
    docs = make(rows)
    out = packing.pack(docs, 4, 300).collect()
    assert len(out) == docs.count()
    batches = {}
    for r in out:
        assert r.padding == r.padded_length - r.length >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        width = members[0].padded_length
        assert sorted(m.position for m in members) == list(range(len(members)))
        assert len(members) * width <= max(300, width)
        assert len(members) == max(1, 300 // width) or (bucket, batch + 1) not in batches
    assert packing.pack(docs.limit(0)).count() == 0
