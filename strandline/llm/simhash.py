"""Near duplicates by SimHash fingerprints that differ in few bits.

1. `fingerprints`: XXH64 of every 3-word shingle, repeats included; a bit is 1 if it is set in over half of them.
2. Documents with equal fingerprints form a class; the smallest doc_id stands for it, so copies cost nothing below.
3. `block_keys`: the fingerprint is split into BLOCKS pieces. Two fingerprints that differ in at most `distance` bits agree in
   BLOCKS - distance pieces at least, so each choice of that many pieces is a key (6 pieces, 3 bits: 20 keys of 32 bits).
4. `block_links` joins on the keys and verifies the Hamming distance. The fingerprints of a key meet in blocks of CHUNK, each
   pair of blocks in a task, which returns a spanning forest of the verified links instead of all pairs: a key with m
   fingerprints gives at most m - 1 links for each pair of blocks. Keys above CHUNK * CHUNKS fingerprints do not meet in pairs
   at all: `ball_links` groups them by the fingerprints one or two flips away, which costs a fixed number of rows each.
   Both ways find every link, wherever the border between them lies.
5. Components of the links between classes.

A text without words, or null, has fingerprint zero and is linked like any other. Rows that share a doc_id are one document
with the links of all its fingerprints, and one row each in the result. A row without doc_id has a fingerprint, links
nothing and has a null component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.near_dedup import components
from strandline.llm.text import piece_of, pieces, word_runs
from strandline.plans import cut

WORDS, SEED, BITS = 3, 42, 64
DISTANCE, BLOCKS = 3, 6
CHUNK, CHUNKS = 2048, 64
HOT = 1000  # a fingerprint of more than 1 / HOT of the rows is hot, so there are fewer than HOT of them
_LANES = np.uint64(0x0101010101010101)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the numbers have each bit set. Bytes of a word count up to 255 numbers side by side."""
    sums = np.zeros(BITS, np.int64)
    if len(hashes):
        runs = np.arange(0, len(hashes), 255)
        for shift in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, runs)
            sums[shift::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sums


def simhash(text: bytes, n: int = WORDS) -> int:
    """The fingerprint of one text, worked through in runs of words."""
    sums, total, tail = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for run in word_runs(text.lower()):
        words = tail + run
        if len(words) >= n:
            joined, at = b" ".join(words), np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
            hashes = np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(at, at[n:], strict=False)), np.uint64, len(words) - n + 1)
            sums += _bit_sums(hashes)
            total += len(hashes)
        tail = words[len(words) - n + 1:] if len(words) >= n else words
    if not total and tail:
        return digest(b" ".join(tail), SEED)
    return int(np.bitwise_or.reduce(np.where(2 * sums > total, np.uint64(1) << np.arange(BITS, dtype=np.uint64), np.uint64(0))))


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number): one row for each row of `docs` (doc_id, text)."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            raw, at = piece_of(piece, "text")
            found = np.array([simhash(raw[a:b].tobytes(), n) for a, b in pairwise(at.tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def block_keys(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """choice, key, fp: a row for each choice of pieces of every fingerprint. A key keeps the bits of its pieces in place."""
    edges = np.linspace(0, BITS, blocks + 1).astype(int).tolist()
    pieces_of = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(edges)]
    masks = [sum(chosen) for chosen in combinations(pieces_of, blocks - distance)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                        for i, m in enumerate(signed)])
    return distinct.select("fp", F.explode(choices).alias("c")).select("c.choice", "c.key", "fp")


def _forest(one: np.ndarray, two: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs (one, two) within the distance connect; the two sides are equal or share nothing.

    Row by row; a fingerprint leaves the open ones once it is linked with a row, so dense groups cost little, and the rows that
    a step reaches are taken next.
    """
    every = np.unique(np.concatenate((one, two)))
    in_one, in_two = np.isin(every, one), np.isin(every, two)
    parents, children = [], []
    open_ = np.ones(len(every), bool)
    while open_.any():
        first = int(np.argmax(open_))
        open_[first] = False
        reached = [first]
        while reached:
            at = reached.pop()
            left = np.flatnonzero(open_)
            across = (in_two[left] if in_one[at] else False) | (in_one[left] if in_two[at] else False)
            left = left[across]
            near = left[np.bitwise_count(every[left] ^ every[at]) <= distance]
            open_[near] = False
            parents.append(np.full(len(near), every[at]))
            children.append(every[near])
            reached.extend(near.tolist())
    return np.concatenate(parents), np.concatenate(children)


def _chunk_links(keyed: DataFrame, distance: int, chunk: int) -> DataFrame:
    """Links within the keys of (choice, key, n, fp), n being the fingerprints of the key; one group for each pair of chunks."""
    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    placed = keyed.select("choice", "key", "fp", mine.alias("mine"), F.explode(meets).alias("m"))
    groups = placed.groupBy("choice", "key", "m").agg(
        F.collect_list(F.when(F.col("mine") == F.col("m.i"), F.col("fp"))).alias("one"),
        F.collect_list(F.when(F.col("mine") == F.col("m.j"), F.col("fp"))).alias("two"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()) for c in (batch.column("one"), batch.column("two"))]
            found = [_forest(*[values[at[r]:at[r + 1]] for values, at in sides], distance) for r in range(batch.num_rows)]
            a, b = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.uint64) for s in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return groups.select("one", "two").mapInArrow(link, "a long, b long")


def ball_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect all fingerprints within the distance of each other, without meeting in pairs.

    With r = distance div 2 and s = distance - r, two fingerprints are within the distance if and only if some number is at
    most r flips from one and s from the other. Every fingerprint stands under all numbers within s flips of it; under a number
    that one within r flips also stands under, all are linked with the smallest such one: each of these links is one.
    """
    r, s = distance // 2, distance - distance // 2
    flips = [sum(1 << i for i in bits) for k in range(s + 1) for bits in combinations(range(BITS), k)]
    near = sum(1 for f in flips if f.bit_count() <= r)  # the flips come in order of their number of bits
    signed = [f - (1 << BITS) if f >> (BITS - 1) else f for f in flips]
    spread = distinct.select("fp", F.posexplode(F.array(*[F.lit(f).cast("long") for f in signed])).alias("at", "flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("ball"), "fp", (F.col("at") < near).alias("near"))
    met = spread.groupBy("ball").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
    return met.where("a IS NOT NULL AND size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def block_links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK, chunks: int = CHUNKS) -> DataFrame:
    """(a, b): links between the different fingerprints `fp` that connect exactly those which steps of at most `distance`
    bits connect. `distinct` is read several times."""
    keyed = block_keys(distinct, distance, blocks)
    sizes, _ = cut(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    shared, seen = cut(keyed.join(sizes, ["choice", "key"]), "simhash-blocks", counts={"huge": F.col("n") > chunk * chunks})
    links = _chunk_links(shared.where(F.col("n") <= chunk * chunks), distance, chunk)
    if seen["huge"]:
        links = links.unionByName(ball_links(shared.where(F.col("n") > chunk * chunks).select("fp").distinct(), distance))
    return links


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of `docs` (doc_id, text)."""
    found, seen = cut(fingerprints(docs), "simhash-fingerprints")
    known = found.where("doc_id IS NOT NULL")
    classes, _ = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    rep = classes.select("fp", "rep")
    near = block_links(rep.select("fp"), distance, blocks, chunk, chunks).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = near.join(rep.toDF("a", "rep_a"), "a").join(rep.toDF("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # documents with several rows also link the classes of all their fingerprints
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("doc_id")
    of_several = known.join(several, "doc_id").distinct().join(rep, "fp")
    least = of_several.groupBy("doc_id").agg(F.min("rep").alias("a"))
    links = links.unionByName(of_several.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b"))
    label = components(links)
    named = classes.join(label, classes["rep"] == label["doc_id"], "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "n")
    named, _ = cut(named, "simhash-named")
    # fewer than HOT fingerprints can be hot; their documents need no shuffle, and no task gets all of one
    often = F.col("n") > seen["rows"] / HOT
    hot = F.broadcast(named.where(often).select("fp", F.col("component_id").alias("hot_id")))
    first = found.join(hot, "fp", "left")
    cold = first.where("hot_id IS NULL AND doc_id IS NOT NULL").drop("hot_id").join(named.where(~often).select("fp", "component_id"), "fp")
    warm = first.where("hot_id IS NOT NULL OR doc_id IS NULL").select(
        "fp", "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("hot_id")).alias("component_id"))
    return warm.unionByName(cold).select("doc_id", "fp", "component_id")
