"""Near-duplicate groups from HyperMinHash sketches.

A document is the set of its distinct word shingles; two documents are linked if the intersection holds at least 80 % of
the union. The steps:

1. `sketches`: per document the digest of its set and GROUPS HyperMinHash sketches with BUCKETS buckets each. A bucket keeps
   the smallest hash that fell into it, compressed to the number of its leading zeros and MANTISSA bits after them.
2. Documents with equal sets form a class; the smallest doc_id stands for it.
3. Bands of ROWS compressed registers, each from another sketch, give the candidate buckets. Two sets of similarity s
   agree in a register with probability s at least (two empty buckets agree), so a pair at 0.8 is missed by all
   48 bands with probability (1 - 0.8^6)^48 < 1e-6. Sets of fewer than 4 shingles reach 0.8 only when they are equal.
4. Inside a candidate bucket every member is paired with the smallest member. Where members are still in different
   components, all are compared with one center, and only pairs that share a rare difference from it (`_differences`)
   go on: a bucket of copies costs its size, not its square, and no pair whose link could join two components is left out.
5. A pair passes to verification if the Jaccard estimate of its registers, corrected for accidental collisions, is above
   0.8 less five standard deviations; it is linked if the full sets say so.
6. Components by label propagation with pointer jumping.

Null or empty texts and texts without words have an empty set and are linked with nothing. Rows that share a doc_id are
one document with the links of all its texts. A null doc_id is linked with nothing, has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import WordHashes, mix, piece_of, pieces, shingles
from strandline.plans import cut

GROUPS, BUCKETS, MANTISSA, ROWS = 36, 8, 10, 6
REGISTERS = GROUPS * BUCKETS
BANDS = REGISTERS // ROWS
SMALLEST = 4
EMPTY = np.uint16(0xFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mix(np.arange(1, 2 * GROUPS + 1, dtype=np.uint64)) | np.uint64(1)
# row r of band b: the register of one bucket in sketch (b mod 6) * 6 + r, so the rows of a band come from six sketches
_BAND = np.array([[((b % 6) * ROWS + r) * BUCKETS + (b // 6 + r) % BUCKETS for r in range(ROWS)] for b in range(BANDS)])


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of 61-bit numbers."""
    _, exponent = np.frexp((x >> np.uint64(8)).astype(np.float64))  # 53 bits are exact
    return np.minimum(53 - exponent, 53).astype(np.int64)


def _compress(smallest: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the mantissa bits behind the first one; EMPTY for an empty bucket."""
    zeros = _leading_zeros(smallest)
    shift = np.maximum(61 - zeros - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (smallest >> shift) & np.uint64((1 << MANTISSA) - 1)
    return np.where(smallest == _NONE, EMPTY, (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def _registers(members: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of REGISTERS registers for each set members[at[i]:at[i + 1]]."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(at))
    out = np.empty((n, GROUPS, BUCKETS), np.uint64)
    for g in range(GROUPS):
        h = (members ^ _SEEDS[2 * g]) * _SEEDS[2 * g + 1]
        h ^= h >> np.uint64(32)
        h *= _SEEDS[2 * g]
        smallest = np.full(n * BUCKETS, _NONE, np.uint64)
        np.minimum.at(smallest, doc + (h >> np.uint64(61)).astype(np.int64), h & np.uint64((1 << 61) - 1))
        out[:, g] = smallest.reshape(n, BUCKETS)
    return _compress(out).reshape(n, REGISTERS)


def _sets(rows: pa.RecordBatch, column: str, n: int, hashes: WordHashes) -> list[np.ndarray]:
    raw, at = piece_of(rows, column)
    data = raw.tobytes().lower()
    return [np.unique(shingles(hashes.of(data[a:b].split()), n)) for a, b in zip(at[:-1], at[1:], strict=True)]


def sketches(docs: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set, null for an empty one), registers. One pass, no shuffle."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for piece in pieces(batches, "text"):
            sets = _sets(piece, "text", n, hashes)
            sizes = np.array([len(s) for s in sets], np.int64)
            found = _registers(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes))))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()),
                 pa.array([r.tobytes() for r in found], pa.binary())], ["doc_id", "n_shingles", "set_id", "registers"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, set_id binary, registers binary")


def band_rows(sketched: DataFrame) -> DataFrame:
    """(band_key, doc_id): a row for each band of a document that has a register with a value in it."""
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                raw, _ = piece_of(part, "registers")
                taken = raw.view(np.uint16).reshape(part.num_rows, REGISTERS)[:, _BAND]
                key = np.tile(np.arange(BANDS, dtype=np.uint64), (part.num_rows, 1))
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x10001) + taken[:, :, r])
                filled = (taken != EMPTY).any(axis=2)
                ids = np.repeat(np.asarray(part.column("doc_id")), filled.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(key[filled].view(np.int64)), pa.array(ids)], ["band_key", "doc_id"])

    return sketched.select("doc_id", "registers").mapInArrow(bands, "band_key long, doc_id long")


def estimated_jaccard(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of register rows: the share of equal registers among those that either side fills, less the accidental share;
    and the number of registers that it rests on.

    Two registers of different minima agree by chance when leading zeros and mantissa coincide: with k items in a bucket
    on either side the chance is about 2^-MANTISSA over the zeros that are likely, 1/3 of the time the same ones.
    """
    filled = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(filled.sum(axis=1), 1)
    chance = 2.0 ** -MANTISSA / 3
    return np.clip((((a == b) & filled).sum(axis=1) / n - chance) / (1 - chance), 0, 1), n


def _estimate(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers are similar enough."""
    side = sketched.select("doc_id", "n_shingles", "registers")
    both = (pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")
            .where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                r_a, r_b = (piece_of(part, c)[0].view(np.uint16).reshape(part.num_rows, REGISTERS) for c in ("r_a", "r_b"))
                jaccard, filled = estimated_jaccard(r_a, r_b)
                likely = pa.array(jaccard >= 0.8 - 5 * np.sqrt(0.8 * 0.2 / filled))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(likely), part.column("b").filter(likely)], ["a", "b"])

    return both.select("a", "b", "r_a", "r_b").mapInArrow(estimate, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs whose full sets are linked."""
    both = pairs.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(iter([batch]), "t_a"):
                last, of_last, linked = None, None, []
                for t_a, t_b in zip(piece.column("t_a").to_pylist(), piece.column("t_b").to_pylist(), strict=True):
                    one = np.unique(shingles(hashes.of(t_a.encode().lower().split()), n))
                    if t_b != last:
                        last, of_last = t_b, np.unique(shingles(hashes.of(t_b.encode().lower().split()), n))
                    common = len(np.intersect1d(one, of_last, assume_unique=True))
                    linked.append(100 * common >= 80 * (len(one) + len(of_last) - common))
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column("a").filter(keep), piece.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable) for the ends of the links (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges, _ = cut(both.distinct(), "dup-edges")
    label, seen = cut(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.min("a")).alias("component_id")),
                      "dup-labels")
    while seen["rows"]:
        offered = edges.join(label.select(F.col("doc_id").alias("b"), "component_id"), "b").groupBy(
            F.col("a").alias("doc_id")).agg(F.min("component_id").alias("offer"))
        nearer = label.join(offered, "doc_id").select("doc_id", F.col("component_id").alias("old"),
                                                      F.least("component_id", "offer").alias("near"))
        jump = label.select(F.col("doc_id").alias("near"), F.col("component_id").alias("far"))
        moved = nearer.join(jump, "near").select("doc_id", F.least("near", "far").alias("component_id"),
                                                 (F.least("near", "far") != F.col("old")).alias("moved"))
        step, seen = cut(moved, "dup-labels", counts={"moved": F.col("moved")})
        label = step.drop("moved")
        if not seen["moved"]:
            break
    return label


def near_duplicates(docs: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs` (doc_id, text, ...)."""
    sketched, _ = cut(sketches(docs, n), "dup-sketches")
    known = sketched.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    member = known.select("doc_id", "set_id").distinct().join(classes, "set_id").select("doc_id", "rep")
    # registers once per class: those of its smallest member
    reps = (known.where(f"n_shingles >= {SMALLEST}").groupBy("set_id")
            .agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers")))
    reps, _ = cut(reps.drop("set_id"), "dup-classes")
    rows = band_rows(reps)
    shared = rows.groupBy("band_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    shared, _ = cut(shared.drop("last"), "dup-shared")  # written, so that hot buckets of the join can be split
    buckets, _ = cut(rows.join(shared, "band_key"), "dup-buckets")
    involved = buckets.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts, _ = cut(texts.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "dup-texts")

    def tested(pairs: DataFrame) -> DataFrame:
        likely, _ = cut(_estimate(pairs, reps), "dup-candidates")
        return cut(_verify(likely, texts, n).distinct(), "dup-links")[0]

    links = tested(buckets.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct())
    placed, left = _open_buckets(buckets, components(links))
    if left:
        apart, _ = cut(_differences(placed, texts, n), "dup-differences")
        links = links.unionByName(apart.where("linked").select("a", F.col("center").alias("b")).distinct())
        links = links.unionByName(tested(_close_pairs(apart)))
    joined = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.unionByName(joined))
    out = sketched.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return (out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))))


def _open_buckets(buckets: DataFrame, label: DataFrame) -> tuple[DataFrame, int]:
    """a, comp, center: the members of the buckets that hold several components, with their component and the smallest
    document of the component that has most members in the bucket."""
    member = (buckets.join(label, "doc_id", "left")
              .select("band_key", F.col("doc_id").alias("a"), F.coalesce("component_id", "doc_id").alias("comp")))
    parts = member.groupBy("band_key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (parts.groupBy("band_key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                           F.max(F.struct("n", -F.col("comp"))).alias("top"))
             .where("low < high").select("band_key", (-F.col("top.col2")).alias("center")))
    table, seen = cut(member.join(mixed, "band_key").select("a", "comp", "center").distinct(), "dup-open")
    return table, seen["rows"]


def _differences(placed: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """How each document differs from its center: n_a shingles, `apart` of them on one side only, `linked`, and the start
    of the differing shingles in an order that all documents of a center share (added ones, missing ones, each by hash).

    Two linked documents differ from each other in at most k = (n_a + n_b) / 9 shingles. Either both are linked with the
    center, or they share t = (apart_a + apart_b - k) / 2 >= 1 of their differences, and then a shared one stands among
    the first apart - t + 1 of either (prefix filter). That is at most n_a / 4 + 1, as n_b <= 1.25 n_a.
    """
    both = placed.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("center", "t_c"), "center")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(iter([batch]), "t_a"):
                last, of_last, rows = None, None, []
                for t_a, t_c in zip(piece.column("t_a").to_pylist(), piece.column("t_c").to_pylist(), strict=True):
                    one = np.unique(shingles(hashes.of(t_a.encode().lower().split()), n))
                    if t_c != last:
                        last, of_last = t_c, np.unique(shingles(hashes.of(t_c.encode().lower().split()), n))
                    apart = np.concatenate((np.setdiff1d(one, of_last, True), np.setdiff1d(of_last, one, True)))
                    rows.append((len(one), len(apart), 9 * len(apart) <= len(one) + len(of_last),
                                 apart[:len(one) // 4 + 1].view(np.int64)))
                sizes, aparts, linked, first = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in ("center", "a", "comp")] +
                    [pa.array(sizes, pa.int64()), pa.array(aparts, pa.int64()), pa.array(linked, pa.bool_()),
                     pa.array(first, pa.list_(pa.int64()))], ["center", "a", "comp", "n_a", "apart", "linked", "first"])

    return both.select("center", "a", "comp", "t_a", "t_c").mapInArrow(
        differ, "center long, a long, comp long, n_a long, apart long, linked boolean, first array<long>")


def _close_pairs(apart: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components around one center that pass the prefix filter."""
    one = apart.select("center", "a", "comp", "n_a", F.col("apart").alias("d_a"), F.posexplode("first").alias("p_a", "item"))
    two = one.toDF("center", "b", "other", "n_b", "d_b", "p_b", "item")
    near = F.expr("comp < other AND 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) "
                  "AND 2 * p_a <= d_a - d_b + (n_a + n_b) div 9 AND 2 * p_b <= d_b - d_a + (n_a + n_b) div 9")
    return one.join(two, ["center", "item"]).where(near).select("a", "b").distinct()


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """One row of `docs` for each group of near duplicates: that of the smallest doc_id; rows of a null doc_id stay."""
    kept = near_duplicates(docs, n).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates(["doc_id"]).unionByName(
        docs.where("doc_id IS NULL"))
