"""Order MinHash fingerprints in DataFrame functions.

1. The k-mers of a text are its runs of KMER words; a shorter text is one k-mer.
2. Equal k-mers are numbered by occurrence: their hashes are sorted together with their places, and a run of equal
   hashes counts its members. Every numbered k-mer is hashed once more; the top bits choose one of SLOTS slots.
3. A slot keeps the PICKED numbered k-mers of smallest hash, puts them back in text order and hashes the tuple. So a slot
   agrees between two texts if they hold the same rare k-mers in the same order, which edits and moves both disturb.

The fingerprint lists the filled slots with 32 bits of their hash. The likeness of two fingerprints is the share of equal
slots among those that either fills; two empty ones are alike. Null and empty texts and texts without words have an empty
fingerprint. Places count to 2^24; later k-mers share the last place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans import cut, with_previous

KMER, SLOTS_LOG2, PICKED = 2, 5, 2
PLACE_BITS = 24
SLICE = 1000
BORDERS = 100_000  # keys of 40 bytes that may be broadcast


def _tagged(value: Column, place: Column) -> Column:
    """The value's upper 40 bits with a place below."""
    return F.shiftleft(F.shiftright(value, PLACE_BITS), PLACE_BITS).bitwiseOR(place)


def _place(tagged: Column) -> Column:
    return tagged.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))


def _slot(tagged: Column) -> Column:
    return F.shiftrightunsigned(tagged, 64 - SLOTS_LOG2)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array<long> of filled slots, slot << 32 | hash, for the column `text`.

    Each step is a column that the next one uses more than once, so that none is evaluated inside another's loop.
    """
    keep = df.columns
    words, sorted_, starts, ranked, picked = (f"{out}_{c}" for c in ("words", "sorted", "starts", "ranked", "picked"))
    split = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    df = df.select(*keep, split.alias(words))
    w, n = F.col(words), F.size(words)
    short = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    kmers = F.when(n < KMER, short).otherwise(F.transform(
        F.slice(w, F.lit(1), n - (KMER - 1)), lambda first, i: F.xxhash64(first, *[F.get(w, i + j) for j in range(1, KMER)])))
    last = F.lit((1 << PLACE_BITS) - 1)
    tagged = F.transform(kmers, lambda h, i: _tagged(h, F.least(i, last).cast("long")))
    df = df.select(*keep, F.sort_array(tagged).alias(sorted_))
    s, n = F.col(sorted_), F.size(sorted_)
    value = lambda i: F.shiftright(F.get(s, i), PLACE_BITS)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.select(*keep, sorted_, F.filter(at, lambda i: (i == 0) | (value(i) != value(i - 1))).alias(starts))
    b = F.col(starts)
    alone = F.transform(s, lambda x: _tagged(F.xxhash64(F.shiftright(x, PLACE_BITS), F.lit(0)), _place(x)))
    numbered = F.flatten(F.transform(b, lambda start, j: F.transform(
        F.sequence(start, F.coalesce(F.get(b, j + 1), n) - 1),
        lambda i: _tagged(F.xxhash64(value(i), i - start), _place(F.get(s, i))))))
    df = df.select(*keep, F.sort_array(F.when(F.size(b) == n, alone).otherwise(numbered)).alias(ranked))
    r = F.col(ranked)
    few = F.filter(r, lambda x, i: (i < PICKED) | (_slot(F.get(r, i - PICKED)) != _slot(x)))
    df = df.select(*keep, few.alias(picked))
    p = F.col(picked)
    return df.select(*keep, _tuples(p).alias(out))


def _tuples(p: Column) -> Column:
    """For each slot in the sorted picks the hash of its picks in text order."""
    def of(i: Column) -> Column:
        mine = [F.get(p, i - k) for k in range(PICKED)]  # the last pick of a slot and those before it
        same = [F.when((i >= k) & (_slot(mine[k]) == _slot(mine[0])), mine[k]) for k in range(PICKED)]
        in_order = F.array_sort(F.transform(F.filter(F.array(*same), lambda x: x.isNotNull()),
                                            lambda x: F.struct(_place(x).alias("place"), x.alias("x"))))
        digest = F.xxhash64(F.array_join(F.transform(in_order, lambda y: F.shiftright(y["x"], PLACE_BITS).cast("string")), ","))
        return F.shiftleft(_slot(mine[0]), 32).bitwiseOR(digest.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))

    n = F.size(p)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.filter(at, lambda i: (i == n - 1) | (_slot(F.get(p, i)) != _slot(F.get(p, i + 1))))
    return F.transform(ends, of)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots, from 0 to 1."""
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def border_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """slice, key (doc_id and text_key of the row that follows the slice in descending order of doc_id): one row for each
    slice of SLICE ids, and their number. The slice of the smallest ids is followed by the largest id."""
    tails, seen = cut(docs.groupBy("slice").agg(F.max(F.struct("doc_id", "text_key")).alias("top")), "order-slices")
    top = tails.agg(F.max("top").alias("top")).first()["top"]
    if top is None:
        return tails.withColumnRenamed("top", "key"), 0
    first = F.struct(F.lit(top["doc_id"]).cast("bigint").alias("doc_id"), F.lit(top["text_key"]).alias("text_key")).cast(
        tails.schema["top"].dataType)
    linked = with_previous(tails, [], F.floor(F.col("slice") / SLICE), [F.col("slice")], F.col("top"), "before")
    return linked.select("slice", F.coalesce("before.value", first).alias("key")), seen["rows"]


def with_next_document(docs: DataFrame, describe) -> DataFrame:
    """`describe(docs)`, which adds columns to a text, with `next`: the struct of all columns of the row that follows in
    descending order of doc_id; the first after the last. `docs` has doc_id, text_key and text.

    Null ids come last, equal ids are ordered by `text_key`. Windows hold one slice of SLICE ids; the last row of a slice
    looks up its follower, by a broadcast of the keys while they are at most BORDERS, else by a shuffled join.
    """
    lowest = -(1 << 62)
    sliced = docs.withColumn("slice", F.coalesce(F.floor(F.col("doc_id") / SLICE), F.lit(lowest)))
    keys, n_slices = border_keys(sliced)
    keys = keys.select(F.col("slice").alias("_slice"), "key")
    same = F.col("key.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key.text_key") == F.col("text_key"))
    found = docs.join(F.broadcast(keys) if n_slices <= BORDERS else keys, same).dropDuplicates(["_slice"]).drop("key")
    found = describe(found)
    border = found.select(F.col("_slice").alias("slice"), F.struct(*[c for c in found.columns if c != "_slice"]).alias("border"))
    rows = describe(sliced)
    inside = Window.partitionBy("slice").orderBy("doc_id", "text_key")
    seen = rows.withColumn("next", F.lag(F.struct(*[c for c in rows.columns if c != "slice"])).over(inside))
    return seen.join(border, "slice", "left").withColumn("next", F.coalesce("next", "border")).drop("slice", "border")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (the text with its last third replaced from the next document), the slots of both, and the
    likeness of the text to the edited one and to the next document: for every row of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next_document(rows.withColumn("text_key", F.xxhash64("text")), lambda df: with_fingerprint(df, "text", "slots"))
    n = F.length("text")
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn("cut", F.floor(n / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut")),
                      F.substring("next.text", F.lit(1), F.col("cut")))
    paired = paired.select("doc_id", "n_chars", edited.alias("edited"), "slots", F.col("next.slots").alias("next_slots"))
    both = with_fingerprint(paired, "edited", "edited_slots")
    return both.select("doc_id", "n_chars", "edited", "slots", "edited_slots", likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
                       likeness(F.col("slots"), F.col("next_slots")).alias("near_next"))
