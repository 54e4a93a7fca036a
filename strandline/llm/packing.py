"""Packing into length buckets that pad least, and batches of a token budget inside each bucket.

1. `histogram`: documents and words per length cell. Lengths up to 4,096 have a cell each; beyond, an octave has 1,024 cells,
   so there are at most 45,056 cells up to 2^52 words, and a cell's end is at most 0.1 % above its lengths.
2. `optimal_bounds`: dynamic programming over the cells. With C documents and S words up to a cell, a bucket over the
   cells (i, j] pads end_j * (C_j - C_i) - (S_j - S_i) words. For one more bucket the best i minimises a line in end_j whose
   slopes fall with i, so a hull of lines gives every minimum in one pass: cells x buckets steps on the driver.
3. `pack`: documents get the bucket of their length; in shuffled order every `budget div padded length` of them are a batch.

Null and empty texts have length 0 and are padded to the smallest bucket. A document above the budget is a batch of its own;
nothing is cut. Repeated rows are packed each. Numbers inside a bucket come from running sums over slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.mixing import word_count
from strandline.plans import cut, running_sum

BUCKETS = 16
BUDGET = 32_768
EXACT = 4096


def cell_end(length: Column) -> Column:
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT + 1)) - 1)) - 10).cast("long")
    return F.when(length <= EXACT, F.greatest(length, F.lit(1))).otherwise(F.ceil(length / step) * step).cast("long")


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(end, documents, words) per cell of the column `length`, in order."""
    cells = lengths.groupBy(cell_end(F.col("length")).alias("end")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("words"))
    return [(r["end"], r["n"], r["words"]) for r in cells.orderBy("end").collect()]


def optimal_bounds(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding; the last is the end of the last cell."""
    if not cells:
        return []
    n = len(cells)
    ends, docs, words = [0], [0], [0]
    for end, count, total in cells:
        ends.append(end)
        docs.append(docs[-1] + count)
        words.append(words[-1] + total)
    least: list[int | None] = [0] + [None] * n
    came = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, value at 0, i
        nxt: list[int | None] = [None] * (n + 1)
        source = [0] * (n + 1)
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if least[i] is not None:
                slope, value = -docs[i], least[i] + words[i]
                while len(hull) - head >= 2:
                    (s1, v1, _), (s2, v2, _) = hull[-2], hull[-1]
                    if (value - v1) * (s1 - s2) <= (v2 - v1) * (s1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, value, i))
            if head >= len(hull):
                continue
            x = ends[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            slope, value, i = hull[head]
            nxt[j], source[j] = slope * x + value + x * docs[j] - words[j], i
        came.append(source)
        if least[n] is not None and nxt[n] is not None and least[n] <= nxt[n]:
            came.pop()
            break
        least = nxt
    bounds, j = [], n
    for source in reversed(came):
        bounds.append(ends[j])
        j = source[j]
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 0) -> DataFrame:
    """doc_id, length, bucket, padded_length, batch (number inside the bucket), position (inside the batch), padding."""
    sized, _ = cut(docs.select("doc_id", word_count(F.col("text")).alias("length")), "pack-lengths")
    bounds = optimal_bounds(histogram(sized), buckets)
    end = cell_end(F.col("length"))
    number, padded = F.lit(0), F.lit(1).cast("long")
    for k, bound in reversed(list(enumerate(bounds))):
        number = F.when(end <= bound, F.lit(k)).otherwise(number)
        padded = F.when(end <= bound, F.lit(bound).cast("long")).otherwise(padded)
    placed = sized.select("doc_id", "length", number.alias("bucket"), padded.alias("padded_length"), F.md5(
        F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("draw"))
    ranked = running_sum(placed, ["bucket"], F.substring("draw", 1, 3), [F.col("draw"), F.col("length")], F.lit(1), "nth")
    per_batch = F.greatest(F.lit(1), F.expr(f"{int(budget)} div padded_length"))
    ranked = ranked.withColumn("per_batch", per_batch.cast("long"))
    return ranked.select("doc_id", "length", "bucket", "padded_length", F.expr("(nth - 1) div per_batch").alias("batch"),
                         F.expr("(nth - 1) % per_batch").alias("position"), (F.col("padded_length") - F.col("length")).alias("padding"))
