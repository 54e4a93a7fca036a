"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

1. `source_targets`: words per source, weights, targets. A target stops at REPEATS times its source; the excess is shared
   out again by weight (water filling over the sources in order of size per weight; one row per source).
2. `schedule`: slot i gets the point i * golden ratio mod 1, in 32-bit integers. Cumulative targets cut the line into
   one interval per source, so every stretch of the schedule holds the sources near their shares. The slots of a source
   are ranked; slot of rank r takes block r of the source, and a source uses as many slots as its target has blocks.
   Should its points fall short by a few, the missing ranks follow at the end.
3. `pieces`: the documents of a source in shuffled order make a stream of words that starts again when it ends; blocks of
   `block` words cut it. A document lies in the blocks it overlaps.
4. `mix` joins slots and pieces: which words of which document stand in which slot. The slots order the mixed documents.

A word is a run of characters other than space and 0x09-0x0D; null and empty texts have size 0 and are never taken. A null
source is a source. Repeated rows are documents of their own. Documents with equal ids are ordered by size. Order and
schedule depend on ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans import cut, running_sum

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 1024
GOLDEN = 2654435769  # 2^32 divided by the golden ratio
CELLS = 4096  # the line of points in cells, for the join of points with intervals


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_no, source, source_size, weight, target of (source, size): one row per source, in code point order, null last."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = each.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = (F.col("source_no") - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (turn + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", REPEATS * F.col("source_size"))
    filling = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    filled = (ranked.withColumn("k", F.row_number().over(filling))
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("weights", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("open", _exact("cap") * F.col("weights") > _exact("rest") * F.col("weight"))
              .withColumn("first", F.min(F.when(F.col("open"), F.struct("k", "rest", "weights"))).over(everything)))
    share = (F.col("first.rest") * F.col("weight")).cast("double") / F.col("first.weights").cast("double")
    capped = F.col("first").isNull() | (F.col("k") < F.col("first.k"))
    return filled.select("source_no", "source", "source_size", "weight",
                         F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source_no, rank (from 0): which block of which source stands in a slot. `targets` is read several times."""
    need = targets.select("source_no", "target", F.ceil(F.floor("target") / block).cast("long").alias("blocks"))
    total = need.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    n_slots = int(total + total // 64 + 64) if total else 0
    line = Window.orderBy("source_no")
    sums = need.where("blocks > 0").withColumn("upto", F.sum("target").over(line)).withColumn("all", F.sum("target").over(Window.partitionBy()))
    scale = F.lit(float(1 << 32))
    low = F.floor((F.col("upto") - F.col("target")) / F.col("all") * scale).cast("long")
    high = F.when(F.row_number().over(Window.orderBy(F.desc("source_no"))) == 1, F.lit(1 << 32)).otherwise(
        F.floor(F.col("upto") / F.col("all") * scale).cast("long"))
    bounds = sums.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(line), F.lit(0)))
    width = (1 << 32) // CELLS
    cells = bounds.where("low < high").select("source_no", "blocks", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    i = F.col("id")
    turned = F.pmod(F.shiftright(i, 16) * GOLDEN, F.lit(1 << 16)) * (1 << 16) + i.bitwiseAND(F.lit(0xFFFF).cast("long")) * GOLDEN
    points = targets.sparkSession.range(n_slots).select(i.alias("slot"), F.pmod(turned, F.lit(1 << 32)).alias("point"))
    placed = (points.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell")
              .where("low <= point AND point < high").select("slot", "source_no", "blocks"))
    ranked = running_sum(placed, ["source_no"], F.floor(F.col("slot") / 65536), [F.col("slot")], F.lit(1), "nth")
    ranked = ranked.withColumn("rank", F.col("nth") - 1).drop("nth")
    had = placed.groupBy("source_no").agg(F.count(F.lit(1)).alias("had"))
    short = need.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
    tail = short.select((F.col("source_no") + n_slots).alias("slot"), "source_no",
                        F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)).alias("rank"))
    return ranked.where("rank < blocks").select("slot", "source_no", "rank").unionByName(tail)


def placed_documents(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, text_key, size, source_no, source_size, target, start: where a document lies in the stream of its source.

    The order is that of a digest of the id; running sums go over slices of it, so no task holds a whole source.
    """
    named = docs.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    drawn = named.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    columns = ["doc_id", "text_key", "size", "source_no", "source_size", "target", "draw"]
    order = [F.col("draw"), F.col("doc_id"), F.col("size"), F.col("text_key")]
    summed = running_sum(drawn.select(*columns), ["source_no"], F.substring("draw", 1, 3), order, F.col("size"), "upto")
    return summed.withColumn("start", F.col("upto") - F.col("size")).drop("upto", "draw")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """source_no, rank, start, epoch, first, last: the words first..last - 1 of the document at `start` in block `rank`."""
    limit = F.floor("target").cast("long")
    epochs = placed.where("size > 0").withColumn("limit", limit).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn(
        "begin", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn(
        "stop", F.least("limit", F.col("begin") + F.col("size"))).where("begin < stop")
    cutting = epochs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block))))
    return cutting.select("source_no", "rank", "start", "epoch",
                          (F.greatest("begin", F.col("rank") * block) - F.col("begin")).alias("first"),
                          (F.least("stop", (F.col("rank") + 1) * block) - F.col("begin")).alias("last"))


def mix(placed: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source_no, start, epoch, first, last: the mixed corpus as words of documents, in order of the slots."""
    return pieces(placed, block).join(schedule(targets, block), ["source_no", "rank"])


def _placed(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(placed documents, targets), both written."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    targets, _ = cut(source_targets(sized), "mix-targets")
    placed, _ = cut(placed_documents(sized, targets, seed), "mix-placed")
    return placed, targets


def taken_words(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """doc_id, text_key, source_no, size, source_size, target, taken, first_slot of every row of `docs` (doc_id, source, text).

    `first_slot` is the first slot of the schedule in which words of the document stand, null if it has none.
    """
    placed, targets = _placed(docs, seed)
    sums = mix(placed, targets, block).groupBy(F.col("source_no").alias("_s"), F.col("start").alias("_at")).agg(
        F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
    here = (F.col("source_no") == F.col("_s")) & (F.when(F.col("size") > 0, F.col("start")) == F.col("_at"))
    return placed.join(sums, here, "left").select("doc_id", "text_key", "source_no", "size", "source_size", "target",
                                                  F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text up to its n-th word, white space as it is."""
    space, word = r"[\x20\x09-\x0D]*+", r"[^\x20\x09-\x0D]++"
    return F.regexp_substr(text, F.concat(F.lit(f"^(?:{space}{word}){{"), n.cast("string"), F.lit("}+")))


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """`docs` as the mix takes them, in the order of the schedule: a row for each time that a document is taken, placed by the
    first slot in which that copy has words. The one document per source that the target cuts ends with its last word taken.
    Documents that the mix does not take are gone. Rows that repeat id and text count each; all are written as one of them."""
    placed, targets = _placed(docs, seed)
    copies = mix(placed, targets, block).groupBy(F.col("source_no").alias("_s"), F.col("start").alias("_at"), F.col("epoch").alias("_epoch")).agg(
        F.sum(F.col("last") - F.col("first")).alias("_taken"), F.min("slot").alias("_slot"))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("text_key").alias("_text")]
    here = (F.col("source_no") == F.col("_s")) & (F.col("start") == F.col("_at"))
    taken = placed.where("size > 0").join(copies, here).select(*key, F.col("size").alias("_size"), "_taken", "_slot", "_epoch", "_at")
    taken, _ = cut(taken, "mix-copies")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), key[0], F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    both = rows.dropDuplicates(["_id", "_text"]).join(taken, ["_id", "_text"])
    cutoff = first_words(F.col("row.text"), F.col("_taken"))
    shorter = F.col("row").withField("text", cutoff)
    if "n_chars" in docs.columns:
        shorter = shorter.withField("n_chars", F.length(cutoff).cast(docs.schema["n_chars"].dataType))
    made = both.withColumn("row", F.when(F.col("_taken") < F.col("_size"), shorter).otherwise(F.col("row")))
    return made.orderBy("_slot", "_epoch", "_at").select("row.*")
