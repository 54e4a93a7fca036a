"""Ordered calculations inside a key that may hold most of the rows.

A plain window sends every row of a key to one task. Here a key is first cut into slices that
follow the order (a calendar period, a number range). Windows run per (key, slice); only one summary
row per slice is ordered per key, and its carry is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.materialize import cut

ROWS_PER_SLICE = 100_000


def running_sum(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], value: Column,
                out: str) -> DataFrame:
    """Adds `out`: the sum of `value` from the first row of the key up to this row.

    `slice_by` must not decrease along `order`.
    """
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", value.cast("long"))
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"),
                             F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_slice").eqNullSafe(F.col("_s"))]
    joined = sliced.withColumn("_inside", F.sum("_value").over(inside)).join(carry, same, "left")
    return joined.withColumn(out, F.col("_inside") + F.col("_carry")).select(*df.columns, out)


def order_slices(df: DataFrame, keys: list[str], order: list[Column], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Adds `_part`, a slice that follows the order inside every key, for orders without a natural slice.

    The borders are quantiles of (keys, order) that Spark samples from the rows, so the slices are of about one size, however the
    values lie and however many rows a key has. There are as many slices as rows need; they are stored, since sampled borders may
    differ when a lost part is made again. Rows that are equal in keys and order share a slice.
    """
    stored, seen = cut(df, "order")
    n = -(-seen["rows"] // rows_per_slice)
    if n <= 1:
        return stored.withColumn("_part", F.lit(0))
    ranged = stored.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    return cut(ranged, "slices")[0]


def with_previous(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], value: Column,
                  out: str) -> DataFrame:
    """Adds `out`: struct(value) of the row before this one in its key, null for the first row.

    The row before the first row of a slice is the last row of the nearest earlier slice.
    """
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", F.struct(value.alias("value")))
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by("_value", rank).alias("_last"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    carry = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"),
                        F.lag("_last").over(by_slice).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_slice").eqNullSafe(F.col("_s"))]
    joined = sliced.withColumn("_inside", F.lag("_value").over(inside)).join(carry, same, "left")
    return joined.withColumn(out, F.coalesce("_inside", "_carry")).select(*df.columns, out)


def number_free(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], taken: DataFrame,
                out: str) -> DataFrame:
    """Adds `out`: the rows of a key get 1, 2, 3, ... in order, leaving out the numbers in `taken` (keys, n).

    Row i gets i plus the number of taken values below it. A taken value has (itself - its rank) free values
    below, so both are put on one line and counted.
    """
    counted = running_sum(df, keys, slice_by, order, F.lit(1), "_i")
    block = 100_000
    used = running_sum(taken.select(*keys, F.col("n").cast("long").alias("n")).where("n > 0").distinct(), keys,
                       F.floor(F.col("n") / block), [F.col("n")], F.lit(1), "_rank")
    line = (counted.select(*keys, (2 * F.col("_i")).alias("_at"), F.lit(0).alias("_taken"))
            .unionByName(used.select(*keys, (2 * (F.col("n") - F.col("_rank")) + 1).alias("_at"),
                                     F.lit(1).alias("_taken"))))
    passed = running_sum(line, keys, F.floor(F.col("_at") / block), [F.col("_at"), F.col("_taken")], F.col("_taken"),
                         "_skip")
    skips = passed.where("_taken = 0").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_at"), "_skip")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [2 * F.col("_i") == F.col("_at")]
    return counted.join(skips, same).withColumn(out, F.col("_i") + F.col("_skip")).select(*df.columns, out)


def number_changes(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], value: Column,
                   out: str) -> DataFrame:
    """The rows whose value differs from that of the row before in their key, numbered 1, 2, 3, ... as `out`.

    Rows are shuffled once, by key and slice; a slice adds its first and last value and its number of changes to
    the order of slices. Keys and slices must not be null.
    """
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", F.struct(value.alias("value")))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    marked = sliced.withColumn("_prev", F.lag("_value").over(inside)).withColumn("_first", F.col("_prev").isNull())
    marked = marked.withColumn("_moved", ~F.col("_first") & ~F.col("_prev").eqNullSafe(F.col("_value"))).withColumn(
        "_n", F.sum(F.col("_moved").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    per_slice = marked.groupBy(*keys, "_slice").agg(
        F.min_by("_value", rank).alias("_head"), F.max_by("_value", rank).alias("_tail"), F.max("_n").alias("_moves"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    before = F.lag("_tail").over(by_slice)
    opened = per_slice.withColumn("_opens", (before.isNull() | ~before.eqNullSafe(F.col("_head"))).cast("long"))
    so_far = F.sum(F.col("_moves") + F.col("_opens")).over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    carry = opened.select(*keys, "_slice", "_opens", F.coalesce(so_far, F.lit(0)).alias("_before"))
    kept = marked.join(carry, [*keys, "_slice"]).where("_moved OR (_first AND _opens = 1)")
    return kept.withColumn(out, F.col("_before") + F.col("_opens") + F.col("_n")).select(*df.columns, out)


def merge_spans(df: DataFrame, keys: list[str], since: str, until: str) -> DataFrame:
    """(keys, since, until): the spans of each key with those that meet or overlap made one."""
    line = Window.partitionBy(*keys).orderBy(since, until)
    opens = F.coalesce(F.col(since) > F.max(until).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = df.select(*keys, since, until).withColumn("_opens", opens.cast("long"))
    numbered = marked.withColumn("_n", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_n").agg(F.min(since).alias(since), F.max(until).alias(until)).drop("_n")


def top_per_project(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of every project (of all rows in a table without projects). Each task keeps at most that
    many rows of a project before the shuffle."""
    if "project_id" not in df.columns:
        return df.orderBy(*order).limit(limit)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("project_id").orderBy(*order)))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")
