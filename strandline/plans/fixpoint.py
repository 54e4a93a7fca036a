"""Semi-naive fixpoint over DataFrames: every round works on the rows found in the round before."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.materialize import cut, new_folder, own_shuffles_removed, remove_folder
from strandline.plans.ordered import merge_spans

MERGE_ROWS = 4_000_000


class Value(NamedTuple):
    """A column of which a key may find more in later rounds: the aggregate that merges its rows, and what a candidate adds to what is
    known (null: nothing)."""

    column: str
    merge: Callable[[str], Column]
    gain: Callable[[Column, Column], Column]


def bits(column: str) -> Value:
    """A set of up to 64 members as the bits of a long; a round has the new ones."""
    return Value(column, F.bit_or, lambda new, had: F.nullif(new.bitwiseAND(F.bitwise_not(had)), F.lit(0).cast("long")))


def least(column: str) -> Value:
    """The least value found so far."""
    return Value(column, F.min, lambda new, had: F.when(new < had, new))


class Known:
    """The keys (and spans, or values) found so far, to take known rows out of candidates.

    New rounds are read from the files they were written to. Once these hold `merge_rows` rows, they become a table bucketed by
    the keys, which later joins read bucket by bucket without a shuffle; a table takes in those before it that are no more than
    twice its size, so a row is rewritten a logarithmic number of times and few tables are left. The candidates are shuffled once,
    for all of them. What a round shuffles does not grow with what is known.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], span: tuple[str, str] | None = None, merge_rows: int = MERGE_ROWS,
                 value: Value | None = None):
        self.spark, self.base, self.keys, self.span, self.merge_rows = spark, new_folder(spark, f"{name}-known"), keys, span, merge_rows
        self.value = value
        self.young: list[str] = []
        self.schema = None
        self.young_rows = 0
        self.tables: list[tuple[str, int]] = []

    def add(self, rows: DataFrame, path: str, n: int) -> None:
        """`rows` as stored in `path`."""
        self.young.append(path)
        self.schema = rows.schema
        self.young_rows += n
        if self.young_rows < self.merge_rows:
            return
        parts, total, merged = [self._recent()], self.young_rows, []
        while self.tables and self.tables[-1][1] <= 2 * total:
            name, size = self.tables.pop()
            merged.append(name)
            parts, total = [*parts, self.spark.table(name)], total + size
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"known_{uuid.uuid4().hex}"
        rows = reduce(DataFrame.unionByName, parts).repartition(buckets, *self.keys)
        with own_shuffles_removed(self.spark):
            (self._merged(rows).write.bucketBy(buckets, *self.keys)
             .format("parquet").option("path", f"{self.base}/{name}").saveAsTable(name))
        self.tables.append((name, total))
        self.young, self.young_rows = [], 0
        self._drop(merged)

    def _recent(self) -> DataFrame:
        held = self.span or ([self.value.column] if self.value else [])
        return self.spark.read.schema(self.schema).parquet(*self.young).select(*self.keys, *held)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """With values, one row per key."""
        return rows if self.value is None else rows.groupBy(*self.keys).agg(self.value.merge(self.value.column).alias(self.value.column))

    def without(self, candidates: DataFrame) -> DataFrame:
        """The candidates whose key (with spans: whose key and span) is not covered by what is known."""
        sides = [self.spark.table(name) for name, _ in self.tables]
        if self.young:
            sides.append(self._merged(self._recent()) if len(self.young) > 1 else self._recent())
        for known in sides:
            if self.value is not None:
                column = self.value.column
                had, new = F.col("_had"), F.col(column)
                candidates = candidates.join(known.withColumnRenamed(column, "_had"), self.keys, "left").withColumn(
                    column, F.when(had.isNull(), new).otherwise(self.value.gain(new, had))).drop("_had").where(new.isNotNull())
                continue
            if self.span is None:
                candidates = candidates.join(known, self.keys, "left_anti")
                continue
            since, until = self.span
            there = known.select(*[F.col(c).alias(f"_{c}") for c in known.columns])
            covers = [F.col(f"_{k}") == F.col(k) for k in self.keys] + [F.col(f"_{since}") <= F.col(since), F.col(until) <= F.col(f"_{until}")]
            candidates = candidates.join(there, covers, "left_anti")
        return candidates

    def close(self) -> None:
        """Drop the tables with their files: the rounds are stored apart from them."""
        self._drop([name for name, _ in self.tables])
        self.tables = []

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_folder(self.spark, f"{self.base}/{name}")


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str],
             max_rounds: int | None = None, stop_at_max: bool = False, name: str = "fixpoint",
             span: tuple[str, str] | None = None, merge_rows: int = MERGE_ROWS, leads_on: str | None = None,
             value: Value | None = None, ends: str | None = None) -> DataFrame:
    """All rows reachable from `seed` by repeating `step`; `round` tells when a key was first found.

    `step` maps the newest rows to candidates with the columns of `seed`. Each round is written
    once, as a new part of the result table, and lost executors only cost the running round. A candidate whose key is known is dropped, so loops in the data end the
    iteration; `max_rounds` is for steps that make new keys without end.

    With `span`, two columns, a row holds for its key from the first up to before the second: overlapping spans of a round
    are merged, and a candidate is known if one known span covers it.

    With `value`, a key comes back in each round that finds more of it: with the new bits (`bits`) or with a smaller value (`least`).

    With `ends`, `step` also gets the least and the greatest value that the newest rows have in that column, so that it can leave out what
    it joins beyond them.

    `leads_on` is a condition that `step` asks of a row: a round without such rows is the last, and no empty one follows it.
    """
    spark = seed.sparkSession
    columns = seed.columns
    base = new_folder(spark, name)
    paths: list[str] = []
    counts = {"leading": F.expr(leads_on)} if leads_on else None
    known = Known(spark, name, keys, span, merge_rows, value)
    once = (lambda rows: merge_spans(rows, keys, *span)) if span else known._merged if value else (lambda rows: rows.dropDuplicates(keys))
    fresh = once(seed)
    n = 0
    try:
        while True:
            paths.append(f"{base}/part-{n:05d}")
            frontier, seen = cut(fresh.withColumn("round", F.lit(n)), path=paths[-1], counts=counts, ends=ends)
            n += 1
            if seen["leading" if leads_on else "rows"] == 0 or n - 1 == max_rounds and stop_at_max:
                return spark.read.schema(frontier.schema).parquet(*paths)
            if max_rounds is not None and n > max_rounds:
                raise RuntimeError(f"{name}: no fixpoint after {max_rounds} rounds (is there a cycle?)")
            known.add(frontier, paths[-1], seen["rows"])
            told = () if ends is None else ((F.lit(seen["least"]), F.lit(seen["greatest"])),)
            fresh = known.without(once(step(frontier, *told).select(*columns)))
    finally:
        known.close()
