"""How filters interact: what each of them removes in every order, from decision diagrams of failure masks.

1. `failures`: one pass over the texts gives every document a mask with one bit for each filter that it fails. The bit of
   `repeated text` needs the whole table: it is set unless the document has the smallest doc_id among equal texts.
2. `mask_weights`: documents, good and toxic ones per part and mask, at most 2^n rows per part.
3. `Diagram`: the weights of a part as a decision diagram with one level per filter. A node holds the weight of all
   documents below it and two branches, passed and failed; equal parts of a level are one node. Exchanging two adjacent
   levels rewires only the nodes of these two levels, and the plain changes visit all n! orders by n! - 1 such swaps. The
   path of passed branches tells what is left after each step of the order, the failed branches beside it what the step
   removes. The fails of a filter alone are read where it comes first, what nothing else catches where it comes last.
4. `audit`: one row per part, order and step.

Texts enter by their whole content; equal texts are those of equal SHA-256. A null text is empty, a null source is the part
''. A document without doc_id is smaller than no other and repeats none, and has no labels. Rows that repeat a doc_id are
documents of their own, and repeat each other's text only below another id. Several labels of one doc_id: 1 if any says 1.
An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import piece_of, pieces, word_runs
from strandline.plans import cut

FILTERS = "ABCDE"
REPEATED = FILTERS.index("E")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
MEASURES = ("n", "good", "toxic")
Weight = tuple[int, ...]


def _mask(text: bytes) -> int:
    """The bits of the four filters that need nothing but the text."""
    n, seen = 0, set()
    for words in word_runs(text):
        n += len(words)
        seen.update(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    chars = len(text.translate(None, _CONTINUED))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return (n < 50) | (100 * len(seen) < 65 * n) << 1 | (100 * upper > 5 * chars) << 2 | marked << 3


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the text), mask: one row for each row of `docs` (doc_id, text, source)."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            raw, at = piece_of(piece, "text")
            texts = [raw[a:b].tobytes() for a, b in pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array([_mask(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(measure, "doc_id long, part string, digest binary, mask int")


def mask_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of every part by the set of filters that they fail."""
    # equal rows are counted before anything is joined, so a doc_id that many rows share is one row from here on
    grouped = failures(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    facts, _ = cut(grouped, "audit-facts")
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = facts.join(told, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    repeats = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(repeats, 1 << REPEATED).otherwise(0))
    return marked.groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


class Node:
    """Documents that agree in the filters above: those that pass the filter of this level and those that fail it."""

    __slots__ = ("failed", "passed", "weight")

    def __init__(self, weight: Weight, passed: Node | None = None, failed: Node | None = None):
        self.weight, self.passed, self.failed = weight, passed, failed


class Diagram:
    """The weights of failure masks; `order[k]` is the filter of level k."""

    def __init__(self, weights: dict[int, Weight], n: int, measures: int = len(MEASURES)):
        self.order = list(range(n))
        self.levels: list[dict] = [{} for _ in range(n + 1)]  # per level: what a node consists of -> the node
        zero = (0,) * measures
        below = [self._leaf(weights.get(mask, zero)) for mask in range(1 << n)]
        for level in reversed(range(n)):  # mask bits at and above `level` are still open: bit `level` is the topmost undecided one
            half = 1 << level
            below = [self._node(level, below[mask], below[mask | half]) for mask in range(half)]
        self.root = below[0]

    def _leaf(self, weight: Weight) -> Node:
        return self.levels[-1].setdefault(weight, Node(weight))

    def _node(self, level: int, passed: Node, failed: Node) -> Node:
        table, key = self.levels[level], (id(passed), id(failed))
        if key not in table:
            table[key] = Node(tuple(map(sum, zip(passed.weight, failed.weight, strict=True))), passed, failed)
        return table[key]

    def swap(self, k: int) -> None:
        """Exchange levels k and k + 1. Nodes of level k stay the same objects, so what lies above needs no change."""
        upper = list(self.levels[k].values())
        parts = [(f.passed.passed, f.passed.failed, f.failed.passed, f.failed.failed) for f in upper]
        self.levels[k], self.levels[k + 1] = {}, {}
        for f, (pp, pf, fp, ff) in zip(upper, parts, strict=True):
            f.passed, f.failed = self._node(k + 1, pp, fp), self._node(k + 1, pf, ff)
            self.levels[k][id(f.passed), id(f.failed)] = f
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """(filter, kept, removed) along the path of the documents that pass everything."""
        node = self.root
        for which in self.order:
            yield which, node.passed.weight, node.failed.weight
            node = node.passed


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1, one after the other, visit all orders of n things once."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + 1 if down else place
        down = not down


def all_steps(weights: dict[int, Weight], n: int) -> dict[tuple[int, ...], list[tuple[int, Weight, Weight]]]:
    """Every order of the filters with its steps."""
    diagram = Diagram(weights, n)
    found = {tuple(diagram.order): list(diagram.steps())}
    for place in plain_changes(n):
        diagram.swap(place)
        found[tuple(diagram.order)] = list(diagram.steps())
    return found


def _report(part: str, weights: dict[int, Weight], filters: str) -> Iterator[tuple]:
    found = all_steps(weights, len(filters))
    fails, alone, shares = ([0] * len(filters) for _ in range(3))
    for steps in found.values():
        fails[steps[0][0]] = steps[0][2][0]
        alone[steps[-1][0]] = steps[-1][2][0]
        for which, _, removed in steps:
            shares[which] += removed[0]
    for order, steps in found.items():
        name = "".join(filters[i] for i in order)
        for at, (which, kept, removed) in enumerate(steps, 1):
            yield part, name, at, kept[0], removed[0], fails[which] - removed[0], alone[which], removed[1], removed[2], shares[which]


REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
          "toxic_lost long, shapley long")


def audit(weights: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of all orders of `filters`, from (part, mask, n, good, toxic); bit i of a mask is a failure of filters[i].

    A part is one row of at most 2^n entries in a task. n! orders are reported: meant for a handful of filters.
    """
    entries = F.collect_list(F.struct("mask", *MEASURES)).alias("entries")
    grouped = weights.groupBy("part").agg(entries)
    schema = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()])
                        for f in weights.sparkSession.createDataFrame([], REPORT).schema.fields])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                by_mask = {e["mask"]: tuple(e[m] for m in MEASURES) for e in rows}
                columns = zip(*_report(part, by_mask, filters), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return grouped.mapInArrow(report, REPORT)
