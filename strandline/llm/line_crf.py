"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good (1) or bad (0). A line's features are measures of its characters and words, those of the
line before and after it, and whether it repeats an earlier line of the text. The chain has a weight for each feature and
for each pair of neighbouring labels. Forward and backward messages give the probability that a line is good; the score of
a document is their mean, weighted by the lengths of the lines.

Training: every line of a labelled document carries the document's label. The field is fitted to the lines of at most
TRAIN_DOCS documents of at most TRAIN_CHARS characters, drawn by a digest of the id, by gradient ascent on the driver; that is
a bounded sample, all else covers all documents. Rows with a null id or label are not used. Without labels of both
kinds the field has zero weights and every score is 0.5.

Null and empty texts and texts without words count as one line without characters. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import piece_of, pieces

TRAIN_DOCS, TRAIN_CHARS = 3000, 20_000
STEPS, RATE, DECAY = 120, 0.1, 1e-3
_SETS = (b" \t\n\r\x0b\f", b"#*$%&|<>", b"!?", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:", bytes(range(128, 256)))
_CLASS = np.zeros((len(_SETS), 256), np.uint8)
for _row, _members in enumerate(_SETS):
    _CLASS[_row, list(_members)] = 1
OWN = len(_SETS) + 7
FEATURES = 3 * OWN + 2


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths in bytes, offsets of the texts) of the lines with a word in the texts raw[at[i]:at[i + 1]]."""
    data = raw.tobytes()
    sums = np.concatenate((np.zeros((len(_SETS), 1), np.int64), np.cumsum(_CLASS[:, raw], axis=1, dtype=np.int64)), axis=1)
    starts, ends, words, counts = [], [], [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        seen: set[bytes] = set()
        n, here = 0, a
        for line in data[a:b].split(b"\n"):
            parts = line.split()
            if parts:
                starts.append(here)
                ends.append(here + len(line))
                twins = sum(x == y for x, y in zip(parts, parts[1:], strict=False))
                words.append((len(parts), len(set(parts)) / len(parts), twins / len(parts), line in seen))
                seen.add(line)
                n += 1
            here += len(line) + 1
        if not n:
            starts.append(a)
            ends.append(a)
            words.append((0, 1.0, 0.0, False))
            n = 1
        counts.append(counts[-1] + n)
    start, end, offsets = np.array(starts, np.int64), np.array(ends, np.int64), np.array(counts, np.int64)
    length = end - start
    shares = (sums[:, end] - sums[:, start]) / np.maximum(length, 1)
    w = np.array(words, np.float64).reshape(-1, 4)
    own = np.column_stack([shares.T, np.log1p(length), np.log1p(w[:, 0]), w[:, 1], w[:, 2], w[:, 3], w[:, 0] < 4,
                           np.minimum(length / np.maximum(w[:, 0], 1), 40) / 10])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    opens, closes = np.zeros(len(own), bool), np.zeros(len(own), bool)
    opens[offsets[:-1]], closes[offsets[1:] - 1] = True, True
    before[opens], after[closes] = 0, 0
    return np.column_stack([own, before, after, opens, closes]).astype(np.float32), length, offsets


@dataclass
class Field:
    """Weights of a fitted field: of standardised features, a constant, and of label pairs (from, to)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float
    pairs: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, np.zeros((2, 2)))

    def unary(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights + self.constant


class Chains:
    """Chains of lines side by side: step t visits the t-th line of every chain that has one."""

    def __init__(self, offsets: np.ndarray):
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = offsets[:-1][order], sizes[order]
        alive = np.searchsorted(-sizes, -np.arange(int(sizes.max()) if len(sizes) else 0), side="left")
        self.steps = [first[:n] + t for t, n in enumerate(alive.tolist())]

    def messages(self, unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of a line being good from the lines up to it, and from the lines after it."""
        ahead, back = unary.copy(), np.zeros_like(unary)
        for now in self.steps[1:]:
            x = ahead[now - 1]
            ahead[now] += np.logaddexp(x + pairs[1, 1], pairs[0, 1]) - np.logaddexp(x + pairs[1, 0], pairs[0, 0])
        for now in reversed(self.steps[1:]):
            x = unary[now] + back[now]
            back[now - 1] = np.logaddexp(x + pairs[1, 1], pairs[1, 0]) - np.logaddexp(x + pairs[0, 1], pairs[0, 0])
        return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def marginals(field: Field, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability that each line is good."""
    ahead, back = Chains(offsets).messages(field.unary(features), field.pairs)
    return _sigmoid(ahead + back)


def fit(features: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> Field:
    """The field of largest penalised likelihood for documents whose lines carry the document's label."""
    field = Field.blank()
    if len(set(labels.tolist())) < 2:
        return field
    y = np.repeat(labels, np.diff(offsets)).astype(np.float64)
    field.mean = features.mean(axis=0, dtype=np.float64)
    field.scale = np.maximum(features.std(axis=0, dtype=np.float64), 1e-6)
    x = (features - field.mean) / field.scale
    chains = Chains(offsets)
    inner = np.ones(len(y), bool)
    inner[offsets[:-1]] = False
    inner = np.flatnonzero(inner)
    seen = np.array([[np.sum((y[inner - 1] == i) & (y[inner] == j)) for j in (0, 1)] for i in (0, 1)], np.float64)
    value = np.zeros(FEATURES + 5)
    mean_, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        weights, constant, pairs = value[:FEATURES], value[FEATURES], value[FEATURES + 1:].reshape(2, 2)
        unary = x @ weights + constant
        ahead, back = chains.messages(unary, pairs)
        miss = y - _sigmoid(ahead + back)
        a, b = ahead[inner - 1], unary[inner] + back[inner]
        joint = np.stack([np.full_like(a, pairs[0, 0]), b + pairs[0, 1], a + pairs[1, 0], a + b + pairs[1, 1]])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1) if len(inner) else np.zeros(4)
        slope = np.concatenate((x.T @ miss, [miss.sum()], seen.ravel() - expected)) / len(y) - DECAY * value
        mean_ = 0.9 * mean_ + 0.1 * slope
        square = 0.99 * square + 0.01 * slope ** 2
        value = value + RATE * (mean_ / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    field.weights, field.constant, field.pairs = value[:FEATURES], float(value[FEATURES]), value[FEATURES + 1:].reshape(2, 2)
    return field


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from the rows of `docs` (doc_id, text) that have a quality in `labels` (doc_id, quality) and are not held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").dropDuplicates(["doc_id"])
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).select("doc_id").distinct()
    drawn = known.join(short, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    chosen = F.broadcast(drawn)  # at most TRAIN_DOCS rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found, _, offsets = line_features(*piece_of(piece, "text"))
            rows = [found[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "lines"])

    sample = (docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).join(chosen, "doc_id")
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")
              .mapInArrow(measure, "doc_id long, quality int, lines binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect())
    if not sample:
        return Field.blank()
    each = [np.frombuffer(r["lines"], np.float32).reshape(-1, FEATURES) for r in sample]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in each])))
    return fit(np.concatenate(each), offsets, np.array([r["quality"] for r in sample]))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, n_lines, n_bad_lines of every row of `docs` (doc_id, text). One pass, no shuffle."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            features, length, offsets = line_features(*piece_of(piece, "text"))
            good = marginals(field, features, offsets)
            weight = length + 1.0
            total = np.add.reduceat(weight * good, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.clip(total, 0, 1)), pa.array(np.diff(offsets)),
                 pa.array(np.add.reduceat((good < 0.5).astype(np.int64), offsets[:-1]))], ["doc_id", "score", "n_lines", "n_bad_lines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(judge, "doc_id long, score double, n_lines long, n_bad_lines long")
