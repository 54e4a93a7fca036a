"""Quality rules as a ledger: every rule is evaluated once per document, its failure is one bit.

The ledger keeps the measurements and the bits. Policies are versioned masks over the bits, so a policy is applied,
changed or ablated without reading a text again.

Words are runs of bytes other than space and 0x09-0x0D. Null and empty texts have no words and fail `few_words`. Repeated
rows are rows of their own. Columns that the ledger makes replace input columns of that name when carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import piece_of, pieces

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_letters",
            "n_upper", "n_exclaims")
#: name of the rule, what fails it; the position is the number of its bit and never changes
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("capitals", "10 * n_upper > 4 * n_letters AND 2 * n_letters > word_chars"),
    ("exclamations", "10 * n_exclaims > 4 * n_words"),
    ("adjacent_repeats", "10 * n_adjacent > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(name for name, _ in RULES))

_CLASS = np.zeros((5, 256), np.uint8)
_CLASS[0, [9, 10, 11, 12, 13, 32]] = 1
_CLASS[1, list(b"#*$%&|<>")] = 1
_CLASS[2, list(range(65, 91)) + list(range(97, 123))] = 1
_CLASS[3, list(range(65, 91))] = 1
_CLASS[4, list(b"!")] = 1


def _repeats(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words in windows that the text holds twice or more, and words equal to the word before."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for text in words for w in text]
    repeated, adjacent = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    if not flat:
        return repeated, adjacent
    h = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    text_of = np.repeat(np.arange(len(words)), sizes)
    same = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    adjacent += np.bincount(text_of[1:][same], minlength=len(words))
    n = len(h) - WINDOW + 1
    if n < 2:
        return repeated, adjacent
    run = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[j:n + j]
    inside = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1:])
    run, doc = run[inside], text_of[:n][inside]
    order = np.lexsort((inside, run, doc))
    twin = (run[order][1:] == run[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    covered, redo = np.zeros(len(h) + 1, np.int64), set()
    for k in np.flatnonzero(twin):
        a, b = int(inside[order[k]]), int(inside[order[k + 1]])
        if flat[a:a + WINDOW] != flat[b:b + WINDOW]:
            redo.add(int(text_of[a]))
    found = np.zeros(len(order), bool)
    found[1:] |= twin
    found[:-1] |= twin
    starts = inside[order[found]]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    repeated += np.bincount(text_of[np.cumsum(covered[:-1]) > 0], minlength=len(words))
    for d in redo:  # two windows with one hash: count these texts by their windows themselves
        repeated[d] = _repeated_words(words[d])
    return repeated, adjacent


def _repeated_words(words: list[bytes]) -> int:
    first: dict[tuple, int] = {}
    hit = np.zeros(len(words), bool)
    for i in range(len(words) - WINDOW + 1):
        j = first.setdefault(tuple(words[i:i + WINDOW]), i)
        if j != i:
            hit[i:i + WINDOW] = hit[j:j + WINDOW] = True
    return int(hit.sum())


def _measure(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    def counts(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[at[1:]] - total[at[:-1]]

    spaces, symbols, letters, upper, exclaims = (counts(c[raw]) for c in _CLASS)
    points = counts((raw & 0xC0) != 0x80)
    data = raw.tobytes()
    texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    words = [t.split() for t in texts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    repeated, adjacent = _repeats(words)
    n_lines = np.array([len(x) for x in lines], np.int64)
    return {"n_words": np.array([len(w) for w in words], np.int64), "word_chars": points - spaces, "n_symbols": symbols,
            "n_lines": n_lines, "n_dup_lines": n_lines - np.array([len(set(x)) for x in lines], np.int64),
            "n_repeat_words": repeated, "n_adjacent": adjacent, "n_letters": letters, "n_upper": upper, "n_exclaims": exclaims}


def ledger(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `carry` columns, the measures and `fail_bits` of every row of `docs`. One pass, no shuffle."""
    carry = tuple(c for c in carry if c not in MEASURES and c != "fail_bits")
    rows = docs.select(*carry, F.col(text).alias("_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            found = _measure(*piece_of(piece, "_text"))
            kept = [piece.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(found[m]) for m in MEASURES], [*carry, *MEASURES])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry), *(f"{m} long" for m in MEASURES)])
    measured = rows.mapInArrow(measure, schema)
    bits = [F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, fails) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("fail_bits", total)


def apply_policy(entries: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Adds `out`: no rule of the policy failed."""
    return entries.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that the policy would keep without it.

    One aggregation over the bits; an empty ledger gives zeros.
    """
    mask, names = policy.mask, [name for name, _ in RULES]
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = []
    for rule in policy.rules:
        bit = 1 << names.index(rule)
        sums.append(F.struct(F.lit(rule).alias("rule"), F.lit(policy.version).alias("policy"),
                             F.count_if(failed.bitwiseAND(F.lit(bit).cast("long")) != 0).alias("n_failed"),
                             F.count_if(failed == bit).alias("n_only")))
    return entries.agg(F.array(*sums).alias("found")).select(F.inline("found"))


def reject_documents(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of `docs` that the policy keeps, columns as they are."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_t"))
    judged = apply_policy(ledger(named, ("_row",), "_t"), policy, "_kept")
    return judged.where("_kept").select("_row.*")
