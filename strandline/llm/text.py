"""Texts inside tasks: pieces of Arrow batches as one byte array, words and their hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_of(rows: pa.RecordBatch | pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets of the texts); null counts as empty."""
    values = pc.fill_null(rows.column(column), "") if pa.types.is_string(rows.schema.field(column).type) else pc.fill_null(
        rows.column(column), b"")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `size` bytes in `column`, so that work memory has a bound.

    A text above that size is a piece of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = piece_of(batch, column)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + size, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def word_runs(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists of about `size` bytes, so that a long text is never a list of words as a whole."""
    start = 0
    while start < len(text):
        gap = _SPACE.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end].split()
        start = end


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; forgets all when it grows too large."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; of a shorter text the whole sequence as one; without words none."""
    if len(words) == 0:
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j:len(words) - size + 1 + j])
    return out
