"""Removal of repeated passages: every byte covered by a WINDOW-byte string that also starts anywhere else.

Sorting all suffixes of a corpus would shuffle many times its bytes. A window is instead found through its anchor: the
leftmost smallest hash among its ANCHOR-byte strings. Equal windows have equal anchors at the same place, and consecutive
windows with one anchor form a block. So two equal windows lie in blocks of one anchor hash, and

1. blocks that are equal as a whole repeat as a whole (one shuffle of hashes decides that);
2. among the different blocks of an anchor, the suffixes that start at the anchor, and the reversed text before it, are
   sorted: a mergesort whose comparisons find the common extension of two suffixes by binary search over prefix
   polynomial hashes. Neighbours in the sorted orders are checked byte by byte; should two hashes have collided, the order
   is made again from the bytes. Walking outwards from a block in either order, the common extension to one side falls
   while a bound on that to the other side is known, so the walk ends early. It yields the first and the last repeated
   window of the block, and all windows of a block overlap;
3. an anchor with more than GROUP_MAX different blocks is not sorted in one task: its windows are hashed one by one and
   counted, which gives the same two windows.

Texts are UTF-8 bytes; null counts as empty. Matches never cross texts. Texts shorter than WINDOW bytes stay as they are.
Repeated rows repeat each other's text and lose all of it that is WINDOW bytes or longer. Rows are matched by doc_id and
text, so equal or null ids do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import mix, piece_of, pieces
from strandline.plans import cut

WINDOW, ANCHOR = 200, 40
STARTS = WINDOW - ANCHOR + 1
SEGMENT = 1 << 20
GROUP_MAX = 4096
CHUNK = 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = (1 << 24) - 1


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse))), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def _blocks(raw: np.ndarray, at: np.ndarray, powers: _Powers) -> tuple[np.ndarray, ...]:
    """text, start in raw, size, offset of the anchor, hash of the anchor: of every block of the texts raw[at[i]:at[i + 1]]."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none.astype(np.uint64)
    up, down = powers.of(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up, dtype=np.uint64)))
    grams = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[:n - ANCHOR + 1])
    least = (grams & ~np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < STARTS:
        least = np.minimum(least[:n - WINDOW + 1], least[STARTS - width:STARTS - width + n - WINDOW + 1])
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.flatnonzero(np.diff(at) >= WINDOW)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - WINDOW + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchors = (least[starts] & np.uint64(_PLACE)).astype(np.int64)
    text = np.searchsorted(at, starts, side="right") - 1
    first = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((first[1:], [len(starts)])) - 1
    start = starts[first]
    return text[first], start, starts[last] - start + WINDOW, anchors[first] - start, grams[anchors[first]]


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _anchors(packed: DataFrame) -> DataFrame:
    """doc_id, text_key, place (start, size and anchor of a block in one number), anchor_hash, block_hash."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for piece in pieces(batches, "text"):
            raw, at = piece_of(piece, "text")
            ends = range(0, max(1, len(raw) - WINDOW + 1), SEGMENT) if piece.num_rows == 1 else (0,)
            for begin in ends:
                part = raw[begin:begin + SEGMENT + WINDOW - 1] if piece.num_rows == 1 else raw
                text, start, size, anchor, hashes = _blocks(part, np.array([0, len(part)]) if piece.num_rows == 1 else at, powers)
                data = part.tobytes()
                block = np.fromiter((xxhash.xxh3_64_intdigest(data[a:a + b]) for a, b in zip(start.tolist(), size.tolist(),
                                                                                         strict=True)), np.uint64, len(start))
                place = ((start + begin - at[text]) << 16) | ((size - WINDOW) << 8) | anchor
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(rows), piece.column("text_key").take(rows), pa.array(place),
                     pa.array(hashes.view(np.int64)), pa.array(block.view(np.int64))],
                    ["doc_id", "text_key", "place", "anchor_hash", "block_hash"])

    return packed.mapInArrow(find, "doc_id long, text_key long, place long, anchor_hash long, block_hash long")


def _packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, for the joins that must move them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for piece in pieces(batches, "text"):
            raw, at = piece_of(piece, "text")
            data = raw.tobytes()
            packed = [squeeze.compress(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(packed, pa.binary())],
                                             ["doc_id", "text_key", "packed"])

    return docs.mapInArrow(pack, "doc_id long, text_key long, packed binary")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted blocks (doc_id, text_key, place, anchor_hash, open, n_blocks)."""
    asked = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(
        F.collect_list(F.struct("place", "anchor_hash", "open", "n_blocks")).alias("asked"))
    both = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = expand.decompress(row["packed"])
                asks = row["asked"]
                places = np.array([x["place"] for x in asks], np.int64)
                start, size = places >> 16, ((places >> 8) & 255) + WINDOW
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["anchor_hash"] for x in asks], pa.int64()), pa.array([x["n_blocks"] for x in asks], pa.int64()),
                     pa.array([row["doc_id"]] * len(asks), pa.int64()), pa.array([row["text_key"]] * len(asks), pa.int64()),
                     pa.array(start), pa.array(places & 255), pa.array([x["open"] for x in asks], pa.bool_()),
                     pa.array([data[a:a + b] for a, b in zip(start.tolist(), size.tolist(), strict=True)], pa.binary())],
                    ["anchor_hash", "n_blocks", "doc_id", "text_key", "start", "anchor", "open", "block"])

    return both.select("doc_id", "text_key", "packed", "asked").mapInArrow(
        slices, "anchor_hash long, n_blocks long, doc_id long, text_key long, start long, anchor long, open boolean, block binary")


class _Suffixes:
    """Strings in the rows of a matrix, their prefix hashes, and their order inside groups of consecutive rows."""

    def __init__(self, chars: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.chars, self.sizes, self.group = chars, sizes, group
        self.hashes = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        for j in range(chars.shape[1]):
            self.hashes[:, j + 1] = self.hashes[:, j] * _BASE + _BYTE[chars[:, j]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of the rows a and b: binary search over equal prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        while True:
            going = low < high
            if not going.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low, high = np.where(going & same, middle, low), np.where(going & ~same, middle - 1, high)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; a start of the other row comes first."""
        k = self.common(a, b)
        end_a, end_b = k >= self.sizes[a], k >= self.sizes[b]
        at = np.minimum(k, self.chars.shape[1] - 1)
        return np.where(end_a | end_b, end_a & ~end_b, self.chars[a, at] < self.chars[b, at])

    def order(self) -> np.ndarray:
        """The rows, group by group, sorted by mergesort: all pairs of runs of a level are merged at once."""
        order = np.arange(len(self.chars))
        if not len(order):
            return order
        first = np.searchsorted(self.group, self.group)
        count = np.searchsorted(self.group, self.group, side="right") - first
        width = 1
        while width < count.max():
            inside = np.arange(len(order)) - first
            run = inside // width
            sibling = (run ^ 1) * width
            low = first + np.minimum(sibling, count)
            high = first + np.minimum(sibling + width, count)
            start = low.copy()
            right = run & 1 == 1
            while True:
                going = np.flatnonzero(low < high)
                if not len(going):
                    break
                middle = (low[going] + high[going]) >> 1
                mine, other = order[going], order[middle]
                # a row of the right run comes after equal rows of the left run
                passes = np.where(right[going], ~self.before(mine, other), self.before(other, mine))
                low[going] = np.where(passes, middle + 1, low[going])
                high[going] = np.where(passes, high[going], middle)
            place = first + (run // 2) * 2 * width + (inside - run * width) + (low - start)
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            width *= 2
        return order

    def checked(self) -> tuple[np.ndarray, np.ndarray]:
        """The order and the common extension of each row with the next in it (0 at the end of a group), both true of the
        bytes: neighbours are compared, and if a hash misled the sort, the bytes themselves are sorted."""
        order = self.order()
        extent = self._extents(order)
        if extent is None:
            for i in np.unique(self.group):
                rows = np.flatnonzero(self.group == i)
                order[rows] = rows[sorted(range(len(rows)), key=lambda r: self.chars[rows[r], :self.sizes[rows[r]]].tobytes())]
            extent = self._true_common(order[:-1], order[1:])
            extent = np.concatenate((np.where(self.group[order[:-1]] == self.group[order[1:]], extent, 0), [0]))
        return order, extent

    def _true_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = self.chars[a] == self.chars[b]
        full = np.minimum(self.sizes[a], self.sizes[b])
        return np.minimum(np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)), full)

    def _extents(self, order: np.ndarray) -> np.ndarray | None:
        a, b = order[:-1], order[1:]
        found = self.common(a, b)
        if (found != self._true_common(a, b)).any():
            return None
        return np.concatenate((np.where(self.group[a] == self.group[b], found, 0), [0])) if len(order) else found


def _outwards(own: _Suffixes, other: _Suffixes, open_: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """For each open row the largest extension in `own` with a row of its group whose extension in `other` adds up to `need`,
    and the extension in `other` that goes with it; -1 without one."""
    order, extent = own.checked()
    other_order, other_extent = other.checked()
    reach = np.zeros(len(order), np.int64)  # most that any row of the group shares in `other`
    reach[other_order] = np.maximum(other_extent, np.concatenate(([0], other_extent[:-1]))) if len(order) else 0
    position = np.empty_like(order)
    position[order] = np.arange(len(order))
    best, with_it = np.full(len(order), -1), np.full(len(order), -1)
    for step in (1, -1):
        rows = np.flatnonzero(open_)
        here = position[rows]
        shared = np.full(len(rows), np.iinfo(np.int64).max)
        while len(rows):
            gate = here if step == 1 else here - 1
            there = here + step
            inside = (there >= 0) & (there < len(order))
            inside[inside] &= own.group[order[there[inside]]] == own.group[rows[inside]]
            rows, there, gate, shared = rows[inside], there[inside], gate[inside], shared[inside]
            shared = np.minimum(shared, extent[gate])
            going = (shared + reach[rows] >= need) & (shared > best[rows])
            rows, there, shared = rows[going], there[going], shared[going]
            partner = order[there]
            far = other._true_common(rows, partner) if len(rows) else shared
            hit = shared + far >= need
            best[rows[hit]], with_it[rows[hit]] = shared[hit], far[hit]
            rows, here, shared = rows[~hit], there[~hit], shared[~hit]
    return best, with_it


def _repeated_windows(group: np.ndarray, anchor: np.ndarray, blocks: list[bytes], open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from the anchor of the first and the last repeated window of each open block; (-1, -1) without one.

    A window that starts l bytes before the anchor is shared with a block that agrees on l bytes before it and on
    WINDOW - l bytes from it on.
    """
    size = np.array([len(b) for b in blocks], np.int64)
    after = np.zeros((len(blocks), int((size - anchor).max())), np.uint8)
    before = np.zeros((len(blocks), max(1, int(anchor.max()))), np.uint8)
    for i, block in enumerate(blocks):
        a = int(anchor[i])
        after[i, :len(block) - a] = np.frombuffer(block, np.uint8, offset=a) if len(block) > a else 0
        before[i, :a] = np.frombuffer(block[:a][::-1], np.uint8)
    left, right = _Suffixes(before, anchor, group), _Suffixes(after, size - anchor, group)
    earliest, _ = _outwards(left, right, open_, WINDOW)
    longest, _ = _outwards(right, left, open_, WINDOW)
    latest = np.where(longest >= 0, np.maximum(WINDOW - longest, 0), -1)
    return earliest, latest


def _sorted_matches(contexts: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end of the repeated part of open blocks, anchor by anchor."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "start", "end"]

        def solve(rows: pa.Table) -> pa.RecordBatch:
            ids = np.asarray(rows.column("anchor_hash"))
            group = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))
            anchor, start = np.asarray(rows.column("anchor")), np.asarray(rows.column("start"))
            open_ = rows.column("open").to_numpy(zero_copy_only=False)
            earliest, latest = _repeated_windows(group, anchor, rows.column("block").to_pylist(), open_)
            hit = np.flatnonzero(earliest >= 0)
            at = pa.array(hit)
            return pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(at).combine_chunks(), rows.column("text_key").take(at).combine_chunks(),
                 pa.array((start + anchor - earliest)[hit]), pa.array((start + anchor - latest + WINDOW)[hit])], names)

        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            while waiting.num_rows > CHUNK:
                ids = np.asarray(waiting.column("anchor_hash"))
                ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1  # whole groups only
                fitting = ends[ends <= CHUNK]
                end = int(fitting[-1]) if len(fitting) else int(ends[0]) if len(ends) else 0
                if not end:
                    break
                yield solve(waiting.slice(0, end))
                waiting = waiting.slice(end)
        if waiting is not None and waiting.num_rows:
            yield solve(waiting)

    return (contexts.repartition("anchor_hash").sortWithinPartitions("anchor_hash")
            .select("anchor_hash", "doc_id", "text_key", "start", "anchor", "open", "block")
            .mapInArrow(match, "doc_id long, text_key long, start long, end long"))


def _counted_matches(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many blocks: their windows, counted by hash."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, n = row["block"], len(row["block"]) - WINDOW + 1
                offset = np.arange(n) + row["start"]
                digests = [xxhash.xxh3_128_digest(block[j:j + WINDOW]) for j in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([row["doc_id"]] * n, pa.int64()),
                     pa.array([row["text_key"]] * n, pa.int64()), pa.array([row["anchor_hash"]] * n, pa.int64()),
                     pa.array([row["start"]] * n, pa.int64()), pa.array(offset)],
                    ["window", "doc_id", "text_key", "anchor_hash", "block", "at"])

    every = contexts.select("anchor_hash", "doc_id", "text_key", "start", "block").mapInArrow(
        windows, "window binary, doc_id long, text_key long, anchor_hash long, block long, at long")
    twice = every.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return (every.join(twice, "window").groupBy("doc_id", "text_key", "anchor_hash", "block")
            .agg(F.min("at").alias("start"), (F.max("at") + WINDOW).alias("end")).select("doc_id", "text_key", "start", "end"))


def repeated_spans(docs: DataFrame, group_max: int = GROUP_MAX) -> DataFrame:
    """doc_id, text_key, start, end: byte ranges whose union is what repeats. `docs` has doc_id, text_key, text."""
    found = _anchors(docs)
    # written first, so that the join below reads plain exchanges and hot anchors can be split
    known, _ = cut(found.groupBy("anchor_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor_hash"),
                   "passage-repeated")
    shared, _ = cut(found.join(known, "anchor_hash"), "passage-anchors")
    blocks = shared.groupBy("anchor_hash", "block_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("one"))
    blocks, _ = cut(blocks, "passage-blocks")
    start = F.shiftright("place", 16)
    size = F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("long")) + WINDOW
    whole = (shared.join(blocks.where("n > 1").select("anchor_hash", "block_hash"), ["anchor_hash", "block_hash"])
             .select("doc_id", "text_key", start.alias("start"), (start + size).alias("end")))
    mixed = blocks.groupBy("anchor_hash").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("n").alias("least")).where(
        "n_blocks > 1 AND least = 1").select("anchor_hash", "n_blocks")
    wanted = blocks.join(mixed, "anchor_hash").select("one.*", "anchor_hash", (F.col("n") == 1).alias("open"), "n_blocks")
    # a repeated row brings its blocks twice, but none of them is open
    contexts, seen = cut(_contexts(_packed(docs), wanted), "passage-contexts",
                         counts={"large": F.col("n_blocks") > group_max})
    matches = _sorted_matches(contexts.where(F.col("n_blocks") <= group_max))
    if seen["large"]:
        matches = matches.unionByName(_counted_matches(contexts.where(F.col("n_blocks") > group_max)))
    return whole.unionByName(matches)


def remove_repeats(docs: DataFrame, whole_characters: bool = False, group_max: int = GROUP_MAX) -> DataFrame:
    """doc_id, text_key, n_bytes, spans (start and end of each removed run), kept (the remaining bytes), for each row.

    With `whole_characters` a run gives up the parts of UTF-8 characters at its ends, so that what is left is text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
    spans = repeated_spans(keyed, group_max).groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    both = _packed(keyed).join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sizes, runs, kept = [], [], []
                for packed, asked in zip(part.column("packed"), part.column("spans"), strict=True):
                    data = expand.decompress(packed.as_py())
                    out, at, left = [], 0, []
                    for x in _merged(asked.as_py() or []):
                        a, b = _on_characters(data, *x) if whole_characters else x
                        if a < b:
                            out.append({"start": a, "end": b})
                            left.append(data[at:a])
                            at = b
                    left.append(data[at:])
                    sizes.append(len(data))
                    runs.append(out)
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()),
                     pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    ["doc_id", "text_key", "n_bytes", "spans", "kept"])

    return both.select("doc_id", "text_key", "packed", "spans").mapInArrow(
        strip, "doc_id long, text_key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def _on_characters(data: bytes, start: int, end: int) -> tuple[int, int]:
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with texts stripped of repeated passages and n_chars counted anew; texts may become empty, rows all stay.

    A text of null stays null. Only the texts move; the other columns are joined back by doc_id and text.
    """
    kept = remove_repeats(docs, whole_characters=True).where("size(spans) > 0").select(
        "doc_id", "text_key", F.col("kept").cast("string").alias("left")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("_d"), _text_key().alias("_k"))
    stripped = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        stripped = stripped.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    same = F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("text_key"))
    return rows.join(kept, same, "left").select(
        F.when(F.col("left").isNull(), F.col("row")).otherwise(stripped).alias("row")).select("row.*")
