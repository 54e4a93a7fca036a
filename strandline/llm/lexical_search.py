"""Ranked lexical search: short lists summed first, long lists walked document at a time.

1. `term_rows` cuts every document into terms and keeps those that the queries may hold: a bitmap of FILTER_BITS bits, whatever the
   number of query terms, tells most others apart in the tasks, and an exact join later drops what slips through.
2. `query_terms` joins the terms of the queries with their document counts and gives every term its integer weight.
3. Documents are dealt into shards of about SHARD postings, queries into blocks of about BLOCK terms; a shard and a block meet
   in a task (`_Shard`). There the lists of a query with at most SHORT entries, shortest first and ACCUMULATED entries in all, are added
   up term at a time into accumulators, sorted by document. These are one more list from then on, bounded by its largest
   sum. Accumulators and long lists are walked in document order, in steps of STEP documents: lists whose bounds
   together stay below the score that a document needs are not walked but looked up, largest bound first, for the documents
   that can still get in; steps without a document of a walked list are skipped.
4. The best of all shards are ranked per query.

Bounds are exact integers and a later document needs a higher score (ties go to the smaller doc_id, then no id), so the answer is
that of adding up everything. Terms are maximal runs of letters and digits of ASCII and of all other characters above 0x7F; only A-Z
are lower-cased. A document is a row: null or empty texts have no terms and are no match, rows that repeat an id are ranked each, rows
without one come last among equals. Rows of one item_id are one query with the terms of all; a query without a match has no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import piece_of, pieces, word_runs
from strandline.plans import cut

TOP = 10
FILTER_BITS = 1 << 23
SHARD, BLOCK = 1 << 20, 1 << 17
SHORT, ACCUMULATED, STEP = 1024, 1 << 16, 4096
_AS_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def count_terms(text: bytes) -> Counter:
    """Terms of a text and how often they occur."""
    found: Counter = Counter()
    for run in word_runs(text.translate(_AS_SPACE)):
        found.update(run)
    return found


class _Filter(dict):
    """term -> whether the bitmap may hold it; forgets all when it grows too large."""

    LIMIT = 500_000

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh64_intdigest(term, 42)  # what F.xxhash64 gives
        one, two = h % FILTER_BITS, (h >> 32) % FILTER_BITS
        value = self[term] = bool(self.bitmap[one >> 3] >> (one & 7) & self.bitmap[two >> 3] >> (two & 7) & 1)
        return value


def _cut_terms(rows: DataFrame, key: str, bitmap: bytes | None = None) -> DataFrame:
    """key, line (row in its task), n (terms with repeats), terms, tfs: of the rows (key, text) with a term."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, line = _Filter(bitmap) if bitmap else None, 0
        for piece in pieces(batches, "text"):
            raw, at = piece_of(piece, "text")
            counts = [count_terms(raw[a:b].tobytes()) for a, b in pairwise(at.tolist())]
            kept = [[(t, c) for t, c in found.items() if known is None or known[t]] for found in counts]
            ends = np.cumsum([0] + [len(k) for k in kept]).astype(np.int32)
            flat = [pair for k in kept for pair in k]
            names = pa.array([t for t, _ in flat], pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays(
                [piece.column(key), pa.array(np.arange(line, line + len(kept))), pa.array([f.total() for f in counts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), names),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array([c for _, c in flat], pa.int64()))], [key, "line", "n", "terms", "tfs"])
            line += len(kept)
            yield out.filter(pc.greater(out.column("n"), 0))

    return rows.select(F.col(key).cast("long").alias(key), "text").mapInArrow(
        terms, f"{key} long, line long, n long, terms array<string>, tfs array<long>")


def _bitmap(terms: DataFrame) -> bytes:
    """The filter of `terms` (term): at most FILTER_BITS / 64 numbers come to the driver."""
    h = F.xxhash64("term")
    places = F.array(F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(FILTER_BITS)))
    words = (terms.select(F.explode(places).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.collect():
        bits[row["word"]] = row["bits"]
    return bits.tobytes()


def term_weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of a column of lists, and where each list starts and ends among them."""
    values = column.combine_chunks()
    return values.flatten(), np.cumsum([0, *pc.list_value_length(values).to_pylist()])


class _Shard:
    """The postings of some documents, in order of their ids."""

    def __init__(self, docs: pa.Table, n_docs: int, n_terms: int, names: pa.Array):
        docs = docs.combine_chunks()
        order = pc.sort_indices(docs, [("doc_id", "ascending"), ("line", "ascending")], null_placement="at_end")
        docs = docs.take(order)
        self.ids = docs.column("doc_id")
        m = 10 + 90 * docs.column("n").to_numpy() * n_docs // n_terms
        (terms, at), (tfs, _) = (_lists(docs.column(c)) for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(docs), dtype=np.int64), np.diff(at))
        term = pc.index_in(terms, names).fill_null(-1).to_numpy(zero_copy_only=False)
        tf, used = tfs.to_numpy(), term >= 0
        doc, term, tf = doc[used], term[used], tf[used]
        share = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        by_term = np.argsort(term, kind="stable")  # documents stay in order inside a term
        self.docs, self.shares = doc[by_term], share[by_term]
        self.at = np.searchsorted(term[by_term], np.arange(len(names) + 1))

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) of each term that occurs and counts."""
        cuts = [(self.at[t], self.at[t + 1], w) for t, w in zip(terms, weights, strict=True) if w > 0]
        return [(self.docs[a:b], w * self.shares[a:b]) for a, b, w in cuts if a < b]


def add_up(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators of several lists: documents in order with the sums of their scores."""
    docs, scores = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    starts = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[starts], np.add.reduceat(scores, starts)


def best(lists: list[tuple[np.ndarray, np.ndarray]], top: int = TOP, short: int = SHORT, accumulated: int = ACCUMULATED,
         step: int = STEP, walked: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the `top` highest sums above 0, ties to the smaller document. `walked` collects for tests how
    many entries of lists were read in steps."""
    none = np.zeros(0, np.int64)
    lists = sorted(lists, key=lambda x: len(x[0]))
    sizes = np.cumsum([0] + [len(x[0]) for x in lists])
    n_short = sum(1 for x, upto in zip(lists, sizes[1:], strict=True) if len(x[0]) <= short and upto <= accumulated)
    if n_short:
        lists = [add_up(lists[:n_short]), *lists[n_short:]]
    lists = sorted(((int(s.max()), d, s) for d, s in lists), key=lambda x: x[0])
    if not lists:
        return none, none
    reach = np.cumsum([b for b, _, _ in lists])  # what a document that is in no list above can get at most
    ends = [0] * len(lists)
    docs, scores, needed = none, none, 0  # a document enters with a score above `needed`
    while True:
        first = int(np.searchsorted(reach, needed, side="right"))  # lists before this one are only looked up
        heads = []
        for i in range(first, len(lists)):
            heads += [int(lists[i][1][ends[i]])] if ends[i] < len(lists[i][1]) else []
        if not heads:
            return docs, scores
        low = min(heads)
        sums = np.zeros(step, np.int64)
        for i in range(first, len(lists)):
            _, d, s = lists[i]
            start, ends[i] = ends[i], int(np.searchsorted(d, low + step))
            start = max(start, int(np.searchsorted(d, low)))
            sums[d[start:ends[i]] - low] += s[start:ends[i]]
            if walked is not None:
                walked.append(ends[i] - start)
        found = np.flatnonzero(sums)
        total = sums[found]
        for i in range(first - 1, -1, -1):
            alive = total + reach[i] > needed
            found, total = found[alive], total[alive]
            _, d, s = lists[i]
            at = np.minimum(np.searchsorted(d, found + low), len(d) - 1)
            total = total + np.where(d[at] == found + low, s[at], 0)
        alive = total > needed
        docs, scores = np.concatenate((docs, found[alive] + low)), np.concatenate((scores, total[alive]))
        if len(docs) > top:
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]
        if len(docs) == top:
            needed = int(scores.min())


def _each(n: int) -> Column:
    """A row for each of 0..n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best rows of `docs` (doc_id, text) for each of `items` (item_id, text)."""
    asked, _ = cut(_cut_terms(items, "item_id").select("item_id", F.explode("terms").alias("term")).distinct(), "search-items")
    bitmap = _bitmap(asked.select("term").distinct())
    postings, _ = cut(_cut_terms(docs, "doc_id", bitmap), "search-postings")
    counts = postings.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"),
                          F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    n_docs, n_terms = counts["docs"], counts["terms"]
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "term").select("item_id", "term", term_weight(n_docs, F.col("df")).alias("w")).where("w > 0")
    queries, seen = cut(weighed, "search-queries")
    shards, blocks = max(1, -(-counts["postings"] // shard)), max(1, -(-seen["rows"] // block))
    one_each = queries.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("q")).select(
        F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), _each(shards).alias("shard"),
        "item_id", F.col("q.term").alias("terms"), F.col("q.w").alias("ws"))
    dealt = postings.select(_each(blocks).alias("block"),
                            F.pmod(F.xxhash64("doc_id", "line"), F.lit(shards)).alias("shard"), "doc_id", "line", "n", "terms", "tfs")

    def answer(docs: pa.Table, items: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(docs) and len(items):
            (terms, at), (weights, _) = (_lists(items.column(c)) for c in ("terms", "ws"))
            coded = terms.dictionary_encode()
            here = _Shard(docs, n_docs, n_terms, coded.dictionary)
            code, w = coded.indices.to_numpy(), weights.to_numpy()
            for item, (a, b) in zip(items.column("item_id").to_pylist(), pairwise(at.tolist()), strict=True):
                found, scores = best(here.lists(code[a:b], w[a:b]), top)
                out[0].extend([item] * len(found))
                out[1].extend(here.ids.take(pa.array(found)).to_pylist())
                out[2].extend(scores.tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], ["item_id", "doc_id", "score"])

    near = dealt.groupBy("block", "shard").cogroup(one_each.groupBy("block", "shard")).applyInArrow(
        answer, "item_id long, doc_id long, score long")
    line = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
