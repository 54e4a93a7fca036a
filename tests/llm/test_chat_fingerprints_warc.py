import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import chat_format, fingerprints, warc

TURNS = "conv_id long, turn long, role string, text string"


def test_formatting_reads_back(spark, rows):
    hard = ["\\### Assistant: </turn> ok", "<next/>", "\\b\\l<\\\\<turn user>", "", None, "é\n</turn>\n", "\\"]
    data = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "as>si\\st", None, "assistant"], hard, strict=True))]
    data += [(2, 3, "assistant", "b"), (2, 3, "assistant", "b"), (2, None, "user", "first"), (None, 0, "user", "x")]
    made = chat_format.format_conversations(rows(TURNS, *reversed(data)))
    read = {r.conv_id: r for r in made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.learned_text(
        F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(r or "", t or "") for _, _, r, t in data[:7]]
    assert read[1].loss == "".join(t or "" for _, _, r, t in data[:7] if r == "assistant")
    assert read[2].formatted == "<turn user>first</turn>\n<turn assistant>b<next/>b</turn>\n" and read[2].loss == "bb"
    assert read[None].loss == "" and len(read) == 3
    assert chat_format.format_conversations(rows(TURNS).limit(0)).count() == 0


def test_spans_of_long_conversations(spark, rows):
    data = [(k, i, "assistant" if i % 3 else "user", "t" * (i % 7)) for k, n in ((1, 3000), (2, 1), (3, 2), (4, 1025)) for i in range(n)]
    made = chat_format.format_conversations(rows(TURNS, *data)).withColumn("loss", chat_format.learned_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: (r.loss, len(r.loss_spans)) for r in made.collect()}
    assert got == {k: ("".join(t for c, _, r, t in data if c == k and r == "assistant"), sum(c == k and r == "assistant" for c, _, r, _ in data)) for k in (1, 2, 3, 4)}


def plain_slots(spark_hash, text):
    """The fingerprint by its definition, with Spark's own hash."""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    kmers = [tuple(words[i:i + 2]) for i in range(len(words) - 1)] if len(words) >= 2 else [(w,) for w in words]
    seen, items = collections.Counter(), []
    for place, kmer in enumerate(kmers):
        top = spark_hash(*kmer) >> 24
        items.append((top, place))
    numbered = []
    for top, place in items:
        numbered.append((spark_hash(top, seen[top]), place))
        seen[top] += 1
    slots = collections.defaultdict(list)
    for h, place in sorted(((h >> 24) << 24 | place, place) for h, place in numbered):
        slots[(h >> 59) & 31].append((place, h >> 24))
    out = set()
    for slot, picks in slots.items():
        ordered = sorted(picks[:2])
        out.add(slot << 32 | spark_hash(",".join(str(h) for _, h in ordered)) & 0xFFFFFFFF)
    return out


def test_fingerprint_follows_its_definition(spark, rows):
    from functools import cache

    @cache
    def spark_hash(*values):
        columns = [F.lit(v).cast("long") if isinstance(v, int) and i == 0 else F.lit(v) for i, v in enumerate(values)]
        return spark.range(1).select(F.xxhash64(*columns)).first()[0]

    texts = ["a b c a b c a b d", "one", "", "x x x x", "the  cat\tsat\non the mat"]
    docs = rows("id long, text string", *enumerate(texts))
    got = {r.id: set(r.slots) for r in fingerprints.with_fingerprint(docs, "text", "slots").collect()}
    assert got == {i: plain_slots(spark_hash, t) for i, t in enumerate(texts)}


def test_next_document_and_edits(spark, rows):
    texts = {5: "a" * 9, 2000: "b c d e f g h i j", 3: "", 2001: "zz", None: "null id", 7: None}
    docs = rows("doc_id long, text string, slots int", *[(k, v, 1) for k, v in texts.items()])
    out = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    order = [2001, 2000, 7, 5, 3, None]
    for i, k in enumerate(order):
        text, nxt = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        m = len(text) // 3
        assert out[k].edited == text[:len(text) - m] + nxt[:m] and out[k].n_chars == len(text)
        assert 0 <= out[k].near_edited <= 1 and 0 <= out[k].near_next <= 1
    assert out[3].slots == [] and fingerprints.edited_likeness(docs.limit(0)).count() == 0
    twice = rows("doc_id long, text string", (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"))
    assert {(tuple(r.slots), r.near_next) for r in fingerprints.edited_likeness(twice).collect()} == {
        (tuple(fingerprints.edited_likeness(twice).first().slots), 1.0)}


def test_likeness_falls_with_edits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") > 600)
    got = fingerprints.edited_likeness(docs).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.2 and got[1] < 0.1


PAGES = "page_id long, url string, html string, size string"


def test_archives_read_back(spark, rows, tmp_path):
    big = "<p>é</p>" * 40
    data = [(9, "http://a/\r\nx: y", big, ""), (4, "http://b", big, ""), (None, "u", big, ""), (5, None, "tiny", ""), (6, "v", "tiny", ""),
            (7, "w", None, ""), (8, "w", "", ""), (4, "http://b", big, ""), (11, "z", big + "!", "")]
    data += [(5000 + 1000 * i, "far", f"{i}" * 900, "") for i in range(6)]
    folder = f"file://{tmp_path}/out"
    manifest = warc.write_archives(rows(PAGES, *data).repartition(3), folder, roll_bytes=700, group_bytes=3000)
    read = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()), key=repr)
    want = [(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 4) if h == big and p != 4 else ("response", None)))
            for p, _, h, _ in data]
    assert read == sorted(want, key=repr)
    files = sorted(x.name for x in (tmp_path / "out").glob("*.warc.gz"))
    assert files == sorted(r.file for r in manifest.collect()) and len(files) > 2 and not list((tmp_path / "out").glob(".*tmp"))
    again = f"file://{tmp_path}/again"
    other = warc.write_archives(rows(PAGES, *reversed(data)).repartition(2), again, roll_bytes=700, group_bytes=3000)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, manifest.collect()))
    first = tmp_path / "out" / files[0]
    first.write_bytes(first.read_bytes()[:-30] + b"x" * 30)
    with pytest.raises(Exception, match="damaged|zlib|Error"):
        warc.read_archives(spark, folder).collect()


def test_members_are_gzip_and_empty_table(spark, rows, tmp_path):
    member = warc._page_record(1, "u", "d", 0, None, False, b"")
    assert zlib.decompress(member, 31).startswith(b"WARC/1.1\r\nWARC-Type: response")
    folder = f"file://{tmp_path}/none"
    assert warc.write_archives(rows(PAGES).limit(0), folder).count() == 0 and warc.read_archives(spark, folder).count() == 0
