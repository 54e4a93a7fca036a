"""Pages as WARC archives: a deterministic sharded writer, and the reader.

1. Payload digests; of equal payloads of at least REVISIT_BYTES bytes the smallest page_id is the response, the others are
   revisits that refer to it. The digest of a hot payload is pre-aggregated, and the join with it can be split.
2. Every record becomes one gzip member with headers, block and payload digests made anew; dates and ids derive from the
   page, so the bytes depend on the pages alone.
3. Pages are dealt out by ranges of page_id that hold about GROUP_BYTES of payload, sorted by page_id, digest and url. Ranges
   come from sums per 1,000 ids, so they depend on the pages alone, not on partitions.
4. A task compresses the records of its range and rolls to a new file when the next record would pass ROLL_BYTES. It writes
   under a temporary name and renames a file when it is complete; a repeated task writes the same bytes. The manifest,
   written last through Spark's own commit, names the files with their sizes and digests; readers read nothing else.

Null html is an empty payload, a null url leaves its header out, line breaks in urls are percent-encoded. A null page_id is
never referred to unless all copies have none. Rows with equal page_id and payload have the same record type. The target
folder must be reachable by every executor (a file, hdfs, s3 or gs path).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.text import pieces
from strandline.plans import cut, running_sum

REVISIT_BYTES = 100
ROLL_BYTES = 16 << 20  # small, as a task reads whole files
GROUP_BYTES = 64 << 20
SLICE = 1000
SLICES = 200_000  # slices of 16 bytes that may be broadcast
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha256:{_sha(block)}"),
             ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _page_record(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, revisit: bool, payload: bytes) -> bytes:
    name = page_id if page_id is not None else "none"
    target = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    fields = [("WARC-Record-ID", f"<urn:x-page:{name}:{digest}>"), ("WARC-Target-URI", target), ("X-Page-ID", None if page_id is None else str(page_id)),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(n_bytes)), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", None if refers_to is None else str(refers_to)),
                   ("WARC-Refers-To", f"<urn:x-page:{'none' if refers_to is None else refers_to}:{digest}>")]
        return _record("revisit", fields, b"HTTP/1.1 200 OK\r\n\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return _record("response", fields, http + payload)


def marked_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, n_bytes, revisit, refers_to, payload (empty for revisits): one row for each row of `pages`."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    firsts, _ = cut(rows.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-payloads")
    known = rows.join(firsts.withColumn("shared", F.lit(True)), "digest", "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select("page_id", "url", "digest", "n_bytes", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"),
                        F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"))


def _slice() -> Column:
    return F.coalesce(F.floor(F.col("page_id") / SLICE), F.lit(-(1 << 62)))


def _groups(pages: DataFrame, group_bytes: int) -> tuple[DataFrame, int, int]:
    """slice, group_no: which slices of page_id share a task; the numbers of slices and of groups."""
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long") + 500
    sums, seen = cut(pages.groupBy(_slice().alias("slice")).agg(F.sum(size).alias("size")), "warc-slices")
    summed = running_sum(sums, [], F.floor(F.col("slice") / SLICE), [F.col("slice")], F.col("size"), "upto")
    groups = summed.select("slice", F.floor((F.col("upto") - F.col("size")) / group_bytes).alias("group_no"))
    total = sums.agg(F.sum("size").alias("n")).first()["n"] or 0
    return groups, seen["rows"], int(total // group_bytes) + 1


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Writes warc-GGGGGGGG-NNNNNN.warc.gz files and their manifest below `folder`; returns the manifest."""
    spark = pages.sparkSession
    groups, n_slices, n_groups = _groups(pages, group_bytes)
    placed = marked_pages(pages).withColumn("slice", _slice()).join(F.broadcast(groups) if n_slices <= SLICES else groups, "slice")
    dealt = placed.drop("slice").repartitionByRange(n_groups, "group_no").sortWithinPartitions("group_no", "page_id", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        file: _File | None = None
        for piece in pieces(batches, "payload"):
            for row in piece.to_pylist():
                member = _page_record(row["page_id"], row["url"], row["digest"], row["n_bytes"], row["refers_to"], row["revisit"],
                                      row["payload"].encode())
                group = row["group_no"]
                if file is None or file.group != group or file.n_bytes + len(member) > roll_bytes:
                    if file is not None:
                        yield file.commit()
                    file = _File(store, base, group, file.part + 1 if file is not None and file.group == group else 0)
                file.write(member)
        if file is not None:
            yield file.commit()

    manifest, _ = cut(dealt.mapInArrow(write, MANIFEST), "warc-files")
    manifest.orderBy("file").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifest")


class _File:
    """An archive that is being written under a temporary name."""

    def __init__(self, store: fs.FileSystem, base: str, group: int, part: int):
        self.store, self.base, self.group, self.part = store, base, group, part
        self.name = f"warc-{group:08d}-{part:06d}.warc.gz"
        self.temporary = f"{base}/.{self.name}-{uuid.uuid4().hex}.tmp"
        self.out = store.open_output_stream(self.temporary, compression=None)
        self.records, self.n_bytes, self.sha = -1, 0, hashlib.sha256()
        self.write(_record("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{group}:{part}>"), ("Content-Type", "application/warc-fields")],
                           b"format: WARC File Format 1.1\r\n"))

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.records += 1
        self.n_bytes += len(member)
        self.sha.update(member)

    def commit(self) -> pa.RecordBatch:
        self.out.close()
        if self.store.get_file_info(f"{self.base}/{self.name}").type != fs.FileType.NotFound:
            self.store.delete_file(f"{self.base}/{self.name}")
        self.store.move(self.temporary, f"{self.base}/{self.name}")
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.records], pa.int64()), pa.array([self.n_bytes], pa.int64()),
                                           pa.array([self.sha.hexdigest()])], ["file", "records", "bytes", "sha256"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in the files of the manifest.

    Digests of files, blocks and payloads are checked; a damaged archive raises.
    """
    listed = spark.read.schema(MANIFEST).json(f"{folder}/_manifest")
    n_files = max(1, listed.count())
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                rows = []
                for record in _members(store, f"{base}/{entry['file']}", entry["sha256"]):
                    row = _parsed(record)
                    if row:
                        rows.append(row)
                    if len(rows) == 1000:
                        yield _batch(rows, columns, types)
                        rows = []
                yield _batch(rows, columns, types)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # a number of partitions that is given is not merged, so files are read side by side
    return listed.repartitionByRange(n_files, "file").mapInArrow(read, schema)


def _batch(rows: list[tuple], columns: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], columns)


def _members(store: fs.FileSystem, path: str, sha256: str) -> Iterator[bytes]:
    whole, inflate, parts = hashlib.sha256(), zlib.decompressobj(31), []
    with store.open_input_stream(path, compression=None) as source:
        while data := source.read(1 << 20):
            whole.update(data)
            while data:
                parts.append(inflate.decompress(data))
                data = inflate.unused_data
                if inflate.eof:
                    yield b"".join(parts)
                    inflate, parts = zlib.decompressobj(31), []
    if whole.hexdigest() != sha256 or parts and any(parts):
        raise ValueError(f"{path} is damaged")


def _parsed(record: bytes) -> tuple | None:
    head, _, rest = record.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    if field["WARC-Type"] == "warcinfo":
        return None
    block = rest[:int(field["Content-Length"])]
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if rest[len(block):] != b"\r\n\r\n" or f"sha256:{_sha(block)}" != field["WARC-Block-Digest"]:
        raise ValueError(f"block of {field['WARC-Record-ID']} is damaged")
    size = int(field["X-Payload-Length"])
    if field["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or _sha(payload) != digest:
            raise ValueError(f"payload of {field['WARC-Record-ID']} is damaged")
    number = lambda key: int(field[key]) if key in field else None
    return number("X-Page-ID"), field.get("WARC-Target-URI"), size, digest, field["WARC-Type"], number("X-Refers-To-Page")
