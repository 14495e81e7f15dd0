"""WARC archives as a chunked record table.

Every record is rows (record_id, chunk_no) of at most CHUNK_BYTES archive bytes: chunk 0 begins with the record's header block, the
last chunk ends with the blank lines that close a record, so the data of a record's chunks in order is a WARC/1.1 record and
any sequence of whole records is a WARC file. Each row carries the SHA-256 of the payload up to its end, computed
incrementally while the payload is sliced; no record is ever copied as a whole.

Reading back, a record of one chunk is parsed and verified where it stands. Records of several chunks are dealt by record_id, sorted by
chunk number and verified chunk by chunk with one running digest.

Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the smallest page_id are responses and the others
revisits that refer to it; shorter payloads are all responses. Nulls: a null html is an empty payload; a null page_id never is
smallest (a group of null ids alone is all responses); a null url is written as an empty target. Each row makes its own record, even if
rows repeat. An empty table makes an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import new_path, read_table, remove_at_exit, staged

CHUNK_BYTES = 1 << 18
REVISIT_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1f6e0c-7d53-4c7e-9c8e-2b7f4f0f5a11")
_TABLE = "record_id string, chunk_no int, last boolean, digest string, data binary"


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to: the decision for every row.

    Digests that occur twice or more, with their smallest page_id, are written first: the join then knows that table's size and broadcasts
    it only below Spark's threshold; beyond it, a digest that a third of all rows hold is a skewed side that Spark can split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    long = F.length("payload") >= REVISIT_BYTES
    keys = rows.where(long).select("payload_digest", "page_id")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("payload_digest").alias("d"), "first")
    first, _ = staged(first, "repeated-payloads")
    joined = rows.join(first, (F.col("payload_digest") == F.col("d")) & long, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _urn(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}{salt}')}>"


def header(page_id: int | None, url: str, kind: str, n_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """The header block of a record, its closing blank line included."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    revisit = kind == "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Bytes: {n_bytes}", f"WARC-Page-ID: {'' if page_id is None else page_id}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {0 if revisit else n_bytes}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def chunks(head: bytes, payload: memoryview, size: int = CHUNK_BYTES) -> Iterator[tuple[int, bool, str, bytes]]:
    """(chunk_no, last, digest of the payload so far, archive bytes) of one record."""
    digest, at, no = hashlib.sha256(), 0, 0
    while True:
        part = payload[at : at + size]
        digest.update(part)
        at += len(part)
        last = at >= len(payload)
        yield no, last, digest.hexdigest(), b"".join((head if no == 0 else b"", part, b"\r\n\r\n" if last else b""))
        if last:
            return
        no += 1


def _write(date: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        bytes_held = 0

        def out():
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.binary()), strict=True)], ["record_id", "chunk_no", "last", "digest", "data"])

        for b in batches:
            col = {k: b.column(k) for k in b.schema.names}
            for i in range(b.num_rows):
                page, url, n, digest, kind, refers = (col[k][i].as_py() for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"))
                raw = col["payload"][i].as_buffer()
                head = header(page, url, kind, n, digest, refers, date)
                for no, last, so_far, data in chunks(head, memoryview(raw) if raw is not None else memoryview(b""), size):
                    held.append((f"{part:06d}-{row:09d}", no, last, so_far, data))
                    bytes_held += len(data)
                    if bytes_held >= 8 * size or len(held) >= 2000:
                        yield out()
                        held.clear()
                        bytes_held = 0
                row += 1
        if held:
            yield out()

    return run


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record for every row of pages (page_id, url, html) to the chunk table at path."""
    record_types(pages).mapInArrow(_write(date, chunk_bytes), _TABLE).write.option("compression", "zstd").parquet(path)


class RecordReader:
    """Verifies one record as its chunks arrive; holds a header and a running digest, never a payload."""

    def __init__(self) -> None:
        self.fields: dict[str, str] = {}
        self.digest, self.seen, self.next = hashlib.sha256(), 0, 0

    def feed(self, no: int, last: bool, digest: str, data: memoryview) -> dict | None:
        """The record's fields once its last chunk has passed."""
        if no != self.next:
            raise ValueError(f"chunk {no} where {self.next} was due")
        self.next += 1
        if no == 0:
            text = bytes(data[: 1 << 16])
            end = text.find(b"\r\n\r\n")
            if end < 0:  # a very long header
                text = bytes(data)
                end = text.index(b"\r\n\r\n")
            lines = text[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("no WARC record")
            self.fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            data = data[end + 4 :]
        if last:
            if bytes(data[-4:]) != b"\r\n\r\n":
                raise ValueError("a record's end is missing")
            data = data[:-4]
        self.digest.update(data)
        self.seen += len(data)
        if self.digest.hexdigest() != digest:
            raise ValueError("a chunk's digest differs")
        if not last:
            return None
        f = self.fields
        stated = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if self.seen != int(f["Content-Length"]) or f["WARC-Type"] == "response" and digest != stated:
            raise ValueError("a record's length or digest differs")
        number = lambda k: int(f[k]) if f.get(k) else None
        return {"page_id": number("WARC-Page-ID"), "payload_bytes": int(f["WARC-Payload-Bytes"]), "payload_digest": stated, "record_type": f["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "url": f["WARC-Target-URI"]}


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, at = RecordReader(), None
    for b in batches:
        done = []
        for i in range(b.num_rows):
            record = b.column("record_id")[i].as_py()
            if record != at:
                if reader.next:
                    raise ValueError(f"record {at} is not complete")
                reader, at = RecordReader(), record
            got = reader.feed(b.column("chunk_no")[i].as_py(), b.column("last")[i].as_py(), b.column("digest")[i].as_py(), memoryview(b.column("data")[i].as_buffer()))
            if got:
                done.append(got)
                reader = RecordReader()
        if done:
            yield pa.RecordBatch.from_pylist(done, _RECORD)
    if reader.next:
        raise ValueError(f"record {at} is not complete")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record, all digests verified."""
    rows = spark.read.schema(_TABLE).parquet(path)
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    single = (F.col("chunk_no") == 0) & F.col("last")
    many = rows.where(~single).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return rows.where(single).mapInArrow(_parsed, fields).unionByName(many.mapInArrow(_parsed, fields))


def archive_bytes(rows: DataFrame) -> Iterator[bytes]:
    """The archive as bytes, chunk by chunk, to export to a .warc file (of a bounded selection: the order is global)."""
    for r in rows.orderBy("record_id", "chunk_no").select("data").toLocalIterator():
        yield bytes(r.data)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    remove_at_exit(spark, path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
