import hashlib

import pytest

from skillcube.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/\r\nx y", "é" * 100), (2, None, "é" * 100), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "z" * 1_000_003), (8, "u", "z" * 1_000_003), (8, "u", "é" * 100), (None, "u", "é" * 100), (None, "n", "q" * 300), (1, "http://a", "é" * 100)]


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_round_trip(spark, tmp_path, chunk):
    rows = ROWS if chunk > 64 else [r for r in ROWS if len(r[2] or "") < 1000]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES)
    warc.write_archive(pages, f"file://{tmp_path}/w", chunk_bytes=chunk)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()]
    assert sorted(got, key=str) == expected(rows)
    table = spark.read.parquet(f"file://{tmp_path}/w")
    assert max(len(r.data) for r in table.collect()) <= chunk + 2000


def test_archive_is_a_warc_file(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "http://a", "<p>" + "é" * 400, "x"), (2, "http://b", "<p>" + "é" * 400, "x")], PAGES), f"file://{tmp_path}/w", chunk_bytes=100)
    data = b"".join(warc.archive_bytes(spark.read.parquet(f"file://{tmp_path}/w")))
    records, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        records.append((head["WARC-Type"], data[end + 4 : end + 4 + n]))
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n
    assert records == [("response", ("<p>" + "é" * 400).encode()), ("revisit", b"")]


def test_damage_is_found():
    reader = warc.RecordReader()
    head = warc.header(1, "u", "response", 3, hashlib.sha256(b"abc").hexdigest(), None, "d")
    no, last, digest, data = next(warc.chunks(head, memoryview(b"abc")))
    assert reader.feed(no, last, digest, memoryview(data))["page_id"] == 1
    with pytest.raises(ValueError):
        warc.RecordReader().feed(no, last, digest, memoryview(data.replace(b"abc", b"abd")))
    with pytest.raises(ValueError):
        warc.RecordReader().feed(1, last, digest, memoryview(data))


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w")
    assert warc.read_archive(spark, f"file://{tmp_path}/w").count() == 0
