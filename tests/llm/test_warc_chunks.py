import hashlib

import pytest

from quillon.llm import warc_chunks
from tests.llm.frames import listed

SCHEMA = "page_id long, url string, html string, payload_digest string, chunk string"
BIG = "<p>é🙂x</p>" * 30_000


def pages(spark):
    rows = [(1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (3, "u", "y" * 100), (4, "u", "y" * 100), (5, None, None),
            (6, "bad url\r\nWARC-Type: x", ""), (9, "b", BIG), (7, "b", BIG), (8, "c", "\r\n\r\nWARC/1.1\r\n" * 20), (4, "u", "y" * 100),
            (3, "other", "z" * 150), (None, "n", "y" * 100), (None, None, None), (2 ** 60 + 1, "l", "q" * 200)]
    return spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)


def brute(rows):
    first = {}
    for r in rows:
        data = (r.html or "").encode()
        if len(data) >= 100 and r.page_id is not None:
            first[data] = min(first.get(data, r.page_id), r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        revisit = data in first and first[data] != r.page_id
        out.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    first[data] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [7, 64 * 1024])
def test_round_trip(spark, chars, monkeypatch):
    frame = pages(spark).repartition(3)
    monkeypatch.setattr(warc_chunks.chunk_rows, "__defaults__", (chars,))
    assert listed(warc_chunks.round_trip(frame)) == brute(frame.collect())


def test_chunk_table_rebuilds_payloads(spark, tmp_path):
    frame = pages(spark).where("page_id is not null").dropDuplicates(["page_id", "html"])
    files = warc_chunks.write_archives(frame, f"file://{tmp_path}/w")
    rows = warc_chunks.read_archives(files).collect()
    assert max(len(r.chunk) for r in rows) <= warc_chunks.CHUNK_BYTES
    joined, digests = {}, {}
    for r in sorted(rows, key=lambda r: r.chunk_no):
        joined[r.record_id] = joined.get(r.record_id, b"") + bytes(r.chunk)
        if r.record_type == "response":
            assert r.digest_so_far == hashlib.sha256(joined[r.record_id]).hexdigest()
        digests[r.record_id] = (r.record_type, r.payload_digest)
    for record, (kind, digest) in digests.items():
        if kind == "response":
            assert hashlib.sha256(joined[record]).hexdigest() == digest


def test_a_damaged_archive_raises(spark, tmp_path):
    files = warc_chunks.write_archives(pages(spark).where("page_id = 3").limit(1), f"file://{tmp_path}/w")
    path = files.first().path
    raw = open(path.removeprefix("file://"), "rb").read()
    import gzip
    plain = gzip.decompress(raw).replace(b"yyyy", b"yyyz", 1).replace(b"zzzz", b"zzzy", 1)
    open(path.removeprefix("file://"), "wb").write(gzip.compress(plain))
    with pytest.raises(ValueError, match="damaged"):
        list(warc_chunks.read_chunks(path))


def test_no_pages(spark):
    assert warc_chunks.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_are_standard(spark, tmp_path):
    import gzip
    files = warc_chunks.write_archives(pages(spark).where("page_id in (3, 4, 7, 9)"), f"file://{tmp_path}/w")
    plain = b"".join(gzip.decompress(open(r.path.removeprefix("file://"), "rb").read()) for r in files.collect())
    records = {}
    while plain:
        head, _, rest = plain.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        records[fields[b"WARC-Record-ID"]] = fields
        assert rest[:size].startswith(b"HTTP/1.1 200 OK\r\n") and fields[b"Content-Type"].startswith(b"application/http")
        assert rest[size:size + 4] == b"\r\n\r\n"
        if fields[b"WARC-Type"] == b"response":
            body = rest[:size].partition(b"\r\n\r\n")[2]
            assert b"sha256:" + hashlib.sha256(body).hexdigest().encode() == fields[b"WARC-Payload-Digest"]
        plain = rest[size + 4:]
    revisits = [f for f in records.values() if f[b"WARC-Type"] == b"revisit"]
    assert revisits and all(records[f[b"WARC-Refers-To"]][b"WARC-Type"] == b"response" for f in revisits)


def test_time_of_a_page_grows_with_its_size(spark):
    import time
    took = []
    for size in (8 << 20, 32 << 20):
        frame = spark.createDataFrame([(1,)], "page_id long").selectExpr("page_id", "'u' as url", f"repeat('a', {size}) as html")
        for _ in range(2):  # the first run compiles
            start = time.time()
            row = warc_chunks.round_trip(frame).first()
            spent = time.time() - start
        assert row.payload_bytes == size and row.payload_digest == hashlib.sha256(b"a" * size).hexdigest()
        took.append(spent)
    assert took[1] < 4 * took[0] + 2


def test_chunks_are_bytes_of_bounded_size(spark):
    rows = warc_chunks.chunk_rows(pages(spark), 1000).orderBy("page_id", "payload_digest", "url", "chunk_no").collect()
    assert max(len(r.chunk) for r in rows) == 1000
    big = [r for r in rows if r.page_id == 9]
    assert b"".join(bytes(r.chunk) for r in big) == BIG.encode() and [r.chunk_no for r in big] == list(range(len(big)))
