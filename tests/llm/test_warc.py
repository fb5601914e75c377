import gzip
import hashlib
import random
import zlib

import pytest

from lodestar.llm import warc
from lodestar.llm._scratch import new_path

PAGES = "page_id long, url string, html string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_contract(spark):
    long, other = "<p>é</p>" * 30, "y" * 100
    rows = [(5, "http://a/5", long), (2, "http://a/2", long), (9, None, long), (1, "http://a\n/1", "short"), (3, "u", "short"), (4, "u", None), (None, "u", other), (7, "u", other), (8, "u", "x" * 300_000)]
    got = {(r.page_id, r.payload_digest): r for r in warc.write_and_read(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        r = got[page, sha(html or "")]
        assert r.payload_bytes == len((html or "").encode())
        again = html is not None and ((html == long and page != 2) or (html == other and page != 7))
        assert (r.record_type, r.refers_to) == (("revisit", 2 if html == long else 7) if again else ("response", None))


def test_repeated_rows_and_ids(spark):
    body, more = "a" * 150, "b" * 150
    rows = [(1, "u", body), (1, "u", body), (1, "v", more), (2, "u", more), (3, "u", "c" * 150), (3, "u", body)]
    got = sorted((r.page_id, r.payload_digest == sha(body), r.record_type, str(r.refers_to)) for r in warc.write_and_read(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(1, False, "response", "None"), (1, True, "response", "None"), (1, True, "revisit", "1"), (2, False, "revisit", "1"), (3, False, "response", "None"), (3, True, "revisit", "1")]


def test_empty(spark):
    assert warc.write_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_ordinary_gzip(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(i, f"http://x/{i}", "é" * i) for i in range(50)], PAGES).coalesce(1), path)
    (data,) = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 50
    found = warc.read(spark, path).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in found) == [(i, "é" * i) for i in range(50)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(40))
def test_salvage(packed, seed):
    rng = random.Random(seed)
    payloads = [f"<p>{i}</p>".encode() * rng.randint(0, 400) for i in range(40)]
    records = [warc.record("response", i, f"http://x/{i}", hashlib.sha256(p).hexdigest(), None, p) for i, p in enumerate(payloads)]
    parts = [warc.member(r) + warc.EMPTY_MEMBER if packed else r for r in records]
    data = bytearray(b"".join(parts))
    at, n = rng.randrange(len(data)), rng.randint(1, 400)
    data[at : at + n] = rng.randbytes(n) if seed % 2 else b""
    begins = [sum(map(len, parts[:i])) for i in range(41)]
    whole = {i for i in range(40) if begins[i + 1] <= at or begins[i] >= at + n}
    found = warc.read_archive(bytes(data))
    got = {h["warc-record-id"]: p for _, h, p in found.records if h.get("warc-record-id")}
    assert all(got.get(f"<urn:page:{i}>") == payloads[i] for i in whole)
    if packed and len(got) < 40:
        assert found.gaps and all(a < b and why for a, b, why in found.gaps)


def test_gaps_are_logged(spark, tmp_path):
    record = [warc.record("response", i, "u", hashlib.sha256(b"x" * 500).hexdigest(), None, b"x" * 500) for i in range(3)]
    damaged = record[1].replace(b"Content-Length: 500", b"Content-Length: 490")
    (tmp_path / "a.warc").write_bytes(record[0] + damaged + record[2])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows if r.reason is None) == [0, 2]
    (gap,) = [r for r in rows if r.reason]
    assert (gap.start, gap.end) == (len(record[0]), len(record[0]) + len(damaged)) and "content length" in gap.reason


def several(n=6, size=300):
    payloads = [random.Random(i).randbytes(size) for i in range(n)]
    return payloads, [warc.record("response", i, f"http://x/{i}", hashlib.sha256(p).hexdigest(), None, p) for i, p in enumerate(payloads)]


def ids(found):
    return [h["warc-record-id"] for _, h, _ in found.records]


def urns(*pages):
    return [f"<urn:page:{i}>" for i in pages]


@pytest.mark.parametrize("old, new", [(b"Content-Length: 300", b"Content-Length: 290"), (b"sha256:", b"sha256:0"), (b"WARC/1.1", b"WORC/1.1")])
def test_salvage_inside_a_member(old, new):
    payloads, records = several()
    damaged = [*records[:2], records[2].replace(old, new), *records[3:]]
    data = warc.member(records[0]) + warc.member(b"".join(damaged)) + warc.member(records[5])
    found = warc.read_archive(data)
    assert ids(found) == urns(0, 0, 1, 3, 4, 5, 5)
    assert [p for _, _, p in found.records][1:6] == [payloads[i] for i in (0, 1, 3, 4, 5)]
    ((start, end, reason),) = found.gaps
    begin, size = len(records[0]) * 2, len(damaged[2])
    assert (start, end) == (len(warc.member(records[0])), len(data) - len(warc.member(records[5]))) and f"bytes {begin} to {begin + size} of" in reason


def test_records_before_a_broken_stream_are_kept():
    _, records = several()
    packed = warc.member(b"".join(records))
    after = warc.member(records[0])
    for cut in (len(packed) // 2, len(packed) - 4):  # truncated
        for tail in (b"", after):
            found = warc.read_archive(packed[:cut] + tail)
            assert ids(found)[:2] == urns(0, 1) and (not tail or ids(found)[-1:] == urns(0)) and found.gaps
    assert ids(warc.read_archive(packed[:-4])) == urns(*range(6))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    begin = packer.compress(b"".join(records[:3])) + packer.flush(zlib.Z_FULL_FLUSH)
    found = warc.read_archive(begin + b"\xff" * 40 + after)  # no such block type
    assert ids(found) == urns(0, 1, 2, 0) and found.gaps == [(0, len(begin) + 40, found.gaps[0][2])] and "gzip" in found.gaps[0][2]


def test_member_with_a_wrong_checksum():
    _, records = several()
    for stored in (0, 6):
        packer = zlib.compressobj(stored, zlib.DEFLATED, 31)
        data = bytearray(packer.compress(b"".join(records)) + packer.flush())
        data[-8] ^= 1
        found = warc.read_archive(bytes(data) + warc.member(records[1]))
        assert ids(found) == urns(*range(6), 1) and len(found.gaps) == 1 and "data check" in found.gaps[0][2]
    data = bytearray(warc.member(records[0]))
    data[-8] ^= 1
    found = warc.read_archive(bytes(data))
    assert not found.records and "data check" in found.gaps[0][2]


def test_headers_of_any_length(spark):
    rows = [(1, "http://x/" + "é" * (3 << 20), "a" * 200), (2, "http://y/" + "u" * (5 << 20), "a" * 200), (3, "u", "b")]
    got = sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.write_and_read(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(1, 200, "response"), (2, 200, "revisit"), (3, 1, "response")]
    records = [warc.record("response", i, url, sha(body), None, body.encode()) for i, url, body in rows]
    for data in (b"".join(records), warc.member(b"".join(records))):
        found = warc.read_archive(data)
        assert ids(found) == urns(1, 2, 3) and not found.gaps and found.records[0][1]["warc-target-uri"] == rows[0][1]


def test_header_without_end_stops_at_the_next_version_line():
    _, records = several()
    damaged = records[0][: records[0].index(b"WARC-Payload")] + b"x" * (2 << 20) + b"\r\n"
    found = warc.read_archive(damaged + records[1])
    assert ids(found) == urns(1) and found.gaps == [(0, len(damaged), "header without end")]


def test_files_are_bounded_by_bytes(spark):
    rng = random.Random(5)
    rows = [(i, "http://x/" + "u" * (2 << 20 if i == 7 else 9), rng.randbytes(20_000).hex()) for i in range(60)]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path, file_bytes=200_000)
    files = spark.read.format("binaryFile").load(path).select("length", "content").collect()
    one = max(len(warc.member(r[2].encode())) for r in rows) + 20_000
    assert len(files) > 5 and all(f.length <= 200_000 + one for f in files)
    assert sum(gzip.decompress(bytes(f.content)).count(b"WARC/1.1\r\n") for f in files) == 60
    found = warc.read(spark, path).collect()
    assert {r.page_id: (len(r.url), bytes(r.payload).decode()) for r in found} == {i: (len(u), h) for i, u, h in rows}


def test_columns_beyond_the_three_and_hot_payloads(spark):
    rows = [(i, "u", "z" * 120 if i % 3 else f"own {i} " * 30, "clash", 1) for i in range(300)]
    got = warc.write_and_read(spark.createDataFrame(rows, PAGES + ", digest string, refers_to int")).collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == [(i, 1 if i % 3 and i != 1 else None) for i in range(300)]
