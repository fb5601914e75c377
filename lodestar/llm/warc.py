"""WARC archives: a writer of one gzip member per record, and a reader that salvages damaged archives.

Writing: payload digests are grouped first; of equal payloads of at least ``LEAST`` bytes the one with the
smallest id is a response record and the others are revisits without a block.  Records are compressed one by
one and written by Spark's own text writer (to whatever store the path names): a row is a run of members and a file,
closed at ``FILE_BYTES``, so that a file holds that much and one record more at most.  The writer gives a row's bytes
out as they are, though they are no text, and ends it with an empty gzip member (its line separator), which every reader
of concatenated members skips; a test reads the files with an ordinary gzip reader.

Reading: archives come as whole binary files, each held in a task (a foreign one may have up to the 2 GB that a row may
have), and records are handed on as they are found, so that payloads of one member at a time are held.  Every member or plain record is checked (gzip checksum, version line, content length, record end, payload
digest).  After a failed check the reader searches for the next member or version line that passes, goes on
from there, and logs the bytes between as quarantined.  Within a member the search runs over its content, and the
gap names the member's place in the file and the content's bytes.  Of a member that breaks off or fails its checksum
the records that were decompressed and pass their own checks are kept, and the member is logged; if its only record
passes, that record is quarantined, as the damage can only be there.

Defined cases: a null payload is empty; rows without id are written and read with an empty id; repeated rows
give repeated records (the first of equal ids is the response); urls and payloads of any length are written and read;
line breaks in a url become spaces; an empty table gives an archive without records; further columns are not written.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import join_hot, join_keys, new_path, written

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Compressed bytes from which on a file is closed, so that a file can be read as one row.
FILE_BYTES = 32 << 20
#: A gzip member without content: header, an empty final block, checksum and size of nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00000000" + "00000000")
VERSION = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
#: How zlib's messages end when a member's checksum or size differs.
_CHECKS = ("incorrect data check", "incorrect length check")
_DATE = "2000-01-01T00:00:00Z"  # records carry a fixed date, so that equal input gives equal archives


def record(kind: str, page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    """A record's bytes, header and block and end."""
    page = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + _END + payload + _END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, place, refers_to): rows whose payload an earlier row of the same payload already has.

    ``place`` numbers the rows of an id whose payloads are equal; 1 unless rows are repeated.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).alias("size"))
    rows = written(rows.filter(f"size >= {least}").groupBy("digest", "page_id").agg(F.count("*").alias("n")), "payloads")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.sum("n").alias("total")).filter("total > 1 AND refers_to IS NOT NULL")
    return join_hot(rows, written(first, "first"), ["digest"], "total").filter("NOT (page_id <=> refers_to) OR n > 1").select("page_id", "digest", "refers_to")


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """One record per row of pages (page_id, url, html)."""
    again = written(revisits(pages), "revisits").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    body = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", "url", body.alias("html"))
    twice = not pages.groupBy("page_id").count().filter("count > 1").isEmpty()
    if twice:  # then the digest must match too, and only the first of equal rows is a response
        keyed = named.withColumn("_hash", F.unhex(F.sha2("html", 256)))
        joined = join_keys(keyed, again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_hash") == F.col("_digest")), "left")
        order = Window.partitionBy("page_id", "_hash").orderBy("url")
        joined = joined.withColumn("_place", F.row_number().over(order)).withColumn("refers_to", F.when((F.col("_place") > 1) | ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))
    else:
        joined = join_keys(named, again, F.col("page_id").eqNullSafe(F.col("_page")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        file = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200).to_pydict()
                for page, url, html, target in zip(rows["page_id"], rows["url"], rows["html"], rows["refers_to"], strict=True):
                    payload = html.encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    out.append(member(record("response" if target is None else "revisit", page, url, digest, target, payload if target is None else b"")))
                    size += len(out[-1])
                    if size >= file_bytes:
                        yield file(out)
                        out, size = [], 0
        if out:
            yield file(out)

    members = joined.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary")
    writer = members.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    writer.option("lineSep", EMPTY_MEMBER.decode("latin1")).option("encoding", "ISO-8859-1").text(path)


@dataclass
class Found:
    """What a reader got from an archive: records (offset, header, payload) and gaps (start, end, reason)."""

    records: list[tuple[int, dict[str, str], bytes]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: header, payload, end.  ValueError says which check failed."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    if data.find(b"\r\n", at, at + 64) < 0:
        raise ValueError("no version line")
    stop = data.find(_END, at, at + (1 << 16))
    if stop < 0:  # a long header: it goes on to the next version line at most
        after = data.find(b"\r\n" + VERSION, at)
        stop = data.find(_END, at, after if after >= 0 else len(data))
    if stop < 0:
        raise ValueError("header without end")
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
    header = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not header.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin = stop + 4
    end = begin + int(header["content-length"])
    if data[end : end + 4] != _END:
        raise ValueError("no record end where the content length says")
    payload = data[begin:end]
    said = header.get("warc-payload-digest", "")
    if header.get("warc-type") == "response" and said.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != said[7:]:
        raise ValueError("payload digest differs")
    return header, payload, end + 4


def _inflated(opener: zlib._Decompress, piece: bytes) -> tuple[bytes, str]:
    """What ``piece`` decompresses to, up to the first error, and the error."""
    out, size = [], len(piece)
    while piece:
        before = opener.copy()
        try:
            out.append(opener.decompress(piece[:size]))
            piece = piece[size:]
        except zlib.error as problem:
            opener = before
            if size > 1:  # the error lies within the next ``size`` bytes
                size //= 2
                continue
            rest = piece[:1]
            try:
                while got := opener.decompress(rest, 1):
                    out.append(got)
                    rest = opener.unconsumed_tail
            except zlib.error:
                pass
            return b"".join(out), f"gzip member: {problem}"
    return b"".join(out), ""


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, its end, and why it ends early, if it does."""
    opener, parts, to, why = zlib.decompressobj(31), [], at, ""
    while not why and not opener.eof and to < len(data):
        piece = data[to : to + (1 << 16)]
        before = opener.copy()
        try:
            parts.append(opener.decompress(piece))
        except zlib.error:
            part, why = _inflated(before, bytes(piece))
            parts.append(part)
        to += len(piece)
    if not why and not opener.eof:
        why = "gzip member: truncated"
    return b"".join(parts), to - len(opener.unused_data), why


def _records(content: bytes) -> Found:
    """The records of a member's content whose checks pass, and the gaps between them."""
    found, at, bad, why = Found(), 0, None, ""
    while at < len(content):
        try:
            header, payload, end = _plain(content, at)
        except ValueError as problem:
            if bad is None:
                bad, why = at, str(problem)
            at = content.find(VERSION, at + 1)
            if at < 0:
                break
            continue
        if bad is not None:
            found.gaps.append((bad, at, why))
            bad = None
        found.records.append((at, header, payload))
        at = end
    if bad is not None:
        found.gaps.append((bad, len(content), why))
    return found


def scan(data: bytes) -> Iterator[Found]:
    """An archive's records whose checks pass and the gaps between them, member by member."""
    at, bad, why = 0, None, ""
    view = memoryview(data)
    broken, upto = b"", 0  # the content of the last member that gave records and ends early, and how far it was read
    while at < len(data):
        if bad is None and data.startswith(EMPTY_MEMBER, at):
            at += len(EMPTY_MEMBER)
            continue
        inside, problem = Found(), ""
        if data.startswith(_MEMBER, at):
            content, end, problem = _member(view, at)
            inside = _records(content)
            if problem.endswith(_CHECKS) and len(inside.records) == 1 and not inside.gaps:
                inside = Found()  # the damage can only be in this record
            if not problem and not inside.records and inside.gaps:
                problem = inside.gaps[0][2]
        else:
            try:
                header, payload, end = _plain(data, at)
                inside.records.append((0, header, payload))
            except ValueError as failure:
                problem = str(failure)
        if at < upto and not problem and data[at:end] in broken:  # stored, and read with that member
            at = end
            continue
        out = Found([(at, header, payload) for _, header, payload in inside.records])
        if bad is not None and (inside.records or not problem):
            out.gaps.append((bad, at, why))
            bad = None
        if not problem:
            out.gaps += [(at, end, f"bytes {a} to {b} of the member: {reason}") for a, b, reason in inside.gaps]
            yield out
            at = end
            continue
        yield out
        if bad is None:
            bad, why = at, problem
        if inside.records:
            broken, upto = content, end
        at = min((p for p in (data.find(_MEMBER, at + 1), data.find(VERSION, at + 1)) if p >= 0), default=len(data))
    if bad is not None:
        yield Found(gaps=[(bad, len(data), why)])


def read_archive(data: bytes) -> Found:
    """All of an archive at once."""
    out = Found()
    for found in scan(data):
        out.records += found.records
        out.gaps += found.gaps
    return out


_SCHEMA = "path string, start long, end long, reason string, kind string, page_id long, url string, digest string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``reason`` is set) of all archives below ``path``."""

    def number(text: str) -> int | None:
        got = re.fullmatch(r"<urn:page:(-?\d+)>", text)
        return int(got[1]) if got else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                where, rows, size = batch.column(0)[i].as_py(), [], 0
                for found in scan(batch.column(1)[i].as_py()):
                    rows += [(where, a, b, reason, None, None, None, None, None, None) for a, b, reason in found.gaps]
                    for at, header, payload in found.records:
                        digest = hashlib.sha256(payload).hexdigest() if header.get("warc-type") == "response" else header.get("warc-payload-digest", "").removeprefix("sha256:")
                        rows.append((where, at, len(payload), None, header.get("warc-type"), number(header.get("warc-record-id", "")), header.get("warc-target-uri"), digest, number(header.get("warc-refers-to", "")), payload if payloads else None))
                        size += len(payload) if payloads else 0
                        if len(rows) >= 500 or size >= 1 << 24:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Per page what its archives say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has no block: its payload's size is that of the response it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    found = written(read(spark, path, payloads=False).filter("reason IS NULL").select("kind", "page_id", "digest", "refers_to", F.col("end").alias("size")), "records")
    plain = found.filter("kind = 'response'").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    full = plain.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes").dropDuplicates(["refers_to", "digest"])
    again = found.filter("kind = 'revisit'").select("page_id", "kind", "refers_to", "digest")
    full = written(again.groupBy("refers_to", "digest").count().join(full, ["refers_to", "digest"]), "full")
    again = join_hot(again, full, ["refers_to", "digest"], "count", "left")
    return plain.unionByName(again.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"))
