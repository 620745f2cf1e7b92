"""Legacy archive converter: ARC files (versions 1 and 2) to WARC files, and a WARC reader.

Archives are written by Spark's text writer, one record per row, with the format's own record separator as line
separator, and read whole by its binary file reader, so any file system Spark knows will do. One input partition
gives one archive: no page is shuffled when archives are made.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_value
from fleetlens.session import scratch_path

by_value(__name__)

#: The field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20000101000000"  # of pages that carry none
REVISIT_FROM = 100  # payloads below are always stored
BATCH_BYTES = 4 << 20
RECORDS = "page_id long, record_id string, digest string, n_bytes long, type string"


def http_block(page_id: int | None, html: str | None) -> bytes:
    body = (html or "").encode()
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body


def arc_header(version: int, url: str, mime: str, date: str, length: int) -> bytes:
    if version == 1:
        return f"{url} 0.0.0.0 {date} {mime} {length}\n".encode()
    return f"{url} 0.0.0.0 {date} {mime} 200 - - 0 - {length}\n".encode()


def flushed(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def pages_to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html -> records of one ARC file; every other file is version 2."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    version = 1 + part % 2

    def records():
        first = f"{version} 0 fleetlens\n{ARC_FIELDS[version]}\n".encode()
        started = False
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if not started:
                    started = True
                    yield (arc_header(version, f"filedesc://part-{part:06d}.arc", "text/plain", DATE, len(first)) + first,)
                block = http_block(page_id, html)
                target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"
                yield (arc_header(version, target, "text/html", DATE, len(block)) + block,)

    return flushed(records(), ["record"], [pa.binary()], lambda r: len(r[0]))


def unpacked(raw: bytes) -> bytes:
    """The bytes of a file, gzip members (one, or one per record) undone."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        out.append(member.flush())
        raw = member.unused_data
    return b"".join(out)


def header_of(line: str, fields: list[str]) -> dict | None:
    """The fields of an ARC header line; None if it is not one."""
    values = line.rsplit(" ", len(fields) - 1)  # a URL may hold spaces
    if len(values) != len(fields) or not values[-1].isdigit():
        return None
    row = dict(zip((f.lower() for f in fields), values))
    date = row.get("archive-date", "")
    return row if values[0] and date.isdigit() and 8 <= len(date) <= 14 else None


def arc_records(data: bytes, rejects: list[tuple[int, str]] | None = None) -> Iterator[dict]:
    """The records after the version block. The block's field line says which fields header lines have; the
    declared length says where content ends.

    Where a header line should be and none is, reading goes on at the next line that is one; a record whose declared length
    passes the end of the file is left out. Both, and a file without a version block, are noted in ``rejects`` as (offset, reason).
    """
    at, fields, name = 0, None, ""
    note = (lambda *r: None) if rejects is None else (lambda *r: rejects.append(r))
    lost = False  # between a bad line and the next header
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        end = data.find(b"\n", at)
        if end < 0:
            if at < len(data) and not lost:
                note(at, "no header" if fields else "no version block")
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if fields is None:
            parts = line.split(" ")
            if not line.startswith("filedesc://") or not parts[-1].isdigit():
                note(at, "no version block")
                return
            block = data[end + 1:end + 1 + int(parts[-1])].decode("utf-8", "replace").split("\n")
            fields = block[1].strip().split(" ") if len(block) > 1 and block[1].strip() else ARC_FIELDS[int(block[0][:1] or 1)].split(" ")
            name, at = parts[0].removeprefix("filedesc://"), end + 1 + int(parts[-1])
            continue
        row = header_of(line, fields)
        if row is None:
            if not lost:
                note(at, "no header")
            at, lost = end + 1, True
            continue
        lost, length = False, int(line.rsplit(" ", 1)[1])
        if end + 1 + length > len(data):
            note(at, "cut short")
            at, lost = end + 1, True
            continue
        row |= {"content": data[end + 1:end + 1 + length], "archive": name, "offset": at}
        at = end + 1 + length
        yield row


def warc_fields(row: dict) -> dict:
    """What a WARC record says of an ARC record: identifier, time, type, payload and digest."""
    date = row.get("archive-date", "")
    date = date.ljust(14, "0") if date.isdigit() and len(date) >= 8 else DATE
    content = row["content"]
    head = content.find(b"\r\n\r\n") + 4 if content.startswith(b"HTTP/") and b"\r\n\r\n" in content else 0
    own = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", content[:head])
    payload = content[head:]
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row['archive']}#{row['offset']}')}>",
        "date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        "type": "response" if head else "resource", "uri": row["url"], "mime": row.get("content-type", "-"), "ip": row.get("ip-address", "-"),
        "http": content[:head], "payload": payload, "digest": hashlib.sha256(payload).hexdigest(),
        "page_id": int(own[1]) if own else None,
    }


def list_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content of ARC files -> one narrow row per record."""
    def rows():
        for batch in batches:
            for path, raw in zip(*(c for c in batch.columns)):
                for i, row in enumerate(arc_records(unpacked(raw.as_py()))):
                    f = warc_fields(row)
                    yield path.as_py(), i, f["page_id"], f["record_id"], f["digest"], len(f["payload"])

    return flushed(rows(), ["path", "ordinal", "page_id", "record_id", "digest", "n_bytes"],
                   [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], lambda r: 256)


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def arc_to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content, revisits (ordinal, record_id, page_id) -> records of WARC files, a warcinfo first."""
    def records():
        for batch in batches:
            for path, raw, revisits in zip(*(c for c in batch.columns)):
                refers = {r["ordinal"]: r for r in revisits.as_py() or []}
                for i, row in enumerate(arc_records(unpacked(raw.as_py()))):
                    f = warc_fields(row)
                    if i == 0:
                        info = f"software: fleetlens\r\nformat: WARC File Format 1.1\r\nconverted-from: {row['archive']}\r\n".encode()
                        yield (warc_record("warcinfo", [
                            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['archive'])}>"), ("WARC-Date", f["date"]),
                            ("WARC-Filename", row["archive"]), ("Content-Type", "application/warc-fields"),
                        ], info),)
                    headers = [
                        ("WARC-Record-ID", f["record_id"]), ("WARC-Date", f["date"]), ("WARC-Target-URI", f["uri"]),
                        ("WARC-IP-Address", f["ip"]), ("WARC-Payload-Digest", f"sha256:{f['digest']}"),
                        ("Content-Type", "application/http; msgtype=response" if f["http"] else f["mime"]),
                    ]
                    if i in refers:
                        headers += [
                            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                            ("WARC-Refers-To", refers[i]["record_id"]), ("X-Refers-To-Page-Id", str(refers[i]["page_id"])),
                            ("X-Payload-Length", str(len(f["payload"]))),
                        ]
                        yield (warc_record("revisit", headers, f["http"]),)
                    else:
                        yield (warc_record(f["type"], headers, f["http"] + f["payload"]),)

    return flushed(records(), ["record"], [pa.binary()], lambda r: len(r[0]))


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record, by the declared lengths."""
    at = 0
    while data[at:at + 5] == b"WARC/":
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        length = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + length]
        at = end + 4 + length + 4


def list_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content of WARC files -> one row per page record; digests and lengths of responses are taken from the payload
    that was read."""
    def rows():
        for batch in batches:
            for raw in batch.column(0):
                for headers, block in warc_records(unpacked(raw.as_py())):
                    if (kind := headers["WARC-Type"]) == "warcinfo":
                        continue
                    head = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                    own = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", block[:head])
                    refers = headers.get("X-Refers-To-Page-Id", "None")
                    if kind == "revisit":
                        size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    else:
                        size, digest = len(block) - head, hashlib.sha256(memoryview(block)[head:]).hexdigest()
                    yield (int(own[1]) if own else None), size, digest, kind, (None if refers == "None" else int(refers))

    return flushed(rows(), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                   [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], lambda r: 256)


def write_archive(records: DataFrame, path: str, separator: str) -> None:
    records.select(F.col("record").cast("string")).write.option("lineSep", separator).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED"
    ).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """``pages`` (page_id, url, html) as ARC files, one per partition. Null url: ``unknown:``; null html: empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    write_archive(rows.mapInArrow(pages_to_arc, "record binary"), path, "\n")


def convert_arc(spark, arc: str, warc: str, revisit_from: int = REVISIT_FROM) -> None:
    """Write the records of the ARC files below ``arc`` as WARC files below ``warc``.

    Of records with equal payloads of at least ``revisit_from`` bytes, the one with the smallest page id (null last, then
    the smallest record id) is stored, and the others refer to it. Archives are parsed twice, first for digests
    only, so that decisions join archives by path and no payload is shuffled unpacked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc)
    listed = files.select("path", "content").mapInArrow(
        list_arc, "path string, ordinal long, page_id long, record_id string, digest string, n_bytes long"
    )
    narrow = f"{warc.rstrip('/')}-records"
    listed.write.parquet(narrow)
    rows = spark.read.schema(listed.schema).parquet(narrow).where(F.col("n_bytes") >= revisit_from)
    first = f"{warc.rstrip('/')}-first"
    groups = rows.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("z"), "page_id", "record_id")).alias("best")
    ).where("n > 1").select(F.col("digest").alias("d"), F.col("best.record_id").alias("to_record"), F.col("best.page_id").alias("to_page"))
    groups.write.parquet(first)
    found = rows.join(spark.read.schema(groups.schema).parquet(first), F.col("digest") == F.col("d")).where("record_id <> to_record")
    revisits = found.groupBy(F.col("path").alias("at")).agg(F.collect_list(F.struct(
        "ordinal", F.col("to_record").alias("record_id"), F.col("to_page").alias("page_id")
    )).alias("revisits"))
    joined = files.select("path", "content").join(revisits, F.col("path") == F.col("at"), "left").select("path", "content", "revisits")
    write_archive(joined.mapInArrow(arc_to_warc, "record binary"), warc, "\r\n\r\n")


def arc_rejects(spark, arc: str) -> DataFrame:
    """(path, offset, reason): what the ARC files below ``arc`` hold that is no whole record; see :func:`arc_records`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, raw in zip(*batch.columns):
                    found: list[tuple[int, str]] = []
                    for _ in arc_records(unpacked(raw.as_py()), found):
                        pass
                    yield from ((path.as_py(), *r) for r in found)

        return flushed(rows(), ["path", "offset", "reason"], [pa.string(), pa.int64(), pa.string()], lambda r: 256)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc)
    return files.select("path", "content").mapInArrow(run, "path string, offset long, reason string")


def read_warc(spark, warc: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(warc)
    return files.select("content").mapInArrow(
        list_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) through ARC and WARC files and back: one row per page with page_id,
    payload_bytes, payload_digest, record_type (response or revisit) and refers_to (page id of the stored response).

    A null or empty html is an empty payload, always stored; repeated rows are revisits of the first; a null
    page id stays null. Archives are bounded by the input partitions. Empty input gives no archive record and no
    row; other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert_arc(spark, arc, warc)
    return read_warc(spark, warc)
