"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writer: of pages with equal payloads the one with the largest page_id is a response, the
others are revisits of it. Each record is a gzip member; archives are rolled over at
ROLL_BYTES and named by task attempt, and only those named in the manifest count, so a
task that runs twice leaves no double records.

Reader: at each position a gzip member or a "WARC/1." version line must begin. A record
passes if it decompresses, has a header block, its Content-Length fits, the two line ends
follow, and its block digest (and a response's payload digest) are right. After a failed
check the next place is searched at which a record passes; the bytes between are logged as
a gap with the reason. Files are read in windows, so memory is bounded by one record;
headers may have any length.

Edge cases: a null html is an empty payload; a null url has no target header, a null page_id
no number in its record's id (it reads back as null); rows that share page_id and payload are
alike (all responses or all revisits); line ends in a url are escaped; an empty table gives
an empty manifest and no rows. Urls and payloads may have any length that a cell can. A file that does
not give back the records that its manifest lists is an error; its gaps are in a table of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLL_BYTES, WINDOW, LEAST_BYTES = 16 << 20, 1 << 20, 0
#: Against runaway members only: a cell has less than 2 GiB, so a page's html and url (escaped, three times that) stay below it.
RECORD_BYTES = 1 << 33
HEADERS_END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
ID = re.compile(r"<urn:x-page:(-?\d+)>")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, not compressed; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Failed(ValueError):
    pass


def parsed(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers in lower case, block and length of the record that data begins with."""
    if not data.startswith(VERSION):
        raise Failed("no version line")
    end = data.find(HEADERS_END)
    if end < 0:
        raise Failed("no end of headers")
    head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[:end].decode("utf-8", "replace").split("\r\n")[1:]))
    size = head.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Failed("no content length")
    begin, n = end + 4, int(size)
    if data[begin + n : begin + n + 4] != b"\r\n\r\n":
        raise Failed("length and line ends disagree")
    block = data[begin : begin + n]
    for name, body in (("warc-block-digest", block), ("warc-payload-digest", payload_of(head, block))):
        kind, _, digest = head.get(name, "").partition(":")
        if body is not None and kind.lower() == "sha1" and digest.upper() != base32_sha1(body):
            raise Failed(f"wrong {name[5:].replace('-', ' ')}")
    return head, block, begin + n + 4


def payload_of(head: dict[str, str], block: bytes) -> bytes | None:
    """Payload of a response; None for other types."""
    if head.get("warc-type") != "response":
        return None
    return block.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else block


class Archive:
    """Random reads of a file through one window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""
        self.asked, self.ends = 0, -1

    def bytes_at(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.held):
            self.at = pos
            self.file.seek(pos)
            self.held = self.file.read(max(n, WINDOW))
        return self.held[pos - self.at : pos - self.at + n]

    def find(self, pos: int) -> int:
        """Where the next magic number or version line begins, from pos on; the size if nowhere."""
        while pos < self.size:
            data = self.bytes_at(pos, WINDOW)
            found = [i for i in (data.find(MAGIC), data.find(VERSION)) if i >= 0]
            if found:
                return pos + min(found)
            pos += max(1, len(data) - len(VERSION) + 1)
        return self.size

    def headers_end(self, pos: int) -> int:
        """Where the first blank line from pos on begins; the size if nowhere. What was searched before is not searched again."""
        if self.asked <= pos <= self.ends:
            return self.ends
        at = pos
        while at < self.size:
            data = self.bytes_at(at, WINDOW)
            found = data.find(HEADERS_END)
            if found >= 0:
                at += found
                break
            at += max(1, len(data) - len(HEADERS_END) + 1)
        self.asked, self.ends = pos, min(at, self.size)
        return self.ends

    def record_at(self, pos: int) -> tuple[dict[str, str], bytes, int]:
        """Headers, block and length in the file of the record at pos."""
        start = self.bytes_at(pos, len(VERSION))
        if start.startswith(MAGIC):
            z, out, used = zlib.decompressobj(31), bytearray(), 0
            while not z.eof:
                piece = self.bytes_at(pos + used, WINDOW // 4)
                if not piece:
                    raise Failed("member cut off")
                try:
                    out += z.decompress(piece)
                except zlib.error as e:
                    raise Failed("member damaged") from e
                used += len(piece)
                if len(out) > RECORD_BYTES:
                    raise Failed("record too long")
            head, block, n = parsed(bytes(out))
            if n != len(out):
                raise Failed("more than one record in a member")
            return head, block, used - len(z.unused_data)
        if not start.startswith(VERSION):
            raise Failed("no record begins here")
        end = self.headers_end(pos)
        if end == self.size:
            raise Failed("no end of headers")
        head = self.bytes_at(pos, end - pos)
        size = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,10})[ \t]*\r\n", head + b"\r\n", re.I)
        if not size:
            raise Failed("no content length")
        n = end - pos + 8 + int(size[1])
        if n > min(RECORD_BYTES, self.size - pos):
            raise Failed("record cut off")
        return parsed(self.bytes_at(pos, n))

    def salvaged(self):
        """(offset, length, headers, block, None) of each record and (offset, length, None, None, reason) of each gap, in order."""
        pos, gap, reason = 0, None, ""
        while pos < self.size:
            try:
                head, block, n = self.record_at(pos)
            except Failed as e:
                if gap is None:
                    gap, reason = pos, str(e)
                pos = self.find(pos + 1)
                continue
            if gap is not None:
                yield gap, pos - gap, None, None, reason
                gap = None
            yield pos, n, head, block, None
            pos += n
        if gap is not None:
            yield gap, self.size - gap, None, None, reason


def opened(path: str):
    """Filesystem and path in it; the names by which Hadoop knows S3 are turned into Arrow's."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages (page_id, url, html, leader: the page a revisit refers to, else null) -> stored manifest (path, records, size)."""
    common.ship(pages.sparkSession)

    def run(batches):
        fs, inner = opened(folder)
        fs.create_dir(inner, recursive=True)
        task, n, out, size, records = TaskContext.get().taskAttemptId(), 0, None, 0, 0
        done = []
        for batch in batches:
            for page_id, url, html, leader in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task}-{n}.warc.gz"
                    out, size, records, n = fs.open_output_stream(f"{inner}/{name}", compression=None), 0, 0, n + 1
                data = member(record(page_id, url, (html or "").encode("utf-8", "replace"), leader))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", records, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": pa.array([d[1] for d in done], pa.int64()), "size": pa.array([d[2] for d in done], pa.int64())}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("size", pa.int64())]))

    return common.stored(pages.select("page_id", "url", "html", "leader").mapInArrow(run, "path string, records long, size long"), "op3-manifest")


READ = "path string, offset long, length long, gap string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """paths (path) -> READ: a row for each record (gap null) and each quarantined gap (gap: the reason)."""
    common.ship(paths.sparkSession)

    def number(value: str | None) -> int | None:
        m = ID.fullmatch(value or "")
        return int(m[1]) if m else None

    def rows(path: str):
        fs, inner = opened(path)
        with fs.open_input_file(inner) as f:
            for offset, length, head, block, reason in Archive(f, f.size()).salvaged():
                if head is None:
                    yield path, offset, length, reason, None, None, None, None, None, None
                    continue
                payload = payload_of(head, block)
                if payload is None:
                    size = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", block, re.I)
                    size = int(size[1]) if size else None
                else:
                    size = len(payload)
                digest = head.get("warc-payload-digest", "").partition(":")[2] or None
                yield path, offset, length, None, number(head.get("warc-record-id")), head.get("warc-type"), number(head.get("warc-refers-to")), size, digest, payload if with_payload else None

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches):
        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        found, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    found.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 8 << 20:
                        yield pack(found)
                        found, size = [], 0
        if found:
            yield pack(found)

    return paths.select("path").mapInArrow(run, READ)


def with_leaders(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds `leader`: for all but the largest page_id of equal payloads of enough bytes, that page_id."""
    html = F.coalesce(F.col("html"), F.lit(""))
    ids = common.stored(pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size")), "op3-ids")
    groups = ids.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    known = common.join_on_hot_key(ids.select("page_id", "digest"), groups, "digest", "copies", F.coalesce("page_id", F.lit(0)))
    later = common.stored(known.where("page_id < last").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("last").alias("leader")).distinct(), "op3-revisits")
    later = common.small(later, 96)  # two ids and a digest of 40 characters
    on = (F.col("page_id") == F.col("_id")) & (F.sha1(html.cast("binary")) == F.col("_digest"))
    return pages.select("page_id", "url", "html").join(later, on, "left").select("page_id", "url", "html", "leader")


def read_checked(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the archives in a manifest (path, records), both stored; an error if one holds other than its number of records."""
    spark = manifest.sparkSession
    paths = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    found = common.stored(read_archives(paths).drop("payload"), "op3-read")
    records, gaps = found.where("gap is null"), found.where("gap is not null").select("path", "offset", "length", "gap")
    counts = records.groupBy("path").agg(F.count("*").alias("found"))
    wrong = manifest.join(counts, "path", "left").where("records <> coalesce(found, 0)").select("path", "records", "found").limit(5).collect()
    if wrong:
        raise ValueError(f"archives without some of their records: {[tuple(r) for r in wrong]}; gaps: {[tuple(r) for r in gaps.limit(5).collect()]}")
    return records, gaps


def op3_salvaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(sf_dir, "pages", spark).select("page_id", "url", "html")
    manifest = write_archives(with_leaders(pages), common.new_path(spark, "op3-warc"))
    records, _ = read_checked(manifest)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hx FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hx) AS last FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m
"""
