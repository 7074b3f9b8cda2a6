"""Legacy ARC archives, their conversion to WARC, and WARC archives written and read back.

An ARC record is a header line, whose fields depend on the archive's version, and as many bytes as the line declares. WARC asks
for more than it holds: record ids, ISO timestamps, record types and digests are made from what is there, so that the same
record gets the same ones again. Archives of both kinds are written by Spark's writer, gzip-compressed, to any store that Spark can write,
and read back as streams. An archive is one row of the writer, so its size is bounded by bytes, whatever the sizes of its records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintmill.llm import common

# Fixed formats: the fields of a header line by version of the archive.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
NAMESPACE = uuid.UUID("6f1a8c52-3d0b-5e0e-9c0a-2f4f4f6d7a11")
#: An archive ends with the record that reaches so many bytes.
ARCHIVE_BYTES = 24 << 20
#: A batch of records ends with the one that reaches so many bytes.
BATCH_BYTES = 4 << 20
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)


class ArchiveError(ValueError):
    """The archive isn't as its version or its declared lengths say."""


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes, bytes]:
        """Header fields (lower case), the raw header with its empty line, and the payload."""
        if not self.content.startswith(b"HTTP/"):
            return {}, b"", self.content
        head, gap, payload = self.content.partition(b"\r\n\r\n")
        return dict(_field(line) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line), head + gap, payload


def _field(line: str) -> tuple[str, str]:
    name, _, value = line.partition(":")
    return name.strip().lower(), value.strip()


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, '/'.join(map(str, parts)))}"


def write_arc(records: Iterable[tuple[str, str, str, str, bytes]], version: str, name: str = "archive.arc") -> bytes:
    """An archive of (url, ip, 14-digit date, type, content) records, with its version block."""
    names = ARC_FIELDS[version]
    said = f"{version} 0 glintmill\n{' '.join(names)}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", *(["200", "-", "-", "0", name] if version == "2" else []), str(len(said))]
    out = bytearray(" ".join(head).encode() + b"\n" + said + b"\n")
    for url, ip, date, kind, content in records:
        more = ["200", digest(content), "-", str(len(out)), name] if version == "2" else []
        out += " ".join([url, ip, date, kind, *more, str(len(content))]).encode() + b"\n" + content + b"\n"
    return bytes(out)


class _Stream:
    """Bytes that come in chunks, taken by length or up to a mark."""

    def __init__(self, chunks: Iterable[bytes]):
        self.held, self.chunks, self.at = bytearray(), iter(chunks), 0

    def fill(self, n: int) -> bool:
        while len(self.held) < n:
            more = next(self.chunks, None)
            if more is None:
                return False
            self.held.extend(more)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before the next ``mark``, which is taken too; None if there is no mark any more."""
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.fill(len(self.held) + 1):
                return None
        return self.take(end + len(mark))[: -len(mark)]

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or as many as there are."""
        self.fill(n)
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out


def read_arc(data: bytes | Iterable[bytes]) -> Iterator[ArcRecord]:
    """The records of an archive, in one piece or in chunks, without its version block. Lengths are trusted only as far as there are bytes."""
    source, names = _Stream([data] if isinstance(data, bytes) else data), None
    while True:
        while source.fill(1) and source.held[:1] in (b"\n", b"\r"):
            source.take(1)
        if not source.fill(1):
            return
        at = source.at
        raw = source.upto(b"\n")
        if raw is None:
            raise ArchiveError(f"a header line without an end at byte {at}")
        line = raw.decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        expected = len(names) if names else len(values)
        if len(values) != expected or not (values[-1].isascii() and values[-1].isdigit()):
            raise ArchiveError(f"a header line of {len(values)} fields at byte {at}: {line[:100]!r}")
        length = int(values[-1])
        content = source.take(length)
        if len(content) != length:
            raise ArchiveError(f"{len(content)} bytes of the {length} declared at byte {at}")
        if names is None:
            version = content.decode("utf-8", "replace").split(" ", 1)[0]
            if not line.startswith("filedesc://") or version not in ARC_FIELDS:
                raise ArchiveError("no version block at the beginning")
            names = ARC_FIELDS[version]
            if len(values) != len(names):
                raise ArchiveError(f"a version block of {len(values)} fields in version {version}")
            continue
        yield ArcRecord(dict(zip(names, values, strict=True)), content)


def to_warc(record: ArcRecord, revisits: str | None = None, refers_to: int | None = None) -> tuple[str, bytes]:
    """Header and block of the WARC record that an ARC record becomes; with ``revisits``, an id, without its payload."""
    http, head, payload = record.http
    own = digest(payload)
    f = record.fields
    date = f["Archive-date"]
    moment = datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = "revisit" if revisits else "response" if head else "resource"
    block = head if revisits else record.content
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(http.get('x-page-id', f['URL'] + date), own)}>", f"WARC-Date: {moment}", f"WARC-Target-URI: {f['URL']}",
             f"WARC-IP-Address: {f['IP-address']}", f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisits:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{revisits}>", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else f['Content-type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + END, block


def read_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record, by declared lengths."""
    source = _Stream(chunks)
    while True:
        head = source.upto(b"\r\n\r\n")
        if head is None:
            if source.held.strip():
                raise ArchiveError("a record header without an end")
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ArchiveError(f"no record where one is due: {lines[0][:60]!r}")
        fields = dict(_field(line) for line in lines[1:])
        length = int(fields["content-length"])
        block = source.take(length)
        if len(block) != length or source.take(4) != b"\r\n\r\n":
            raise ArchiveError("a record whose length isn't the one declared")
        yield fields, block


def unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """All members of a gzip file, or plain data, in chunks."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    source, one = io.BytesIO(data), zlib.decompressobj(31)
    while raw := source.read(step):
        while raw:
            yield one.decompress(raw)
            raw = one.unused_data
            if one.eof:
                one = zlib.decompressobj(31)


def _crawled(page_id: int | None, url: str | None, page: str | None) -> tuple[str, str, str, str, bytes]:
    """The ARC record as which a page would have come."""
    body = (page or "").encode()
    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode() + body
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or f"urn:glintmill:page:{page_id}"
    date = (EPOCH + timedelta(seconds=(page_id or 0) % (20 * 365 * 86400))).strftime("%Y%m%d%H%M%S")
    return url, "0.0.0.0", date, "text/html", content


def _written(archives: DataFrame, label: str, end: str) -> str:
    """Writes each row's ``value``, an archive but for its last line end, as a file; returns the folder."""
    path = common.shared_path(archives.sparkSession, label)
    # The text writer puts bytes out as they are.
    archives.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)
    common.delete_at_end(archives.sparkSession, path)
    return path


def _values(archives: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    for data in archives:
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])


def write_arc_files(pages: DataFrame) -> str:
    """Stores ``pages`` as ARC archives, of versions 1 and 2 by turns, in the shared folder; returns their path."""
    common.python_batches(pages.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archives() -> Iterator[bytes]:
            held, size, turn = [], 0, 0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    turn = turn or 1 + (row[0] or 0) % 2
                    held.append(_crawled(*row))
                    size += len(held[-1][4])
                    if size >= ARCHIVE_BYTES:
                        yield write_arc(held, str(turn))[:-1]
                        held, size, turn = [], 0, 3 - turn
            if held:
                yield write_arc(held, str(turn))[:-1]

        yield from _values(archives())

    return _written(common.pick(pages, "page_id", "url", "html").mapInArrow(store, "value binary"), "arc", "\n")


ARC_SCHEMA = "page_id long, url string, ip string, date string, type string, content binary, digest string, n long"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(content) of the files of a folder, or those that a pattern names."""
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")


def read_arc_files(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """The records of stored ARC archives of either version, plain or gzip (of one or many members): page_id (from an X-Page-Id header, else null),
    url, ip, date, type, content (null without ``contents``), digest and length of the payload. A damaged archive raises ArchiveError."""
    common.python_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [f.split()[0] for f in ARC_SCHEMA.split(", ")]
            types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in ARC_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for r in read_arc(unzipped(data.as_py())):
                    http, _, payload = r.http
                    f, said = r.fields, http.get("x-page-id", "")
                    rows.append((int(said) if said else None, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], r.content if contents else None, digest(payload), len(payload)))
                    size += len(r.content)
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return _stored(spark, path).mapInArrow(parse, ARC_SCHEMA)


def convert_archives(spark: SparkSession, arc_path: str, least: int = 0) -> str:
    """Converts stored ARC archives to WARC archives in the shared folder; returns their path.

    Of records with equal payloads of at least ``least`` bytes the one of the largest page_id is a response and the others
    revisit it.
    """
    common.python_batches(spark)
    seen = common.materialise(read_arc_files(spark, arc_path, contents=False).select("page_id", "digest", "n"), "digests")
    by = seen.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1 AND first IS NOT NULL")
    again = seen.join(by, "digest").filter("page_id IS NULL OR page_id < first").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), F.col("first").alias("refers_to")).distinct()
    again = common.beside(common.materialise(again, "revisits"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archives() -> Iterator[bytes]:
            held, size = [], 0
            for batch in batches:
                for url, ip, date, kind, content, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    record = ArcRecord({"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind}, content)
                    revisits = None if refers_to is None else record_id(refers_to, digest(record.http[2]))
                    head, block = to_warc(record, revisits, refers_to)
                    held += [head.encode(), block, END.encode()]
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield b"".join(held[:-1])
                        held, size = [], 0
            if held:
                yield b"".join(held[:-1])

        yield from _values(archives())

    rows = read_arc_files(spark, arc_path)
    both = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("url", "ip", "date", "type", "content", "refers_to")
    # The line end is the end of a WARC record, so the files are WARC files.
    return _written(both.mapInArrow(convert, "value binary"), "warc", END)


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC archives in ``path``: what :func:`records` returns."""
    common.python_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in names])
        number = lambda v: int(v) if v else None
        for batch in batches:
            for data in batch.column(0):
                out = []
                for fields, block in read_warc(unzipped(data.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(_field(x) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
                    said, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and (digest(payload) != said or len(payload) != int(http["content-length"])):
                        raise ArchiveError(f"{fields['warc-record-id']}: the payload isn't the one declared")
                    out.append((number(http.get("x-page-id")), int(http["content-length"]), said, kind, number(fields.get("x-refers-to-page"))))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return _stored(spark, path).mapInArrow(parse, RECORD_SCHEMA)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Stores ``pages`` as ARC archives, converts these to WARC archives, a record for each row, and reads the archives back: page_id,
    payload_bytes, payload_digest, record_type (response or revisit), refers_to.

    A null html is an empty payload; a null or blank url gets a URN, white space in one is percent-encoded. Rows that repeat the
    largest page_id of a payload are all responses; a null page_id stays null and revisits wherever an id has its payload, else
    is a response. Further columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    return read_archives(spark, convert_archives(spark, write_arc_files(pages), least))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || rpad(substr(h, (1 + (5 * i) // 4)::INT, 2), 2, '0'))::INT) >> (3 - (5 * i) % 4)::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM p JOIN m USING (h)"""
