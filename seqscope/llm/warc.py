"""Web archives in ZIP packages: written with stored members and an index, read by ranges.

A package holds archive/data.warc.gz (one gzip member a record) and indexes/index.cdxj, both stored, so a
record is a range of the package's bytes: the reader finds the central directory (ZIP64 too) from the
package's end, the members' places from it, the records' places from the index, and reads just those.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, save, text_of

#: Payload bytes after which a package is closed.
PACKAGE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: The formats' signatures, and the date that all records bear.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
DATE = datetime(2026, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
FULL = 0xFFFFFFFF


class RangeFile:
    """Ranges of a file in any store that pyarrow reaches; counts the bytes read."""

    def __init__(self, uri: str) -> None:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()
        self.bytes_read = 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError("range outside the file")
        self._file.seek(offset)
        self.bytes_read += length
        return self._file.read(length)

    def close(self) -> None:
        self._file.close()


class Bytes(RangeFile):
    """The same over bytes in memory."""

    def __init__(self, data: bytes) -> None:
        self._data, self.size, self.bytes_read = data, len(data), 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError("range outside the file")
        self.bytes_read += length
        return self._data[offset : offset + length]

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Member:
    """A member of a ZIP file: where its local header is, its sizes, check sum and method (0: stored)."""

    name: str
    header: int
    size: int
    packed: int
    crc: int
    method: int


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with all members stored; with ZIP64 fields where a number needs them, or if zip64."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        at, raw, crc, n = len(out), name.encode(), zlib.crc32(data), len(data)
        big = zip64 or n >= FULL or at >= FULL
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        version, size = (45, FULL) if big else (20, n)
        out += LOCAL + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL if big else at) + raw + extra
    at, n = len(out), len(members)
    out += directory
    if zip64 or n >= 0xFFFF or at >= FULL:
        end = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at)
        out += LOCATOR64 + struct.pack("<IQI", 0, end, 1)
        out += END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, FULL, FULL, 0)
    else:
        out += END + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), at, 0)
    return bytes(out)


def members_of(file: RangeFile) -> dict[str, Member]:
    """The members by the central directory, which the record at the file's end (or its ZIP64 form) locates."""
    tail = file.read(start := max(0, file.size - 0xFFFF - 22), file.size - start)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, length, offset, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if n == 0xFFFF or FULL in (length, offset):
        locator = file.read(start + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end = file.read(int.from_bytes(locator[8:16], "little"), 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, offset = struct.unpack_from("<QQQ", end, 32)
    directory, out, at = file.read(offset, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        _, _, flags, method, _, _, crc, packed, size, names, extras, comments, _, _, _, header = struct.unpack_from("<HHHHHHIIIHHHHHII", directory, at + 4)
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, m = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                size, packed, header = (next(wide) if v == FULL else v for v in (size, packed, header))
            k += 4 + m
        out[name] = Member(name, header, size, packed, crc, method)
        at += 46 + names + extras + comments
    return out


def data_at(file: RangeFile, member: Member) -> int:
    """Where a stored member's bytes begin: past its local header, whose extra field may differ from the directory's."""
    if member.method:
        raise ValueError(f"{member.name} isn't stored")
    local = file.read(member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError("no local header")
    names, extras = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + names + extras


def record_id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def page_of(record: str | None) -> int | None:
    text = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "null") else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit with the HTTP header alone, which keeps the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page), "WARC-Date": DATE, "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Payload-Digest": f"sha1:{sha1}"}
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def package(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP package of records (page's url, record): the gzipped records and a line for each one's place."""
    data, index = bytearray(), []
    for url, raw in records:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        index.append(f"{url} {json.dumps({'offset': str(len(data)), 'length': str(len(packed))})}\n")
        data += packed
    return zip_bytes([(DATA, bytes(data)), (INDEX, "".join(index).encode())])


def records_of(file: RangeFile) -> Iterator[bytes]:
    """All records of a package, each read by its range of bytes as its index has it."""
    members = members_of(file)
    index = file.read(data_at(file, members[INDEX]), members[INDEX].size)
    if zlib.crc32(index) != members[INDEX].crc:
        raise ValueError("broken index")
    base = data_at(file, members[DATA])
    for line in index.decode().splitlines():
        place = json.loads(line[line.rindex(" {") :] if not line.startswith(" {") else line)
        offset, length = int(place["offset"]), int(place["length"])
        yield zlib.decompress(file.read(base + offset, length), 31)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least least_bytes bytes that with the smallest page_id (null last)
    is the response (of its rows with different urls one; rows equal in all are all responses); the
    others are revisits of it. The html of a
    page meets nothing but the smallest page_id of its digest, so a payload that many pages have
    is split like any skewed join.
    """
    html = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("hex"), F.octet_length(html).cast("long").alias("bytes"))
    order = F.struct(F.col("page_id").isNull().alias("z"), "page_id", F.xxhash64("url").alias("u"))
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("hex").agg(F.count("*").alias("n"), F.min(order).alias("o")).where("n > 1")
    first = first.select(F.col("hex").alias("h"), F.col("o.page_id").alias("response"), F.col("o.u").alias("u"))
    joined = rows.join(first, (rows.hex == first.h) & (rows.bytes >= least_bytes), "left")
    own = F.col("page_id").eqNullSafe(F.col("response")) & (F.xxhash64("url") == F.col("u"))
    revisit = F.col("h").isNotNull() & ~own
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages of all pages into a folder that all executors share; returns their uris (and records in each).

    Each attempt of a task writes files of its own, and the table of uris has those of the attempt
    that Spark commits: a task that runs again or twice never replaces a package, and no file is renamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get(), [], [], 0

        def close() -> None:
            uri = f"{folder}/{task.partitionId():06d}-{len(made):05d}-{task.taskAttemptId()}.wacz"
            system, path = pyarrow.fs.FileSystem.from_uri(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(package(held))
            made.append((uri, len(held)))

        for batch in batches:
            for page, url, html, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                held.append((quote(url or "", safe=":/?&=%"), record(page, url, payload, digest(payload), refers, kind == "revisit")))
                size += len(payload)
                if size >= package_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["uri", "records"])

    rows = deduplicated(pages, least_bytes).sortWithinPartitions("page_id", "url", F.xxhash64("html"), "record_type")
    return save(rows.mapInArrow(run, "uri string, records long"))


def read(packages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records of packages.

    A response's payload is checked against its digest; a revisit has none (null). The url is as the
    archive has it: percent-encoded where a header needs it, and empty where it was null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file, rows = RangeFile(uri), []
                for raw in records_of(file):
                    fields, http, body = parse(raw)
                    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest(body) != sha1:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is broken")
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], None if revisit else body, int(http["Content-Length"]), sha1, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                file.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = max(1, packages.count())
    spread = packages.select("uri").repartition(min(n, 10_000), "uri")
    return spread.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages into packages in the shared folder and reads them back (see deduplicated and read).

    A null html is an empty payload; rows equal in all columns each get a record; an empty table gives
    no row; other columns of pages are not in the archive. The folder is removed when the driver's Python ends.
    """
    folder = new_folder(pages.sparkSession, "packages")
    if "://" not in folder:
        folder = folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    return read(write(pages, folder, least_bytes))
