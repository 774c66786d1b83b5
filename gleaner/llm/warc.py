"""ZIP-packaged web archives: written by pages, read by ranges.

Each package is a ZIP whose members are stored, not deflated: `archive/data.warc.gz` with a gzip member to each record
and `indexes/index.cdx` with a line of JSON to each record (offset and length in the archive). The
reader takes a package's end first: end-of-central-directory record, ZIP64 locator and directory where there are any, then
the central directory; it finds the stored members, range-reads the index, and range-reads the records it names.
Nothing is extracted, and a task holds one record at a time.

Packages go to a folder that all executors share, by Arrow's file systems; a manifest written as a table
names those of the tasks that ended well, so a task that runs again leaves a stray file, never a double record.

Records with equal payloads of at least `min_bytes` bytes: the one with the smallest page_id is a response, others are
revisits that refer to it. Rows that repeat the smallest page_id are responses too. Null html: an empty payload. Null
page_id: a revisit if a page with an id has the payload, else a response. Empty table: no package, no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import new_folder, slices, table, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, package string, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with `first_id`: the smallest page_id with this payload if that is another page, else null."""
    body = F.coalesce("html", F.lit(""))
    seen = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha"))
    firsts = pages.select("page_id", F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    firsts = firsts.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return seen.join(firsts, "sha", "left").select("page_id", "url", "html", other.alias("first_id"))


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """A WARC/1.1 record of an HTTP response; a revisit keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first_id is not None else http + payload
    clean = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([] if first_id is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(first_id)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """Writes one package: records straight into the stored member, the index behind it."""

    def __init__(self, out: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, raw: bytes, page_id: int | None) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"offset": self.at, "length": len(packed), "page": page_id}))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in self.lines))
        self.zip.close()


def _uri(folder: str) -> str:
    """A folder as Arrow takes it: plain paths and Hadoop's own form file:/x are local ones. Other schemes need Arrow's driver on executors."""
    if "://" in folder:
        return folder
    return f"file://{folder.removeprefix('file:')}"


def write_packages(pages: DataFrame, folder: str, package_bytes: int = 32 << 20) -> DataFrame:
    """Write `pages` (page_id, url, html, first_id) into packages below `folder`; the manifest, as a written table."""
    schema = to_arrow_schema(T._parse_datatype_string(MANIFEST))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(_uri(folder))
        store.create_dir(top, recursive=True)
        package, out, path = None, None, ""

        def done() -> pa.RecordBatch:
            package.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "bytes": store.get_file_info(path).size, "records": len(package.lines)}], schema=schema)

        for whole in batches:
            for batch in slices(whole, "html"):
                for row in batch.to_pylist():
                    if package is None:
                        path = f"{top}/{uuid.uuid4().hex}.wacz"
                        out = store.open_output_stream(path)
                        package = Package(_Plain(out))
                    package.add(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["first_id"]), row["page_id"])
                    if package.at >= package_bytes:
                        yield done()
                        package = None
        if package is not None:
            yield done()

    return written(pages.mapInArrow(write, MANIFEST), "manifest")


class _Plain(io.RawIOBase):
    """A stream that can only be written forward."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)


def stored_members(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset of the data, length) of the stored members of a ZIP. read_at(length, offset) reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = tail.rfind(b"PK\x06\x07", 0, end)
        if locator < 0:
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", tail, locator + 8)
        large = read_at(56, at)
        if large[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        count, length, start = struct.unpack_from("<QQQ", large, 32)
    directory, found, at = read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain = struct.unpack_from("<II", directory, at + 20)
        names, extras, notes = struct.unpack_from("<HHH", directory, at + 28)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode()
        extra = directory[at + 46 + names : at + 46 + names + extras]
        at += 46 + names + extras + notes
        wide: list[int] = []
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
            extra = extra[4 + n :]
        plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
        packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
        local = wide.pop(0) if local == 0xFFFFFFFF else local
        if method == 0 and packed == plain:
            a, b = struct.unpack("<HH", read_at(4, local + 26))
            found[name] = (local + 30 + a + b, packed)
    return found


def parse(raw: bytes) -> dict:
    """The fields of a record; of a response, digest and length come from the payload itself."""
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "target_uri": fields["WARC-Target-URI"]}
    if out["record_type"] == "response":
        return out | {"payload_bytes": len(payload), "payload_digest": digest_of(payload)}
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return out | {"payload_bytes": sizes[0], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}


def read_packages(manifest: DataFrame, folder: str, batch_rows: int = 500) -> DataFrame:
    """Every record of the packages that `manifest` names, by range reads."""
    schema = to_arrow_schema(T._parse_datatype_string(RECORDS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as f:
                    members = stored_members(f.read_at, f.size())
                    begin, length = members[INDEX]
                    lines = f.read_at(length, begin).decode().splitlines()
                    start, rows = members[ARCHIVE][0], []
                    for line in map(json.loads, lines):
                        raw = zlib.decompress(f.read_at(line["length"], start + line["offset"]), 31)
                        rows.append(parse(raw) | {"package": path.rsplit("/", 1)[-1], "offset": line["offset"], "length": line["length"]})
                        if len(rows) == batch_rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, F.col("path")).mapInArrow(read, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "packages")
    manifest = write_packages(with_first(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return read_packages(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
