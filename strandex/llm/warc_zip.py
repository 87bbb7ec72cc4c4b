"""WARC records inside ZIP packages, written and read back by ranges.

A package is a ZIP file of stored (uncompressed) members: archive/part.warc.gz, with a
gzip member for each record, and indexes/index.tsv with page, offset and length of
each. The reader finds the end record, the ZIP64 record where there is one, the central
directory, then the local header of a member, and reads the index and each record by a
range of the package; nothing is extracted and a package is never in memory whole.

Packages are written by tasks into a folder that driver and executors share, under a
name of the task's own, and then renamed: a lost or repeated task leaves no half file.
The table of packages in the writer's result, not a listing, says which to read.

Records with equal payloads: the one with the smallest page id is a response, the
others are revisits of it; payloads shorter than `least_bytes` are responses all. Null
payloads count as empty. Repeated page ids: the first in the order of rows is written as
the response, every row gets its own record. Null page ids sort last.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import map_texts
from .storage import new_path, written

WARC, INDEX = "archive/part.warc.gz", "indexes/index.tsv"
#: Payload bytes after which a task begins a new package.
PACKAGE_BYTES = 64 << 20
_GAP = 1 << 20  # records nearer to each other than this are read together


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


# --- writing


class ZipWriter:
    """Stored members of unknown length, written in one pass; sizes follow the data in ZIP64 descriptors."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Returns where in the member the data begin."""
        m = self.members[-1]
        where = m[3]
        m[2], m[3] = zlib.crc32(data, m[2]), m[3] + len(data)
        self._put(data)
        return where

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sIQQ", b"PK\7\10", crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        n, size, end = len(self.members), self.at - start, self.at
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def record(page_id, url, payload: bytes, payload_digest: str, refers_to) -> bytes:
    """A gzip member with one WARC record; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{ident}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def write_packages(df: DataFrame, root: str) -> DataFrame:
    """df: page_id, url, payload (binary), payload_digest, refers_to -> written packages: package, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        fs.create_dir(base, recursive=True)
        made, now, held = [], None, 0

        def close():
            z, out, name, index = now
            z.end()
            z.begin(INDEX)
            z.write("".join(index).encode())
            z.end()
            z.close()
            out.close()
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}")
            made.append((f"{root}/{name}", len(index), z.at))

        for batch in batches:
            for page, url, payload, sha, ref in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                if now is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(f"{base}/{name}.tmp")
                    now, held = (ZipWriter(out), out, name, []), 0
                    now[0].begin(WARC)
                data = record(page, url, payload, sha, ref)
                at = now[0].write(data)
                now[3].append(f"{'' if page is None else page}\t{at}\t{len(data)}\n")
                held += len(data)
                if held >= PACKAGE_BYTES:
                    close()
                    now = None
        if now is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pydict({"package": [m[0] for m in made], "n_records": pa.array([m[1] for m in made], pa.int64()), "n_bytes": pa.array([m[2] for m in made], pa.int64())})

    rows = df.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "package string, n_records long, n_bytes long")
    return written(rows, "packages")


# --- reading


class ZipReader:
    """Stored members of a ZIP file, by ranges."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        tail_at = max(0, size - 65557)
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end record")
        n, length, start = struct.unpack_from("<H2I", tail, at + 10)
        if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            sig, _, where, _ = struct.unpack("<4sIQI", self.range(tail_at + at - 20, 20))
            if sig != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            z = struct.unpack("<4sQ2H2I4Q", self.range(where, 56))
            if z[0] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            n, length, start = z[7], z[8], z[9]
        self.members = self._directory(self.range(start, length), n)

    def range(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(n)
        if len(data) != n:
            raise ValueError("a range ends early")
        return data

    @staticmethod
    def _directory(raw: bytes, n: int) -> dict[str, tuple[int, int, int]]:
        """name -> offset of the local header, size, CRC of the stored members."""
        out, at = {}, 0
        for _ in range(n):
            f = struct.unpack_from("<4s6H3I5H2I", raw, at)
            if f[0] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, crc, packed, size = f[4], f[7], f[8], f[9]
            n_name, n_extra, n_note, header = f[10], f[11], f[12], f[16]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            extra, x = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # only the fields that are full in the entry
                    y = x + 4
                    if size == 0xFFFFFFFF:
                        size, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                    if packed == 0xFFFFFFFF:
                        packed, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", extra, y)[0]
                x += 4 + length
            if method == 0:
                if packed != size:
                    raise ValueError("a stored member of two sizes")
                out[name] = (header, size, crc)
            at += 46 + n_name + n_extra + n_note
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's data are: offset in the file, and size."""
        header, size, _ = self.members[name]
        h = struct.unpack("<4s5H3I2H", self.range(header, 30))
        if h[0] != b"PK\3\4":
            raise ValueError("no local header")
        return header + 30 + h[9] + h[10], size


def parse_record(data: bytes) -> dict:
    """Headers and payload of a gzip member with one WARC record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    h = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["Content-Length"])]
    h["payload"] = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
    return h


def read_package(f, size: int) -> Iterator[dict]:
    """The records of a package, by its index, in ranges of neighbours."""
    z = ZipReader(f, size)
    index_at, n = z.locate(INDEX)
    rows = [(int(o), int(length)) for _, o, length in (x.split("\t") for x in z.range(index_at, n).decode().splitlines())]
    data_at, n_data = z.locate(WARC)
    k = 0
    while k < len(rows):
        lo, end, j = rows[k][0], rows[k][0] + rows[k][1], k + 1
        while j < len(rows) and rows[j][0] + rows[j][1] - lo <= _GAP:
            end, j = rows[j][0] + rows[j][1], j + 1
        if end > n_data:
            raise ValueError("a record beyond its member")
        data = z.range(data_at + lo, end - lo)
        for o, length in rows[k:j]:
            yield parse_record(data[o - lo : o - lo + length])
        k = j


def read_packages(packages: DataFrame) -> DataFrame:
    """packages: package (URI or path) -> page_id, url, record_type, payload_digest, payload_bytes, refers_to of every record.

    Digest and length of a response are those of the payload that was read; an
    unequal digest in its header is an error.
    """
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"

    def run(batches):
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    rows = []
                    for r in read_package(f, f.size()):
                        sha, n = r["WARC-Payload-Digest"].removeprefix("sha1:"), int(r["WARC-Payload-Length"])
                        if r["payload"] is not None and (digest(r["payload"]) != sha or len(r["payload"]) != n):
                            raise ValueError("a payload differs from its digest")
                        page, ref = r["WARC-Page-ID"], r.get("WARC-Refers-To-Page")
                        rows.append((int(page) if page else None, r["WARC-Target-URI"], r["WARC-Type"], sha, n, int(ref) if ref else None))
                names = [x.split()[0] for x in schema.split(", ")]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    spark = packages.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    return packages.select("package").repartition(max(tasks, packages.count())).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, root: str, least_bytes: int = 0, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record for each row of pages into packages below root; returns the table of packages.

    Payloads are compared by digest. Only pages whose digest occurs more than once
    take part in the join that marks revisits; it is on page id and digest, so a payload
    that many pages share does not meet in one task, and rows that repeat a page id with
    another payload keep a record of their own.
    """

    def digests(keys, texts):
        raw = [(t or "").encode() for t in texts]
        return {"p": keys[page], "sha": [digest(r) for r in raw], "n": [len(r) for r in raw]}

    own = written(map_texts(pages, [page], html, digests, "p long, sha string, n long"), "page-digests")
    groups = own.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("p").alias("first"), F.count("*").alias("c")).filter("c > 1 AND first IS NOT NULL").select("sha", "first")
    again = own.join(groups, "sha").filter("p <> first").select("p", F.col("sha").alias("again"), "first").distinct()

    def records(keys, texts):
        raw = [(t or "").encode() for t in texts]
        return {"page_id": keys[page], "url": keys[url], "payload": raw, "payload_digest": [digest(r) for r in raw]}

    rows = map_texts(pages, [page, url], html, records, "page_id long, url string, payload binary, payload_digest string")
    marked = rows.join(again, (F.col("page_id") == F.col("p")) & (F.col("payload_digest") == F.col("again")), "left").withColumnRenamed("first", "refers_to")
    return write_packages(marked, root)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive pages below the shared folder and read the packages back."""
    spark = pages.sparkSession
    return read_packages(archive_pages(pages, new_path(spark, "warc"), least_bytes))
