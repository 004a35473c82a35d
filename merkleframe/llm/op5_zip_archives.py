"""WARC in ZIP packages: write pages as stored archive members, and read them back by ranges.

A package is a ZIP file whose members are stored as they are: ``archive/data.warc.gz``, of one gzip member per record, and
``indexes/index.cdxj.gz``, a line per record with its place. The reader parses the end of the file, the ZIP64 records if
there are any, and the central directory; it finds where each stored member begins, reads the index, and then ranges of
the archive member, without extracting anything. Packages are written to the shared folder under a temporary name and
renamed, so a lost executor leaves no half package, and a second attempt replaces the first.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merkleframe.session import scratch, table, written

#: Payloads of fewer bytes are always kept in full.
MIN_DEDUP = 100
#: Bytes of records in a package, about, and of an index range that one task reads at once.
PACKAGE_BYTES, RANGE_BYTES = 64 << 20, 4 << 20
#: Tasks that read packages or ranges, at most.
TASKS = 20_000
#: Revisits that are broadcast at most, of some 120 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 200_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj.gz"
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_BREAKS = {13: "%0D", 10: "%0A"}


@contextmanager
def _store(uri: str):
    """A pyarrow file system and the path in it; both file: and remote URIs."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        yield fs.LocalFileSystem(), unquote(urlparse(uri).path)
    else:
        yield fs.FileSystem.from_uri(uri)


class ZipWriter:
    """Stored members, streamed; sizes and the checksum follow the data, and ZIP64 records come where 32 bits don't do."""

    def __init__(self, out):
        self.out, self.at, self.members, self.now = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.now = [name.encode(), self.at, 0, 0]
        # Bit 3: the sizes follow. Bit 11: the name is UTF-8. The empty ZIP64 field makes the sizes that follow 64 bits.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x0808, 0, 0, 0x21, 0, _FULL32, _FULL32, len(self.now[0]), len(extra)) + self.now[0] + extra)

    def write(self, data: bytes) -> None:
        self.now[2] += len(data)
        self.now[3] = zlib.crc32(data, self.now[3])
        self._put(data)

    def end(self) -> None:
        name, at, size, crc = self.now
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((name, at, size, crc))

    def close(self, force64: bool = False) -> None:
        first = self.at
        for name, at, size, crc in self.members:
            wide = force64 or size >= _FULL32 or at >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            low = (_FULL32, _FULL32, _FULL32) if wide else (size, size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, low[0], low[1], len(name), len(extra), 0, 0, 0, 0, low[2]) + name + extra)
        size, n = self.at - first, len(self.members)
        if force64 or first >= _FULL32 or n >= _FULL16:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, first))
            self._put(struct.pack("<IIQI", _LOCATOR64, 0, end64, 1))
            n, size, first = _FULL16, _FULL32, _FULL32
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, n, n, size, first, 0))


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{n} bytes were asked for at {at}; there are {len(data)}")
    return data


def central_directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Member name -> (first byte of its data, bytes), from the end of the file and its directories alone.

    Members that aren't stored, or are encrypted, are an error: a range of theirs means nothing.
    """
    tail_at = max(0, size - 22 - _FULL16)
    tail = read_at(f, tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", _END), 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    n, length, first = struct.unpack_from("<HII", tail, at + 10)
    if n == _FULL16 or length == _FULL32 or first == _FULL32:
        magic, _, end64, _ = struct.unpack("<IIQI", read_at(f, tail_at + at - 20, 20))
        if magic != _LOCATOR64:
            raise ValueError("no locator of the ZIP64 records")
        magic, _, _, _, _, _, _, n, length, first = struct.unpack("<IQHHIIQQQQ", read_at(f, end64, 56))
        if magic != _END64:
            raise ValueError("no ZIP64 record where its locator points")
    data, p, out = read_at(f, first, length), 0, {}
    for _ in range(n):
        (magic, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, local) = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, p)
        if magic != _CENTRAL:
            raise ValueError("no directory entry where one is due")
        name = data[p + 46 : p + 46 + n_name].decode()
        extra, q = data[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # the 64-bit values of those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, q + 4))
                plain = next(wide) if plain == _FULL32 else plain
                packed = next(wide) if packed == _FULL32 else packed
                local = next(wide) if local == _FULL32 else local
            q += 4 + k
        p += 46 + n_name + n_extra + n_note
        if method or flags & 1 or packed != plain:
            raise ValueError(f"{name} isn't stored")
        head = read_at(f, local, 30)
        if struct.unpack_from("<I", head)[0] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        out[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), plain)
    return out


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record of a page: its HTTP head, and the payload unless it revisits another page's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        # A header value is one line.
        f"WARC-Target-URI: {(url or '').translate(_BREAKS)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names lower-cased, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return headers, rest[:n]


def revisits(pages: DataFrame, min_bytes: int = MIN_DEDUP) -> DataFrame:
    """(page_id, digest, n, refers_to): the pages, by id and payload, whose payload a page of a smaller id has too."""
    p = written(pages.select("page_id", *_payload()).where(f"n >= {min_bytes} AND page_id IS NOT NULL"))
    firsts = written(p.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top")).where("refers_to < top").select("digest", "n", "refers_to"))
    return p.join(firsts, ["digest", "n"]).where("page_id > refers_to").distinct().select("page_id", "digest", "n", "refers_to")


def _payload() -> list[Column]:
    html = F.coalesce("html", F.lit(""))
    return [F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")]


def write_packages(pages: DataFrame, folder: str, min_bytes: int = MIN_DEDUP, force64: bool = False) -> DataFrame:
    """(package, records) of the packages written into ``folder``: a record per row of ``pages`` (page_id, url, html).

    A null html is an empty payload, a null url an empty one; line breaks in a url are percent-encoded. Of pages with equal payloads of ``min_bytes`` or more the
    one with the smallest page_id is a response, and the others revisit it; rows that repeat a page_id are a record each, by
    their own payloads. A row without a page_id is a response, as nothing could name it.
    """
    r = written(revisits(pages, min_bytes))
    r = F.broadcast(r) if r.count() <= MAX_BROADCAST else r
    p = pages.select(F.col("page_id").cast("long"), "url", "html", *_payload()).join(r, ["page_id", "digest", "n"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches):
        package = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if package is None:
                    package = _Package(folder, force64)
                package.add(page_id, url, (html or "").encode(), refers_to)
                if package.zip.at > PACKAGE_BYTES:
                    yield package.close()
                    package = None
        if package is not None:
            yield package.close()

    return written(p.mapInArrow(write, "package string, records long"))


class _Package:
    def __init__(self, folder: str, force64: bool):
        self.uri, self.force64, self.lines = f"{folder}/{uuid.uuid4().hex}.wacz", force64, []
        with _store(self.uri) as (fs, path):
            self.fs, self.path = fs, path
            fs.create_dir(os.path.dirname(path), recursive=True)
            self.out = fs.open_output_stream(f"{path}.part")
        self.zip = ZipWriter(self.out)
        self.zip.begin(DATA)
        self.at = 0

    def add(self, page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> None:
        digest = hashlib.sha256(payload).hexdigest()
        data = gzip.compress(_record(page_id, url, payload, digest, refers_to), 6, mtime=0)
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(data)}))
        self.zip.write(data)
        self.at += len(data)

    def close(self) -> pa.RecordBatch:
        self.zip.end()
        self.zip.begin(INDEX)
        self.zip.write(gzip.compress("\n".join(self.lines).encode(), 6, mtime=0))
        self.zip.end()
        self.zip.close(self.force64)
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return pa.RecordBatch.from_pydict({"package": pa.array([self.uri], pa.string()), "records": pa.array([len(self.lines)], pa.int64())})


def index_ranges(packages: DataFrame) -> DataFrame:
    """(package, first, lengths): runs of neighbouring records of RANGE_BYTES, about; ``first`` counts from the start of the file."""

    def plan(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["package"].to_pylist():
                with _store(uri) as (fs, path), fs.open_input_file(path) as f:
                    members = central_directory(f, fs.get_file_info(path).size)
                    index = gzip.decompress(read_at(f, *members[INDEX])).decode()
                runs: list[list] = []
                for entry in map(json.loads, index.splitlines()):
                    at = members[DATA][0] + entry["offset"]
                    if entry["offset"] + entry["length"] > members[DATA][1]:
                        raise ValueError("the index points past its archive")
                    if not runs or sum(runs[-1][1]) > RANGE_BYTES or runs[-1][0] + sum(runs[-1][1]) != at:
                        runs.append([at, []])
                    runs[-1][1].append(entry["length"])
                yield pa.RecordBatch.from_pydict({"package": pa.array([uri] * len(runs), pa.string()), "first": pa.array([r[0] for r in runs], pa.int64()), "lengths": pa.array([r[1] for r in runs], pa.list_(pa.int64()))})

    p = packages.select("package")
    return written(p.repartition(_tasks(p)).mapInArrow(plan, "package string, first long, lengths array<long>"))


def _tasks(rows: DataFrame) -> int:
    """A task for each row, up to TASKS: rows are a few bytes, so that adaptive execution would put them all into one."""
    return min(TASKS, max(1, rows.count()))


def read_records(ranges: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, html) of the records in the ranges; html is null for revisits."""

    def read(batches):
        for batch in batches:
            for uri, first, lengths in zip(*(batch[c].to_pylist() for c in ("package", "first", "lengths")), strict=True):
                with _store(uri) as (fs, path), fs.open_input_file(path) as f:
                    data = read_at(f, first, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    headers, block = parse_record(gzip.decompress(data[at : at + n]))
                    at += n
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{headers['warc-record-id']} isn't what its digest says")
                    refers = headers.get("warc-refers-to")
                    rows.append((_page(headers["warc-record-id"]), headers["warc-target-uri"], kind, digest, size, _page(refers) if refers else None, payload.decode() if kind == "response" else None))
                names = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html")
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"
    return ranges.repartition(_tasks(ranges)).mapInArrow(read, schema)


def _page(urn: str) -> int | None:
    page = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if page == "none" else int(page)


def op5_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(table(spark, sf_dir, "pages"), scratch(spark))
    out = read_records(index_ranges(packages))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_zip_archives": op5_zip_archives}

ORACLE = {
    "op5_zip_archives": f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= {MIN_DEDUP} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
}
