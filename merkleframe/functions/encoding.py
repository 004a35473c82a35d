"""Byte forms of directories, linked objects, content ids and Git trees. Decoders are strict: one form for one value."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

MAX_ENTRIES = 1_000_000
FILE, DIRECTORY, SYMLINK = 0, 1, 2


class Malformed(ValueError):
    """Bytes that are no canonical encoding."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def u64(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def sized(self, most: int) -> bytes:
        n = self.u64()
        if n > most:
            raise Malformed("a field is too long")
        return self.take(n)

    def end(self) -> None:
        if self.at != len(self.data):
            raise Malformed("trailing bytes")


def _sized(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


def check_component(name: bytes) -> None:
    if not name or len(name) > 255 or b"/" in name or b"\x00" in name or name in (b".", b".."):
        raise Malformed("not a path component")


def encode_directory(entries: Iterable[tuple]) -> bytes:
    """Entries (name, tag, child, size, executable, target), in any order, as their canonical bytes."""
    rows = sorted(entries, key=lambda e: e[0])
    out = [struct.pack("<Q", len(rows))]
    for i, (name, tag, child, size, executable, target) in enumerate(rows):
        check_component(name)
        if i and rows[i - 1][0] == name:
            raise Malformed("a name is there twice")
        out += [bytes([tag]), _sized(name)]
        if tag == SYMLINK:
            if not 1 <= len(target) <= 4095 or b"\x00" in target:
                raise Malformed("not a symlink target")
            out.append(_sized(target))
        elif tag in (FILE, DIRECTORY):
            if len(child) != 32:
                raise Malformed("a digest has 32 bytes")
            out += [child, struct.pack("<Q", size)]
            if tag == FILE:
                out.append(bytes([bool(executable)]))
        else:
            raise Malformed("an unknown tag")
    return b"".join(out)


def decode_directory(data: bytes) -> list[tuple]:
    r = _Reader(data)
    n = r.u64()
    if n > MAX_ENTRIES or n * 10 > len(data):  # no entry is shorter
        raise Malformed("more entries than bytes")
    out: list[tuple] = []
    for _ in range(n):
        tag = r.take(1)[0]
        name = r.sized(255)
        check_component(name)
        if out and name <= out[-1][0]:
            raise Malformed("names out of order")
        if tag == SYMLINK:
            target = r.sized(4095)
            if not target or b"\x00" in target:
                raise Malformed("not a symlink target")
            out.append((name, tag, None, None, None, target))
        elif tag in (FILE, DIRECTORY):
            child, size, flag = r.take(32), r.u64(), None
            if tag == FILE:
                flag = r.take(1)[0]
                if flag > 1:
                    raise Malformed("a flag is 0 or 1")
            out.append((name, tag, child, size, bool(flag) if tag == FILE else None, None))
        else:
            raise Malformed("an unknown tag")
    r.end()
    return out


@udtf(returnType="name binary, tag int, child binary, size long, executable boolean, target binary, error string")
class DirectoryEntries:
    """A row for each entry of a directory's bytes, or one with the error."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            for row in decode_directory(bytes(data)):
                yield (*row, None)
        except Malformed as e:
            yield (None,) * 6 + (str(e),)


def encode_directories(entries: DataFrame) -> DataFrame:
    """(dir, body, digest) of entries (dir, name, tag, child, size, executable, target); a malformed directory fails the job."""

    def pack(batches):
        for batch in batches:
            bodies = [encode_directory(tuple(e.values()) for e in es) for es in batch["entries"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["dir"], pa.array(bodies, pa.binary()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies])], ["dir", "body", "digest"])

    from pyspark.sql import functions as F

    fields = F.struct("name", "tag", "child", "size", "executable", "target")
    kind = dict(entries.dtypes)["dir"]
    return entries.groupBy("dir").agg(F.collect_list(fields).alias("entries")).mapInArrow(pack, f"dir {kind}, body binary, digest string")


def encode_linked(links: Iterable[tuple[str, bytes]], body: bytes) -> bytes:
    """A linked object's frame: its links (namespace, native id), sorted, each once, then its body."""
    rows = sorted(set(links))
    return struct.pack("<Q", len(rows)) + b"".join(_sized(ns.encode()) + _sized(i) for ns, i in rows) + _sized(body)


def decode_linked(data: bytes) -> tuple[list[tuple[str, bytes]], bytes]:
    r = _Reader(data)
    n = r.u64()
    if n > 1_000_000 or n * 16 > len(data):
        raise Malformed("more links than bytes")
    links: list[tuple[str, bytes]] = []
    for _ in range(n):
        link = r.sized(64).decode("ascii", "strict"), r.sized(128)
        if links and link <= links[-1]:
            raise Malformed("links out of order")
        links.append(link)
    body = r.sized(len(data))
    r.end()
    return links, body


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _read_uvarint(r: _Reader) -> int:
    out = shift = 0
    while True:
        b = r.take(1)[0]
        out |= (b & 0x7F) << shift
        if b < 0x80:
            if not b and shift:
                raise Malformed("a number with leading zeros")
            return out
        shift += 7
        if shift > 56:
            raise Malformed("a number too large")


def encode_cid(codec: int, hash_code: int, digest: bytes) -> bytes:
    """A version 1 content id."""
    return b"\x01" + uvarint(codec) + uvarint(hash_code) + uvarint(len(digest)) + digest


def decode_cid(data: bytes) -> tuple[int, int, bytes]:
    r = _Reader(data)
    if _read_uvarint(r) != 1:
        raise Malformed("not a version 1 content id")
    codec, code = _read_uvarint(r), _read_uvarint(r)
    digest = r.take(_read_uvarint(r))
    r.end()
    return codec, code, digest


#: The modes of Git's tree entries.
GIT_MODES = {b"100644": "file", b"100755": "executable", b"120000": "symlink", b"40000": "tree", b"160000": "gitlink"}


def parse_git_tree(data: bytes, oid_bytes: int = 20) -> list[tuple[str, bytes, bytes]]:
    """(mode, name, oid) of a Git tree's body; names in Git's order, in which a tree's name ends with a slash."""
    out, at, last = [], 0, None
    while at < len(data):
        space = data.find(b" ", at, at + 7)
        nul = data.find(b"\x00", space + 1) if space > 0 else -1
        if space < 0 or nul < 0 or nul + 1 + oid_bytes > len(data):
            raise Malformed("truncated")
        mode, name = data[at:space], data[space + 1 : nul]
        if mode not in GIT_MODES:
            raise Malformed("an unknown mode")
        if not name or b"/" in name or name in (b".", b".."):
            raise Malformed("not a path component")
        order = name + (b"/" if GIT_MODES[mode] == "tree" else b"")
        if last is not None and order <= last:
            raise Malformed("names out of order")
        last, at = order, nul + 1 + oid_bytes
        out.append((mode.decode(), name, data[nul + 1 : at]))
    return out


@udtf(returnType="mode string, name binary, oid string, error string")
class GitTreeEntries:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            for mode, name, oid in parse_git_tree(bytes(data)):
                yield mode, name, oid.hex(), None
        except Malformed as e:
            yield None, None, None, str(e)
