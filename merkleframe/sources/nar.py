"""The NAR form of a tree, byte for byte, and its hashes."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _text(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data + b"\x00" * (-len(data) % 8)


def pack(node: dict | bytes | tuple) -> bytes:
    """A tree as a NAR: bytes are a file, (bytes, True) an executable, ("link", target) a symlink, a dict a directory by name."""
    return _text(b"nix-archive-1") + _node(node)


def _node(node) -> bytes:
    out = [_text(b"(")]
    if isinstance(node, dict):
        out += [_text(b"type"), _text(b"directory")]
        for name in sorted(node):
            out += [_text(b"entry"), _text(b"("), _text(b"name"), _text(name), _text(b"node"), _node(node[name]), _text(b")")]
    elif isinstance(node, tuple) and node[0] == "link":
        out += [_text(b"type"), _text(b"symlink"), _text(b"target"), _text(node[1])]
    else:
        data, executable = node if isinstance(node, tuple) else (node, False)
        out += [_text(b"type"), _text(b"regular")]
        if executable:
            out += [_text(b"executable"), _text(b"")]
        out += [_text(b"contents"), _text(data)]
    return b"".join([*out, _text(b")")])


class NarError(ValueError):
    pass


def unpack(data: bytes) -> list[tuple[str, str, bytes]]:
    """(path, kind, content or target) of a NAR's nodes; anything but the one form of a tree is an error."""
    at = 0

    def token() -> bytes:
        nonlocal at
        if at + 8 > len(data):
            raise NarError("truncated")
        (n,) = struct.unpack_from("<Q", data, at)
        end = at + 8 + n + (-n % 8)
        if end > len(data) or any(data[at + 8 + n : end]):
            raise NarError("truncated, or padding that isn't zero")
        out = data[at + 8 : at + 8 + n]
        at = end
        return out

    def expect(*words: bytes) -> None:
        for w in words:
            if token() != w:
                raise NarError(f"{w.decode()} was due")

    out: list[tuple[str, str, bytes]] = []

    def node(path: str) -> None:
        expect(b"(", b"type")
        kind = token()
        if kind == b"symlink":
            expect(b"target")
            out.append((path, "symlink", token()))
            expect(b")")
        elif kind == b"regular":
            word, name = token(), "file"
            if word == b"executable":
                expect(b"")
                word, name = token(), "executable"
            if word != b"contents":
                raise NarError("contents were due")
            out.append((path, name, token()))
            expect(b")")
        elif kind == b"directory":
            out.append((path, "directory", b""))
            last = None
            while (word := token()) == b"entry":
                expect(b"(", b"name")
                name = token()
                if not name or b"/" in name or b"\x00" in name or name in (b".", b".."):
                    raise NarError("not a path component")
                if last is not None and name <= last:
                    raise NarError("names out of order")
                last = name
                expect(b"node")
                node(f"{path}/{name.decode()}" if path else name.decode())
                expect(b")")
            if word != b")":
                raise NarError("an entry or an end was due")
        else:
            raise NarError("an unknown type")

    expect(b"nix-archive-1")
    node("")
    if at != len(data):
        raise NarError("trailing bytes")
    return out


def measure(files: DataFrame, key: str) -> DataFrame:
    """(key, nar_sha256, nar_size) of each tree of files (key, path, content): one task packs one tree, as its form has no parts."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, entries in zip(batch["key"].to_pylist(), batch["files"].to_pylist(), strict=True):
                root: dict = {}
                for e in entries:
                    at = root
                    *parents, name = e["path"].encode().split(b"/")
                    for p in parents:
                        at = at.setdefault(p, {})
                    at[name] = e["content"]
                data = pack(root)
                rows.append((k, hashlib.sha256(data).hexdigest(), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["key", "nar_sha256", "nar_size"])

    g = files.groupBy(F.col(key).cast("string").alias("key")).agg(F.collect_list(F.struct("path", F.col("content").cast("binary").alias("content"))).alias("files"))
    return g.mapInArrow(run, "key string, nar_sha256 string, nar_size long")


def report(requested: DataFrame, facts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Measured facts of the requested keys (key): known ones as they are, the others measured now."""
    missing = requested.join(facts.select("key"), "key", "left_anti")
    new = measure(files.join(missing.withColumnRenamed("key", key), key, "left_semi"), key)
    return requested.join(facts.select("key", "nar_sha256", "nar_size").unionByName(new), "key", "left")

