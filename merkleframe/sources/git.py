"""Git repositories: loose objects and refs as frames."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merkleframe.functions.encoding import Malformed, parse_git_tree


def parse_loose(data: bytes) -> tuple[str, bytes]:
    """Kind and body of a loose object's file."""
    try:
        raw = zlib.decompress(data)
    except zlib.error as e:
        raise Malformed("not a zlib stream") from e
    head, nul, body = raw.partition(b"\x00")
    kind, _, size = head.partition(b" ")
    if not nul or kind not in (b"blob", b"tree", b"commit", b"tag") or not size.isdigit() or int(size) != len(body):
        raise Malformed("not a loose object")
    return kind.decode(), body


def links_of(kind: str, body: bytes) -> list[str]:
    """Ids that an object links to, sorted; a submodule's commit is none of them."""
    out: set[str] = set()
    if kind == "tree":
        out = {oid.hex() for mode, _, oid in parse_git_tree(body) if mode != "160000"}
    elif kind in ("commit", "tag"):
        for line in body.split(b"\n\n", 1)[0].split(b"\n"):
            word, _, rest = line.partition(b" ")
            if word in (b"tree", b"parent", b"object"):
                out.add(rest.decode())
    return sorted(out)


def read_loose(spark: SparkSession, git_dir: str) -> DataFrame:
    """(oid, kind, size, links) of a repository's loose objects; an object whose bytes aren't its id fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9a-f]*").load(f"{git_dir.rstrip('/')}/objects")
    files = files.where(F.col("path").rlike("/objects/[0-9a-f]{2}/[0-9a-f]{38}$")).select("path", "content")

    def parse(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                kind, body = parse_loose(data)
                oid = "".join(path.split("/")[-2:])
                if hashlib.sha1(f"{kind} {len(body)}\x00".encode() + body).hexdigest() != oid:
                    raise Malformed(f"{oid} isn't the id of its bytes")
                rows.append((oid, kind, len(body), links_of(kind, body)))
            types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["oid", "kind", "size", "links"])

    return files.mapInArrow(parse, "oid string, kind string, size long, links array<string>")


def read_refs(spark: SparkSession, git_dir: str) -> DataFrame:
    """(name, target, symbolic) of a repository's loose refs and HEAD."""
    base = git_dir.rstrip("/")
    refs = spark.read.text([f"{base}/refs", f"{base}/HEAD"], wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.trim(F.regexp_replace("value", "\\s+$", "")).alias("value"))
    name = F.coalesce(F.nullif(F.regexp_extract("file", "(refs/.*)$", 1), F.lit("")), F.lit("HEAD"))
    symbolic = F.col("value").startswith("ref: ")
    return refs.select(name.alias("name"), F.regexp_replace("value", "^ref: *", "").alias("target"), symbolic.alias("symbolic"))
