"""Identities and names as columns: digests, keys, their text forms, and the rules names must follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
MAX_NAMESPACE, MAX_NATIVE_ID, MAX_ROOT_NAME, MAX_SEGMENT, MAX_TARGET, MAX_REF = 64, 128, 1024, 255, 4095, 1024
DIGEST_BYTES = 32
#: ``label(.label)*.v<digits>``
NAMESPACE = r"^[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)*\.v[0-9]+$"
_CONTROL = r"[\x00-\x1F\x7F]"


def digest(c: Column) -> Column:
    """Content digest as lower-case hex."""
    return F.sha2(c, 256)


def from_hex(c: Column) -> Column:
    """The digest that a hex text names; null for bad hex and any other length than 32 bytes."""
    return F.when(F.length(c) == 2 * DIGEST_BYTES, F.when(c.rlike("^[0-9a-fA-F]*$"), F.unhex(c)))


def base64url(b: Column) -> Column:
    """Unpadded URL-safe base64 on one line."""
    return F.regexp_replace(F.translate(F.base64(b), "+/\r\n", "-_"), "=+$", "")


def from_base64url(c: Column) -> Column:
    pad = F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4)).cast("int"))
    return F.unbase64(F.concat(F.translate(c, "-_", "+/"), pad))


def digest_text(b: Column) -> Column:
    return F.concat(F.lit("sha256-"), base64url(b))


def key_text(namespace: Column, native_id: Column) -> Column:
    return F.concat(namespace, F.lit(":"), base64url(native_id))


def namespace_error(c: Column) -> Column:
    """Why a namespace isn't valid, or null."""
    return (
        F.when(F.length(c) == 0, "empty")
        .when(F.octet_length(c) > MAX_NAMESPACE, "too long")
        .when(F.octet_length(c) != F.char_length(c), "not ascii")
        .when(~c.rlike(NAMESPACE), "syntax")
    )


def root_name_error(c: Column) -> Column:
    """Why a root name isn't valid, or null. The first bad segment decides, by the order of the rules within it."""

    def bad(s: Column) -> Column:
        return (
            F.when(F.length(s) == 0, "empty segment")
            .when(s.isin(".", ".."), "dot segment")
            .when(F.octet_length(s) > MAX_SEGMENT, "segment too long")
            .when(s.rlike(_CONTROL), "control")
        )

    found = F.filter(F.transform(F.split(c, "/"), bad), lambda x: x.isNotNull())
    return F.when(F.length(c) == 0, "empty").when(F.octet_length(c) > MAX_ROOT_NAME, "too long").otherwise(F.get(found, F.lit(0)))


def component_error(c: Column) -> Column:
    """Why a path component isn't valid, or null."""
    return (
        F.when(F.length(c) == 0, "empty")
        .when(F.octet_length(c) > MAX_SEGMENT, "too long")
        .when(c.isin(".", ".."), "dot")
        .when(c.contains("/"), "separator")
        .when(F.instr(c, "\x00") > 0, "nul")
    )


def target_ok(c: Column) -> Column:
    """Whether a symlink target is of 1 to 4095 bytes without NUL."""
    return F.octet_length(c).between(1, MAX_TARGET) & (F.instr(c, "\x00") == 0)


def ref_name_ok(c: Column) -> Column:
    """Whether a text is a canonical full ref name."""
    part_bad = F.exists(F.split(c, "/"), lambda s: (s == "") | s.startswith(".") | s.endswith(".lock"))
    return (
        F.octet_length(c).between(1, MAX_REF) & c.startswith("refs/") & ~c.endswith("/") & ~c.endswith(".")
        & ~c.contains("..") & ~c.contains("@{") & ~c.rlike(r"[\x00-\x20\x7F~^:?*\[\\]") & ~part_bad
    )


def is_under(name: Column, prefix: Column) -> Column:
    """Equal to or below ``prefix``, on segment boundaries."""
    return (name == prefix) | F.startswith(name, F.concat(prefix, F.lit("/")))


def nested_name(prefix: Column, source: Column) -> Column:
    """``prefix`` and the segments of ``source`` that are neither empty nor dots."""
    kept = F.filter(F.split(source, "/"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(F.concat(F.array(prefix), kept), "/")


def git_oid(kind: str, body: Column, algorithm: str = "sha1") -> Column:
    """The id of a Git object: the hash of its type, length and body."""
    framed = F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(body).cast("string").cast("binary"), F.lit(b"\x00"), body.cast("binary"))
    return F.sha1(framed) if algorithm == "sha1" else F.sha2(framed, 256)


def shard_prefix(hex_digest: Column, bits: int) -> Column:
    """The first bits of a digest, up to 32, as a number."""
    return F.shiftright(F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long"), 32 - bits)


def used_percent_at_least(total: Column, free: Column, percent: int) -> Column:
    """Disk pressure: inclusive, never for an empty disk, and free space beyond the total counts as all of it."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (total != 0) & (wide(F.greatest(total - free, F.lit(0).cast("long"))) * 100 >= wide(total) * percent)
