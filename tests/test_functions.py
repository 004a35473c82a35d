import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merkleframe.functions import encoding as E
from merkleframe.functions import formats, identity as I
from merkleframe.operators import metadata, storage
from merkleframe.sources import bundle, nar


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"]).select(c).first()[0]


def test_text_forms(spark):
    d = hashlib.sha256(b"x").digest()
    row = spark.createDataFrame([(bytearray(d), bytearray(b"\xff\xfe"), bytearray(b""))], "a binary, b binary, c binary")
    got = row.select(*(I.base64url(F.col(c)).alias(c) for c in "abc")).first()
    assert got.b == "__4" and got.c == "" and "=" not in got.a and len(got.a) == 43
    back = row.select(*(I.from_base64url(I.base64url(F.col(c))) for c in "abc")).first()
    assert [bytes(x) for x in back] == [d, b"\xff\xfe", b""]
    assert one(spark, I.digest_text(F.unhex(F.lit(d.hex())))).startswith("sha256-")


@pytest.mark.parametrize(("name", "error"), [("a/b", None), ("", "empty"), ("a//b", "empty segment"), ("a/./b", "dot segment"), ("x" * 256, "segment too long"), ("a/" * 600, "too long"), ("a\tb", "control"), ("/a", "empty segment")])
def test_root_names(spark, name, error):
    assert one(spark, I.root_name_error(F.col("n")), n=name) == error


@pytest.mark.parametrize(("name", "ok"), [("refs/heads/main", True), ("main", False), ("refs/a..b", False), ("refs/a.lock", False), ("refs/.a", False), ("refs/a b", False), ("refs/a/", False), ("refs/a@{b", False), ("refs//a", False)])
def test_ref_names(spark, name, ok):
    assert one(spark, I.ref_name_ok(F.col("n")), n=name) == ok


@pytest.mark.parametrize(("ns", "error"), [("git.sha1.blob.v1", None), ("v1", "syntax"), ("A.v1", "syntax"), ("a.v", "syntax"), ("a.b", "syntax"), ("a-1.v22", None), ("", "empty"), ("a" * 62 + ".v1", "too long"), ("é.v1", "not ascii")])
def test_namespaces(spark, ns, error):
    assert one(spark, I.namespace_error(F.col("n")), n=ns) == error


def test_components_targets_and_prefixes(spark):
    assert one(spark, I.component_error(F.col("n")), n="a/b") == "separator" and one(spark, I.component_error(F.col("n")), n="ok") is None
    assert one(spark, I.component_error(F.col("n")), n="..") == "dot" and one(spark, I.component_error(F.col("n")), n="a\x00") == "nul"
    assert one(spark, I.target_ok(F.col("n")), n="../x") and not one(spark, I.target_ok(F.col("n")), n="")
    assert one(spark, I.is_under(F.col("n"), F.lit("a/b")), n="a/b/c") and not one(spark, I.is_under(F.col("n"), F.lit("a/b")), n="a/bc")
    assert one(spark, I.nested_name(F.lit("p"), F.col("n")), n="/a/./../b//c") == "p/a/b/c"
    assert one(spark, I.git_oid("blob", F.col("n")), n="hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"


@pytest.mark.parametrize(("prefix", "end"), [("ab", "ac"), ("a\U0010ffff", "b"), ("\U0010ffff", None), ("", None), ("퟿", "")])
def test_prefix_end(prefix, end):
    assert metadata.prefix_end(prefix) == end


def test_pages(spark):
    rows = spark.createDataFrame([(f"a{i:02}",) for i in range(20)] + [("b",)], "key string")
    page = metadata.prefix_page(rows, "key", "a", "a04", 5).collect()
    assert [r.key for r in page] == [f"a{i:02}" for i in range(5, 10)] and {r.has_more for r in page} == {True}
    assert {r.has_more for r in metadata.prefix_page(rows, "key", "a", "a14", 5).collect()} == {False}
    for bad in ({"limit": 0}, {"limit": 1025}, {"after": "b"}):
        with pytest.raises(ValueError):
            metadata.prefix_page(rows, "key", "a", bad.get("after"), bad.get("limit", 5))


@st.composite
def legal_directory(draw):
    """What the format allows: any bytes as names but separators, NUL and the dot names; kinds with fields of their own, null elsewhere."""
    free = lambda most, banned: st.binary(min_size=1, max_size=most).map(lambda b: bytes(c for c in b if c not in banned) or b"_")
    names = draw(st.sets(free(255, b"/\0").filter(lambda n: n not in (b".", b"..")), max_size=9))
    digest, size = st.binary(min_size=32, max_size=32), st.integers(0, (1 << 63) - 1)
    rows = []
    for name in names:
        kind = draw(st.integers(E.FILE, E.SYMLINK))
        if kind == E.SYMLINK:
            rows.append((name, kind, None, None, None, draw(free(4095, b"\0"))))
        else:
            rows.append((name, kind, draw(digest), draw(size), draw(st.booleans()) if kind == E.FILE else None, None))
    return rows


@settings(deadline=None)
@given(legal_directory(), st.randoms())
def test_directories_have_one_form(rows, rng):
    data = E.encode_directory(rows)
    shuffled = list(rows)
    rng.shuffle(shuffled)
    assert E.encode_directory(shuffled) == data
    back = E.decode_directory(data)
    assert back == sorted(rows, key=lambda r: r[0])
    if rows:
        for cut in (data[:-1], data + b"\x00", data[1:]):
            with pytest.raises(E.Malformed):
                E.decode_directory(cut)


def test_directory_frames(spark):
    rows = [(1, bytearray(b"b"), 0, bytearray(32), 5, True, None), (1, bytearray(b"a"), 2, None, None, None, bytearray(b"../x")), (2, bytearray(b"d"), 1, bytearray(32), 1, None, None)]
    df = E.encode_directories(spark.createDataFrame(rows, "dir long, name binary, tag int, child binary, size long, executable boolean, target binary"))
    df.createOrReplaceTempView("dirs")
    spark.udtf.register("directory_entries", E.DirectoryEntries)
    got = spark.sql("SELECT dir, e.* FROM dirs, LATERAL directory_entries(body) e").collect()
    assert [(r.dir, bytes(r.name)) for r in got] == [(1, b"a"), (1, b"b"), (2, b"d")] and all(r.error is None for r in got)
    bad = spark.sql("SELECT e.error FROM (SELECT X'0100') t(body), LATERAL directory_entries(body) e").first()
    assert bad.error == "truncated"


def test_linked_cids_and_git_trees(spark):
    frame = E.encode_linked([("b.v1", b"2"), ("a.v1", b"1"), ("b.v1", b"2")], b"body")
    assert E.decode_linked(frame) == ([("a.v1", b"1"), ("b.v1", b"2")], b"body")
    with pytest.raises(E.Malformed):
        E.decode_linked(frame[:-1])
    cid = E.encode_cid(0x71, 0x12, b"d" * 32)
    assert E.decode_cid(cid) == (0x71, 0x12, b"d" * 32)
    with pytest.raises(E.Malformed):
        E.decode_cid(b"\x02" + cid[1:])
    tree = b"100644 a\x00" + b"1" * 20 + b"40000 b\x00" + b"2" * 20
    assert E.parse_git_tree(tree) == [("100644", b"a", b"1" * 20), ("40000", b"b", b"2" * 20)]
    for bad in (tree[:-1], tree[28:] + tree[:28], tree.replace(b"100644", b"100600")):
        with pytest.raises(E.Malformed):
            E.parse_git_tree(bad)


def test_formats(spark):
    good = hashlib.sha256(b"a\nb").hexdigest()
    kids = sorted(hashlib.sha256(x).hexdigest() for x in (b"a", b"b"))
    rows = [("graph.blob.v1", good, "a\nb", None), ("graph.blob.v1", good, "x", None), ("graph.blob.v1", good, None, None), ("graph.lines.v1", good, "a\nb", kids), ("graph.lines.v1", good, "a\nb", kids[:1]), ("other.v1", good, "a\nb", None)]
    df = spark.createDataFrame(rows, "namespace string, native_id string, payload string, links array<string>")
    assert [r.verdict for r in formats.builtin().verify(df).collect()] == ["valid", "wrong identity", "missing payload", "valid", "wrong links", "unsupported"]
    with pytest.raises(ValueError):
        formats.builtin().add(formats.ObjectFormat("graph.blob.v1", lambda p: p))
    with pytest.raises(ValueError):
        formats.FormatRegistry(formats.ObjectFormat("Bad", lambda p: p))


@settings(deadline=None, max_examples=30)
@given(st.binary(max_size=20000), st.integers(6, 11))
def test_content_chunks(data, bits):
    average = 1 << bits
    cuts = storage._cuts(data, average)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert sum(sizes) == len(data) and all(s <= 2 * average for s in sizes) and all(s > average // 2 - 1 for s in sizes[:-1])


def test_chunks_survive_an_edit():
    import random

    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    edited = data[:100_000] + b"inserted" + data[100_000:]
    parts = lambda d: {d[a:b] for a, b in zip([0, *storage._cuts(d, 1024)], storage._cuts(d, 1024))}
    assert len(parts(data) & parts(edited)) >= 0.9 * len(parts(data))


def test_bundles():
    out = io.BytesIO()
    counts = bundle.write(out, [("r", "k1")], [("p1", b"x"), ("p2", b"")], [("k1", b"p1")])
    assert counts == {"roots": 1, "payloads": 2, "records": 1}
    data = out.getvalue()
    assert [(k, n) for k, n, _ in bundle.read(io.BytesIO(data))] == [(1, "r"), (2, "p1"), (2, "p2"), (3, "k1")]
    for bad in (data[:-1], data + b"x", data[1:], data.replace(b"p2", b"p0")):
        with pytest.raises(bundle.BundleError):
            list(bundle.read(io.BytesIO(bad)))
    with pytest.raises(bundle.BundleError):
        bundle.write(io.BytesIO(), [], [("b", b""), ("a", b"")], [])


def test_nar_round_trip():
    tree = {b"a": b"hello", b"bin": {b"x": (b"#!", True)}, b"l": ("link", b"a")}
    data = nar.pack(tree)
    assert nar.unpack(data) == [("", "directory", b""), ("a", "file", b"hello"), ("bin", "directory", b""), ("bin/x", "executable", b"#!"), ("l", "symlink", b"a")]
    # The form of a file with the content "hello", as published: 8-byte lengths, padded.
    assert nar.pack(b"hello").startswith(b"\x0d\0\0\0\0\0\0\0nix-archive-1\0\0\0\x01\0\0\0\0\0\0\0(")
    for bad in (data[:-8], data + b"\0" * 8, data.replace(b"nix", b"nax")):
        with pytest.raises(nar.NarError):
            nar.unpack(bad)


def test_sealed_packs(spark):
    rows = [("a", i, f"b{i}", size) for i, size in enumerate((5, 0, 7, 3, 3, 9))] + [(None, 1, "n", 20), ("z", 3, "b0", 5)]
    packed = storage.greedy_packs(spark.createDataFrame(rows, "source string, doc_id long, blob_id string, size long"), 10)
    sealed = storage.seal_packs(packed)
    got = {(r.source, r.pack): (r.footer, r.bytes, r.pack_id) for r in sealed.collect()}
    want = {("a", 0): "b0:0:5\nb1:5:0\nb2:5:7", ("a", 1): "b3:0:3\nb4:3:3\nb5:6:9", (None, 0): "n:0:20", ("z", 0): "b0:0:5"}
    assert {k: v[0] for k, v in got.items()} == want and got["a", 1][1] == 15
    assert all(v[2] == hashlib.sha256(v[0].encode()).hexdigest() for v in got.values())
    assert sorted((r.blob_id, r.offset, r.size) for r in storage.footer_index(sealed).collect()) == sorted((x.split(":")[0], *map(int, x.split(":")[1:])) for v in want.values() for x in v.split("\n"))
    with pytest.raises(Exception, match="isn't that of"):
        storage.footer_index(sealed.withColumn("footer", F.concat("footer", F.lit(" ")))).collect()
