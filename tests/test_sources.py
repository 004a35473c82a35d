import hashlib
import io
import tarfile
import zlib

import pytest

from merkleframe import __main__ as cli
from merkleframe.operators.repository import Repository
from merkleframe.sources import bundle, git, importers, nar


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Six groups of six files, with six nested folders that are all alike."""
    base = tmp_path_factory.mktemp("tree")
    for g in range(6):
        (base / f"group-{g}" / "nested").mkdir(parents=True)
        for e in range(6):
            (base / f"group-{g}" / f"file-{e}").write_text(f"group {g} entry {e}")
            (base / f"group-{g}" / "nested" / f"shared-{e}").write_text(f"shared {e}")
    return base


def test_filesystem(spark, tree):
    f = importers.FilesystemImport(str(tree), "top").to_frames(spark)
    assert f.blobs.count() == 42
    assert f.entries.where("kind = 'file'").count() == 36 + 6 and f.entries.select("dir").distinct().count() == 1 + 6 + 1
    root = f.roots.first()
    assert root["name"] == "top" and f.entries.where(f.entries.dir == root["target"]).count() == 6
    assert {r["size"] for r in f.entries.where("name = 'nested'").collect()} == {6} and {r["size"] for r in f.entries.where("name LIKE 'group%'").collect()} == {13}
    again = importers.FilesystemImport(f"file://{tree}", None).to_frames(spark).roots.first()
    assert (again["name"], again["target"]) == (None, root["target"])


def test_many_roots(spark, tree):
    sources = tuple((str(tree / f"group-{g}"), f"g/{g}") for g in range(3))
    f = importers.MultiRootFilesystemImport(sources).to_frames(spark)
    assert {r["name"] for r in f.roots.collect()} == {"g/0", "g/1", "g/2"} and f.blobs.count() == 18 + 6
    with pytest.raises(ValueError):
        importers.MultiRootFilesystemImport((sources[0], sources[0])).to_frames(spark)


def add(t, name, data=None, kind=None, link=""):
    m = tarfile.TarInfo(name)
    m.type = kind or tarfile.REGTYPE
    m.linkname, m.size = link, len(data or b"")
    t.addfile(m, io.BytesIO(data or b""))


def test_tar(spark, tmp_path):
    path = tmp_path / "a.tar"
    with tarfile.open(path, "w") as t:
        add(t, "./d/", kind=tarfile.DIRTYPE)
        add(t, "d/a", b"content")
        add(t, "d/hard", kind=tarfile.LNKTYPE, link="./d/a")
        add(t, "d/again", kind=tarfile.LNKTYPE, link="d/hard")
        add(t, "implicit/parent/b", b"other")
        add(t, "d/sym", kind=tarfile.SYMTYPE, link="../x")
    f = importers.TarImport(str(path), "t").to_frames(spark)
    assert f.blobs.count() == 2 and {r["name"] for r in f.entries.collect()} == {"d", "a", "hard", "again", "implicit", "parent", "b", "sym"}
    for name, kind, link in (("../x", None, ""), ("/x", None, ""), ("l", tarfile.LNKTYPE, "nowhere")):
        with tarfile.open(tmp_path / "bad.tar", "w") as t:
            add(t, name, b"" if kind is None else None, kind, link)
        with pytest.raises(Exception, match="path|hard link"):
            importers.TarImport(str(tmp_path / "bad.tar"), "t").to_frames(spark)


def listing(frames):
    """(path, kind, blob, executable, target) of a tree, walked from its only root."""
    rows = frames.entries.collect()
    out, todo = set(), [("", frames.roots.first()["target"])]
    while todo:
        path, key = todo.pop()
        for r in rows:
            if r["dir"] == key:
                name = f"{path}/{r['name']}".lstrip("/")
                out.add((name, r["kind"], r["child"] if r["kind"] == "file" else None, r["executable"], r["target"]))
                if r["kind"] == "directory":
                    todo.append((name, r["child"]))
    return out


def test_whole_trees_by_every_importer(spark, tmp_path):
    base = tmp_path / "whole"
    (base / "d" / "bare").mkdir(parents=True)
    (base / "d" / "run").write_bytes(b"#!/bin/sh\n")
    (base / "d" / "run").chmod(0o755)
    (base / "d" / "plain").write_bytes(b"#!/bin/sh\n")
    (base / "d" / "loop").symlink_to("../d")
    (base / "gone").symlink_to("/nowhere at all")
    with tarfile.open(tmp_path / "whole.tar", "w") as t:
        t.add(base, arcname=".")
    (tmp_path / "whole.nar").write_bytes(nar.pack({b"d": {b"bare": {}, b"run": (b"#!/bin/sh\n", True), b"plain": b"#!/bin/sh\n", b"loop": ("link", b"../d")}, b"gone": ("link", b"/nowhere at all")}))
    digest = hashlib.sha256(b"#!/bin/sh\n").hexdigest()
    want = {
        ("d", "directory", None, None, None), ("d/bare", "directory", None, None, None), ("d/run", "file", digest, True, None), ("d/plain", "file", digest, False, None),
        ("d/loop", "symlink", None, None, "../d"), ("gone", "symlink", None, None, "/nowhere at all"),
    }
    frames = [importers.FilesystemImport(str(base), "w"), importers.TarImport(str(tmp_path / "whole.tar"), "w"), importers.NarImport(str(tmp_path / "whole.nar"), "w")]
    frames = [f.to_frames(spark) for f in frames]
    for f in frames:
        assert listing(f) == want and f.blobs.count() == 1
    assert len({f.roots.first()["target"] for f in frames}) == 1
    assert frames[0].objects().where("size(links) = 0 AND payload_size = 0").count() == 1
    keys = {r["key"]: r["links"] for r in frames[0].objects().collect()}
    assert len(keys) == 4 and all(x in keys for links in keys.values() for x in links)
    # Each of these makes another tree.
    ids = {frames[0].roots.first()["target"]}
    for change in ((base / "d" / "run").chmod, (base / "d" / "bare").rmdir, (base / "gone").unlink):
        change(*((0o644,) if change.__name__ == "chmod" else ()))
        ids.add(importers.FilesystemImport(str(base), "w").to_frames(spark).roots.first()["target"])
    assert len(ids) == 4


def test_trees_that_are_bare_or_cannot_be(spark, tmp_path):
    (tmp_path / "bare").mkdir()
    f = importers.FilesystemImport(f"file://{tmp_path}/bare", "b").to_frames(spark)
    assert f.roots.first()["target"] == importers.EMPTY and f.entries.count() == 0 and f.objects().count() == 1
    schema = "root string, path string, blob_id string, size long, kind string, target string"
    for rows in ([("0", "a", "x", 1, "file", None), ("0", "a/b", "y", 1, "file", None)], [("0", "a", None, 0, "symlink", "")], [("0", "a", "x", 1, "file", None), ("0", "a", "y", 1, "file", None)], [("0", "a", None, 0, "fifo", None)]):
        with pytest.raises(ValueError):
            importers.build_tree(spark.createDataFrame(rows, schema), None, spark)


def test_git(spark, tmp_path):
    base = tmp_path / "g" / ".git"

    def put(kind, body):
        data = f"{kind} {len(body)}\x00".encode() + body
        oid = hashlib.sha1(data).hexdigest()
        (base / "objects" / oid[:2]).mkdir(parents=True, exist_ok=True)
        (base / "objects" / oid[:2] / oid[2:]).write_bytes(zlib.compress(data))
        return oid

    blob = put("blob", b"hello\n")
    top = put("tree", b"100644 a\x00" + bytes.fromhex(blob) + b"160000 sub\x00" + b"s" * 20)
    commit = put("commit", f"tree {top}\nauthor a <a> 0 +0000\n\nparent of nothing\n".encode())
    (base / "refs/heads").mkdir(parents=True)
    (base / "refs/heads/main").write_text(commit + "\n")
    (base / "HEAD").write_text("ref: refs/heads/main\n")
    got = {r.oid: (r.kind, list(r.links)) for r in git.read_loose(spark, str(base)).collect()}
    assert got == {blob: ("blob", []), top: ("tree", [blob]), commit: ("commit", [top])}
    assert {(r.name, r.target, r.symbolic) for r in git.read_refs(spark, str(base)).collect()} == {("HEAD", "refs/heads/main", True), ("refs/heads/main", commit, False)}


def test_nar_measurements(spark):
    files = spark.createDataFrame([("t1", "a", b"x"), ("t1", "d/b", b"y"), ("t2", "a", b"x")], "tree string, path string, content binary")
    got = {r.key: (r.nar_sha256, r.nar_size) for r in nar.measure(files, "tree").collect()}
    want = {"t1": nar.pack({b"a": b"x", b"d": {b"b": b"y"}}), "t2": nar.pack({b"a": b"x"})}
    assert got == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in want.items()}
    facts = spark.createDataFrame([("t1", "known", 1)], "key string, nar_sha256 string, nar_size long")
    asked = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "key string")
    assert {r.key: r.nar_sha256 for r in nar.report(asked, facts, files, "tree").collect()} == {"t1": "known", "t2": got["t2"][0], "t3": None}


def test_exported_bundle(spark, tmp_path):
    plan = spark.createDataFrame([(2, "p1", b"x"), (2, "p2", b"y"), (3, "k1", b"p1"), (3, "k2", b"p3")], "section int, id string, body binary")
    bundle.export(plan, f"file://{tmp_path}/b")
    assert {(r.side, r.key) for r in bundle.membership(spark, f"file://{tmp_path}/b").collect()} == {("missing", "p3"), ("extra", "p2")}


def test_command_line(spark, tree, tmp_path, capsys):
    repo = f"file://{tmp_path}/repo"
    assert cli.main(["import", repo, str(tree), "top"]) == 0
    assert cli.main(["roots", repo]) == 0 and capsys.readouterr().out.startswith("top ")
    assert Repository(spark, repo).snapshot().objects.count() == 42 + 8
    assert cli.main(["gc", repo]) == 0 and capsys.readouterr().out.strip() == "0"
    assert cli.main(["vacuum", repo]) == 0 and cli.main(["query", "nothing", "/tmp"]) == 2
    assert cli.main(["queries"]) == 0 and "fsck_findings" in capsys.readouterr().out

