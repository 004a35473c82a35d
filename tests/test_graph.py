import random

import pytest

from merkleframe.operators import graph
from merkleframe.operators.repository import Conflict, ImmutableConflict, IncompleteClosure, Repository, RevisionChanged

#: Small graphs that share nodes: root -> its nodes -> what they link to.
GRAPHS = [
    {10: [1, 2], 1: [3], 2: [], 3: []},
    {11: [1, 4], 1: [3], 3: [], 4: []},
    {12: [2, 5], 2: [], 5: []},
    {13: [6, 7], 6: [], 7: []},
]
OBJECTS = "key string, payload string, payload_size long, links array<string>"


def objects(spark, g):
    return spark.createDataFrame([(f"n{k}", f"p{k}", 1, [f"n{x}" for x in v]) for k, v in g.items()], OBJECTS)


def links(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_reach_has_cycles_and_leaves(spark):
    e = links(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")])
    assert {(r.key, r.depth) for r in graph.reach(keys(spark, "a"), e).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.key for r in graph.reach(keys(spark, "a", "x"), e, stop=keys(spark, "b")).collect()} == {"a", "b", "x", "y"}
    with pytest.raises(graph.LimitExceeded):
        graph.reach(keys(spark, "a"), e, max_objects=3)


def test_statuses_and_first_gap(spark):
    e = links(spark, [("r", "a"), ("r", "b"), ("a", "z"), ("b", "a1"), ("s", "c"), ("t", "r")])
    o = keys(spark, "r", "a", "b", "s", "c", "t")
    got = {r.root: (r.status, r.objects) for r in graph.closure_status(keys(spark, "r", "s", "gone"), e, o).collect()}
    assert got == {"r": ("Incomplete", None), "s": ("Complete", 2), "gone": ("Missing", None)}
    # Breadth first: a is before b, so its gap is met first, though a1 sorts before z.
    assert {(r.root, r.from_key, r.missing_key) for r in graph.first_missing(keys(spark, "r", "t", "s"), e, o).collect()} == {("r", "a", "z"), ("t", "a", "z")}


def test_symbolic_refs(spark):
    refs = spark.createDataFrame([("HEAD", "main", True), ("main", "oid", False), ("x", "y", True), ("y", "x", True), ("lost", "none", True), ("z", "x", True), *((f"c{i}", f"c{i + 1}", True) for i in range(40))], "name string, target string, symbolic boolean")
    got = {r.name: (r.target, r.hops, r.error) for r in graph.resolve_symbolic(refs).collect()}
    want = {"HEAD": ("oid", 1, None), "main": ("oid", 0, None), "x": (None, 1, "cycle"), "y": (None, 1, "cycle"), "z": (None, 2, "cycle"), "lost": (None, 1, "missing")}
    assert {k: v for k, v in got.items() if k[0] != "c"} == want
    assert got["c20"] == (None, 20, "missing") and got["c8"] == (None, 32, "missing") and got["c7"] == (None, 32, "too many hops")


@pytest.mark.parametrize("seed", range(3))
def test_collection_keeps_the_union_of_closures(spark, tmp_path, seed):
    rng = random.Random(seed)
    repo, roots = Repository(spark, f"file://{tmp_path}/repo"), {}
    for _ in range(7):
        op = rng.choice(["set", "set", "set", "remove", "collect", "collect"])
        name, g = f"model/{rng.randrange(3)}", GRAPHS[rng.randrange(4)]
        if op == "collect":
            repo.collect()
            continue
        s = repo.session()
        if op == "set":
            s.stage(objects(spark, g))
            s.set_root(name, f"n{max(g)}")
            roots[name] = g
        else:
            s.remove_root(name)
            roots.pop(name, None)
        repo.publish(s)
    after, _ = repo.collect()
    want = {f"n{k}" for g in roots.values() for k in g}
    assert {r["key"] for r in after.objects.collect()} == want
    assert {r["payload"] for r in after.objects.collect()} == {k.replace("n", "p") for k in want}


def test_set_remove_remove(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    s = repo.session()
    s.stage(objects(spark, GRAPHS[0]))
    s.set_root("model/0", "n10")
    repo.publish(s)
    for _ in range(2):
        s = repo.session()
        s.remove_root("model/0")
        repo.publish(s)
    assert repo.collect()[1] == 4 and repo.snapshot().objects.count() == 0


def test_publication(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    s, stale = repo.session(), repo.session()
    s.stage(objects(spark, GRAPHS[0]))
    s.set_root("a/b", "n10")
    first = repo.publish(s)
    assert first.generation == 1 and {r.validated for r in first.objects.collect()} == {True}
    with pytest.raises(RevisionChanged):
        repo.publish(stale)
    again = repo.session()
    again.stage(objects(spark, GRAPHS[1]))
    second = repo.publish(again, expect_roots={"a/b": "n10", "none": None})
    assert {r["key"]: r.created_generation for r in second.objects.collect()} == {"n10": 1, "n1": 1, "n2": 1, "n3": 1, "n11": 2, "n4": 2}
    with pytest.raises(Conflict) as e:
        repo.publish(repo.session(), expect_roots={"a/b": "n10", "x": "n1"})
    assert e.value.index == 1
    other = repo.session()
    other.stage(spark.createDataFrame([("n1", "other", 1, ["n3"])], OBJECTS))
    with pytest.raises(ImmutableConflict):
        repo.publish(other)
    gap = repo.session()
    gap.stage(spark.createDataFrame([("top", "p", 1, ["nowhere"])], OBJECTS))
    gap.set_root("c", "top")
    with pytest.raises(IncompleteClosure):
        repo.publish(gap)
    assert repo.snapshot().revision == second.revision


def test_retention_and_snapshots(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    s = repo.session()
    for g in GRAPHS[:3]:
        s.stage(objects(spark, g))
        s.set_root(f"r/{max(g)}", f"n{max(g)}")
    s.set_retention("r/10", 5)
    s.set_retention("r/11", 4)
    repo.publish(s)
    held = repo.hold()
    assert repo.evict_next_root() == "r/11" and repo.evict_next_root() == "r/10" and repo.evict_next_root() is None
    after, gone = repo.collect(pins=keys(spark, "n11", "absent"))
    assert {r["key"] for r in after.objects.collect()} == {"n12", "n2", "n5", "n11", "n1", "n3", "n4"} and gone == 1
    s = repo.session()
    s.remove_roots_under("r")
    repo.publish(s)
    assert repo.vacuum() >= 2 and held.objects.count() == 8 and repo.snapshot().roots.count() == 0
    repo.release(held)
    assert repo.vacuum() == 1


def test_discarded_tables_are_gone(spark):
    from merkleframe.session import discard, written

    df = written(spark.range(10))
    files = df.inputFiles()
    discard(df)
    assert files and not any(spark._jvm.java.io.File(f.removeprefix("file://")).exists() for f in files)
    with pytest.raises(ValueError, match="written table"):
        discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_publications_race_and_crash(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/repo"
    one, two = Repository(spark, path), Repository(spark, path)
    assert one.snapshot().revision == two.snapshot().revision and one.snapshot().generation == 0
    # Both have seen the same revision, and only the first pointer counts.
    tables = {"objects": one.snapshot().objects, "roots": one.snapshot().roots, "policy": one.snapshot().policy}
    won = one._write(tables, 1)
    with pytest.raises(RevisionChanged):
        two._write(tables, 1)
    assert two.snapshot().revision == won.revision and len(list((tmp_path / "repo/snapshots").iterdir())) == 2
    # A crash at each step of a publication leaves the last one current, and the next goes through.
    for step in ("create", "_named"):
        repo = Repository(spark, path)
        with monkeypatch.context() as m:

            def crash(*_):
                raise OSError(step)

            if step == "_named":
                m.setattr(repo, "_named", crash)
            else:
                m.setattr(repo, "_p", lambda x, p=repo._p: crash() if "/pointers/." in x else p(x))
            with pytest.raises(OSError, match=step):
                repo._write(tables, 2)
        assert Repository(spark, path).snapshot().revision == won.revision
    assert Repository(spark, path)._write(tables, 2).generation == 2
    # What no pointer names stays while it may be under way.
    assert one.vacuum() == 2 and one.vacuum() == 0 and one.vacuum(abandoned=-60) == 2
    assert one.snapshot().objects.count() == 0
