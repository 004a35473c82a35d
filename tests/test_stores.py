import hashlib

import pytest

from merkleframe.operators import stores
from merkleframe.operators.order import numbered, running_total
from merkleframe.sources import bundle, importers, nar
from merkleframe.streaming.state import StateLog, follow


def rows(spark, *texts):
    return spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), bytearray(t.encode())) for t in texts], stores.SCHEMA)


@pytest.fixture(params=["parquet", "memory", "tiered", "repairing"])
def store(request, spark, tmp_path):
    if request.param == "parquet":
        return stores.ParquetStore(spark, f"file://{tmp_path}/s")
    if request.param == "memory":
        return stores.MemoryStore(spark)
    near, far = stores.MemoryStore(spark), stores.ParquetStore(spark, f"file://{tmp_path}/far")
    return (stores.TieredStore if request.param == "tiered" else stores.RepairingStore)(near, far)


def test_contract(spark, store):
    """What every backend must do."""
    assert store.blobs().count() == 0
    assert store.put(rows(spark, "a", "b", "a")) == 2 and store.put(rows(spark, "b", "c")) == 1
    assert {bytes(r.content) for r in store.blobs().collect()} == {b"a", b"b", b"c"}
    asked = rows(spark, "c", "x", "c").select("blob_id").coalesce(1)
    from pyspark.sql import functions as F

    asked = asked.withColumn("ordinal", F.monotonically_increasing_id())
    assert [r.present for r in stores.has_batch(store, asked).orderBy("ordinal").collect()] == [True, False, True]


def test_tiers_and_repair(spark, tmp_path):
    near, far = stores.MemoryStore(spark), stores.ParquetStore(spark, f"file://{tmp_path}/far")
    far.put(rows(spark, "f", "both"))
    tiered = stores.TieredStore(near, far)
    assert tiered.put(rows(spark, "n", "f")) == 1 and tiered.blobs().count() == 3
    good = hashlib.sha256(b"both").hexdigest()
    near.put(spark.createDataFrame([(good, bytearray(b"broken")), ("0" * 64, bytearray(b"lost"))], stores.SCHEMA))
    assert {bytes(r.content) for r in stores.RepairingStore(near, far).blobs().collect()} == {b"n", b"both"}
    assert [bytes(r.content) for r in far.get([good]).collect()] == [b"both"]


def test_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 5 AS v").repartition(5)
    assert {r.k: r.n for r in numbered(df, ["k"], "n", 3).collect()} == {k: k + 3 for k in range(1000)}
    value = {r.k: r.v for r in df.collect()}
    total, want = 0, {}
    for k in range(1000):
        total += value[k]
        want[k] = total
    assert {r.k: r.t for r in running_total(df, ["k"], "v", "t").collect()} == want
    assert numbered(df.where("k < 0"), ["k"], "n").count() == 0


def test_state_log(spark, tmp_path):
    path, expected = f"file://{tmp_path}/events", {}
    log = StateLog(spark, f"file://{tmp_path}/state", ["k"], "seq", ["v"], checkpoint_every=3)
    assert log.read() is None
    seq = 0
    for part in range(8):
        batch = []
        for i in range(20):
            batch.append(((i * 7 + part) % 11, seq, f"v{seq}"))
            expected[(i * 7 + part) % 11] = f"v{seq}"
            seq += 1
        spark.createDataFrame(batch, "k long, seq long, v string").coalesce(1).write.mode("append").parquet(path)
        if part in (2, 7):
            follow(log, path, files_per_batch=1)
            assert {r.k: r.v for r in log.read().collect()} == expected
    assert len(log._epochs("checkpoint")) == 2
    assert log.prune() > 0 and {r.k: r.v for r in log.read().collect()} == expected
    # An epoch that is run again changes nothing.
    log.upsert(spark.createDataFrame([(1, 0, "old")], "k long, seq long, v string"), 8)
    assert {r.k: r.v for r in log.read().collect()} == expected


def test_nar_and_bundle_imports(spark, tmp_path):
    (tmp_path / "t.nar").write_bytes(nar.pack({b"d": {b"a": b"x", b"b": (b"y", True)}, b"l": ("link", b"d/a")}))
    f = importers.NarImport(str(tmp_path / "t.nar"), "n").to_frames(spark)
    assert {(r["name"], r["kind"]) for r in f.entries.collect()} == {("d", "directory"), ("a", "file"), ("b", "file"), ("l", "symlink")} and f.roots.first()["name"] == "n"
    plan = spark.createDataFrame([(1, "r", b"k1"), (2, "p1", b"x"), (3, "k1", b"p1")], "section int, id string, body binary")
    bundle.export(plan, f"file://{tmp_path}/good")
    f = importers.BundleImport(f"file://{tmp_path}/good").to_frames(spark)
    assert (f.roots.first()["target"], f.blobs.first()["size"]) == ("k1", 1)
    bundle.export(plan.where("section <> 2"), f"file://{tmp_path}/bad")
    with pytest.raises(bundle.BundleError):
        importers.BundleImport(f"file://{tmp_path}/bad").to_frames(spark)


def test_detection(tmp_path):
    import io
    import tarfile

    (tmp_path / "plain").mkdir()
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.addfile(tarfile.TarInfo("x"), io.BytesIO())
    (tmp_path / "b.nar").write_bytes(nar.pack(b"x"))
    with (tmp_path / "c.bundle").open("wb") as f:
        bundle.write(f, [], [], [])
    (tmp_path / "d").write_bytes(b"nothing")
    assert [importers.detect(str(tmp_path / n)) for n in ("plain", "repo", "a.tar", "b.nar", "c.bundle")] == ["filesystem", "git", "tar", "nar", "bundle"]
    with pytest.raises(ValueError):
        importers.detect(str(tmp_path / "d"))
