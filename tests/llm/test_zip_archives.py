import hashlib
import io
import zipfile

import pytest

from merkleframe.llm import op5_zip_archives as O
from merkleframe.session import scratch


@pytest.fixture(scope="module")
def rows():
    long = "<p>payload é</p>" * 10
    out = [(i, f"http://h/{i}?q=%20x\r\ny", f"<html>{i}{'é' * (i % 90)}</html>") for i in range(50)]
    out += [(60, None, long), (55, "u", long), (57, "u", long), (70, "u", "short"), (71, "u", "short"), (72, "u", None), (73, "u", ""), (74, "u", "x" * 99), (75, "u", "x" * 99), (76, "u", "x" * 100), (77, "u", "x" * 100)]
    out += [(80, "big", "wide text\n" * 60000), (81, "a", long + "other"), (81, "b", long + "other")]
    return out


@pytest.mark.parametrize("force64", [False, True])
def test_round_trip(spark, rows, force64):
    pages = spark.createDataFrame([*rows, (None, "u", "nobody's" * 30), (None, "u", "nobody's" * 30)], "page_id long, url string, html string").repartition(3)
    packages = O.write_packages(pages, scratch(spark), force64=force64)
    read = O.read_records(O.index_ranges(packages))
    assert read.rdd.getNumPartitions() >= packages.count() > 1
    got = [r.asDict() for r in read.collect()]
    assert [(r["record_type"], r["refers_to"], r["html"]) for r in got if r["page_id"] is None] == [("response", None, "nobody's" * 30)] * 2
    got = [r for r in got if r["page_id"] is not None]
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for r in got:
        url, html = next((u, h or "") for i, u, h in rows if i == r["page_id"])
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        again = len(data) >= O.MIN_DEDUP and first[html] != r["page_id"]
        assert (r["record_type"], r["refers_to"], r["html"]) == (("revisit", first[html], None) if again else ("response", None, html))
        if r["page_id"] != 81:
            assert r["url"] == (url or "").replace("\r", "%0D").replace("\n", "%0A")


def test_rows_that_repeat_a_page_id_are_each_by_their_payload(spark):
    x, y, z = ("".join((c, "<p>some text</p>" * 10)) for c in "xyz")
    rows = [(10, "u", x), (20, "u", z), (81, "u", x), (81, "u", y), (90, "u", x), (90, "u", z)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = O.read_records(O.index_ranges(O.write_packages(pages, scratch(spark)))).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.page_id, r.payload_digest, r.refers_to or 0, r.html or "") for r in got) == sorted(
        [(10, digest(x), 0, x), (20, digest(z), 0, z), (81, digest(x), 10, ""), (81, digest(y), 0, y), (90, digest(x), 10, ""), (90, digest(z), 20, "")]
    )


def test_other_readers_agree(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = O.write_packages(pages, scratch(spark), force64=True).first()["package"]
    with O._store(path) as (fs, name), fs.open_input_file(name) as f:
        data = f.read()
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    with O._store(path) as (fs, name), fs.open_input_file(name) as f:
        members = O.central_directory(f, len(data))
    for name, (at, n) in members.items():
        assert data[at : at + n] == z.read(name)


def test_reads_archives_of_others_and_refuses_compressed_ones():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"first")
        z.writestr("dir/b", b"second" * 100)
        z.comment = b"a note PK\x05\x06 in the end"
    members = O.central_directory(buf, len(buf.getvalue()))
    assert {n: buf.getvalue()[a : a + k] for n, (a, k) in members.items()} == {"a": b"first", "dir/b": b"second" * 100}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"first" * 100)
    with pytest.raises(ValueError, match="stored"):
        O.central_directory(buf, len(buf.getvalue()))
    with pytest.raises(ValueError, match="end of a ZIP"):
        O.central_directory(io.BytesIO(b"nothing" * 10), 70)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, package string")
    assert O.read_records(O.index_ranges(O.write_packages(none, scratch(spark)))).count() == 0
