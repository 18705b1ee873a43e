"""The partitioned asset listing: prefixes, pushed filters, contents."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from evalframe.operators import assets as A
from evalframe.sources import asset_listing as L


@pytest.fixture()
def root(tmp_dir):
    """Nested prefixes of uneven depth, an empty directory, files beside
    directories, a name that is a prefix of another."""
    for path, content in (("top.jpg", b"t"), ("a/1.jpg", b"a1"), ("a/2.txt", b"a2"), ("a/deep/er/still/3.jpg", b"a3"), ("ab/4.jpg", b"ab4"),
                          ("b/x/5.jpg", b"b5"), ("b/x/6.jpg", b""), ("b/y/7.jpg", b"b7"), ("c d/ü é/8.jpg", b"8")):
        full = os.path.join(tmp_dir, "store", path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content)
    os.makedirs(os.path.join(tmp_dir, "store", "empty"))
    return os.path.join(tmp_dir, "store")


def walked(root: str) -> dict[str, int]:
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs}


@pytest.mark.parametrize("prefixes", [1, 3, 5, 1000])
@pytest.mark.parametrize("probe", [L.PROBE, 2])
def test_every_file_once_whatever_the_prefixes(root, monkeypatch, prefixes, probe):
    monkeypatch.setattr(L, "PROBE", probe)
    reader = L.AssetReader(root, prefixes, None)
    parts = reader.partitions()
    assert len(parts) <= 4 * prefixes
    found = [row for p in parts for batch in reader.read(p) for row in batch.to_pylist()]
    assert {r["path"]: r["length"] for r in found} == walked(root) and len(found) == 9
    assert all(r["name"] == os.path.basename(r["path"]) for r in found)


def test_on_spark(spark, root):
    df = L.list_assets(spark, "file:" + root + "/")
    assert {r["path"]: r["length"] for r in df.collect()} == walked(root)
    assert df.where(F.col("modified") > "2020-01-01").count() == 9
    assert L.list_assets(spark, root, glob="*.jpg").count() == 8
    # the number of partitions shows what was planned: fewer with a filter
    below = df.where(F.col("path").startswith(root + "/b/"))
    assert below.count() == 3 and below.rdd.getNumPartitions() < df.rdd.getNumPartitions()


@pytest.mark.parametrize("filters, opened", [
    ([StringStartsWith(("path",), "{}/a/")], {"", "a", "a/deep", "a/deep/er", "a/deep/er/still"}),
    ([StringStartsWith(("path",), "{}/a")], {"", "a", "a/deep", "a/deep/er", "a/deep/er/still", "ab"}),
    ([EqualTo(("path",), "{}/b/x/5.jpg")], {"", "b", "b/x"}),
    ([In(("path",), ("{}/b/x/5.jpg", "{}/top.jpg")), StringStartsWith(("path",), "{}/t")], {""}),
    ([EqualTo(("name",), "7.jpg")], {"", "a", "a/deep", "a/deep/er", "a/deep/er/still", "ab", "b", "b/x", "b/y", "c d", "c d/ü é", "empty"}),
])
def test_filters_leave_directories_out(root, monkeypatch, filters, opened):
    looked: set[str] = set()
    entries = L.LocalStore.entries
    monkeypatch.setattr(L.LocalStore, "entries", staticmethod(lambda d: looked.add(os.path.relpath(d, root)) or entries(d)))
    placed = []
    for f in filters:
        value = tuple(v.format(root) for v in f.value) if isinstance(f, In) else f.value.format(root)
        placed.append(type(f)(f.attribute, value))
    reader = L.AssetReader(root, 1000, None)
    assert list(reader.pushFilters(placed)) == placed  # Spark applies them as well
    found = {r["path"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()}
    assert {x if x != "." else "" for x in looked} == opened

    def holds(path: str) -> bool:
        tests = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v)}
        return all(tests[type(f)](path if f.attribute == ("path",) else os.path.basename(path), f.value) for f in placed)
    assert found == {p for p in walked(root) if holds(p)}


def test_contents_are_read(spark, root):
    files = spark.createDataFrame([(i, p) for i, p in enumerate([*sorted(walked(root)), root + "/gone.jpg", None])], "n int, path string")
    got = {r["path"]: r["content"] for r in L.with_content(files, root).collect()}
    assert got.pop(None) is None and got.pop(root + "/gone.jpg") is None
    assert {p: bytes(c) for p, c in got.items()} == {p: open(p, "rb").read() for p in walked(root)}
    listed = A.read_assets(spark, root)
    assert listed.columns == ["path", "length", "content"] and all(len(r["content"]) == r["length"] for r in listed.collect())


def test_written_files_are_whole(spark, tmp_dir):
    out = os.path.join(tmp_dir, "written")
    rows = [(f"{out}/{i % 3}/{i}.bin", bytes([i]) * i) for i in range(20)] + [(None, b"x"), (f"{out}/none", None)]
    frame = spark.createDataFrame(rows, "path string, content binary")
    for _ in range(2):  # again: as a task that is run twice
        L.write_files(frame, out)
    assert {p: open(p, "rb").read() for p in walked(out)} == dict(rows[:20])


def test_missing_root_fails_when_planned(spark, tmp_dir):
    with pytest.raises(Exception, match="No such file"):
        L.list_assets(spark, tmp_dir + "/nothing").count()


def test_counts_of_missing_files(spark, root):
    """One path several times, in several items and in one; null references,
    empty and null lists, URLs, null ids."""
    items = spark.createDataFrame([(1, ["a/1.jpg", "x.jpg", "x.jpg", None, "https://h/x.jpg"]), (2, ["x.jpg"]), (3, []), (4, None),
                                   (5, [None]), (None, ["y.jpg", "b/x/6.jpg"])], "id int, images array<string>")
    got = {r["id"]: r for r in A.resolve_assets(items, A.read_assets(spark, root, with_content=False), "id", "images", root).collect()}
    assert {k: r["n_missing"] for k, r in got.items()} == {1: 2, 2: 1, 3: 0, 4: 0, 5: 0, None: 1}
    assert got[1]["resolved_images"] == [f"{root}/a/1.jpg", f"{root}/x.jpg", f"{root}/x.jpg", "https://h/x.jpg"]
