"""One document read by many tasks: byte ranges of CSV files and JSON arrays."""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.sources import ranges as G
from evalframe.sources import readers as R


def by_ranges(fmt, data: bytes, size: int) -> list[tuple[int, bytes]]:
    """As the passes do, without Spark: states from summaries, then records."""
    f, out, state, depth = io.BytesIO(data), [], 0, 0
    for begin in range(0, len(data), size):
        end = min(len(data), begin + size)
        out += fmt.records(f, begin, end, state, depth, fmt.base(data))
        effect = fmt.effects(G._blocks(f, begin, end))[state]
        state, depth = effect[0], depth + effect[1]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_json_records_whatever_the_ranges(seed, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 7)
    rng = random.Random(seed)

    def value(depth=0):
        kind = rng.randint(0, 5) if depth < 3 else rng.randint(0, 3)
        if kind == 2:
            return "".join(rng.choices('ab"\\[]{},:é\n ', k=rng.randint(0, 12)))
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        if kind == 5:
            return {str(i): value(depth + 1) for i in range(rng.randint(0, 3))}
        return rng.choice([None, True, -1.5e3, 7])

    records = [{"x": value(), "y": value()} for _ in range(rng.randint(0, 6))]
    data = json.dumps(records, ensure_ascii=False, indent=rng.choice([None, 2])).encode()
    if len(records) == 1 and seed % 2:
        data = json.dumps(records[0]).encode()  # a document that is its only record
    for size in (1, 2, 3, 5, 11, 64, 1000):
        found = by_ranges(G.Json, data, size)
        assert [json.loads(r) for _, r in found] == records
        assert all(data[at:at + len(r)] == r for at, r in found)


@pytest.mark.parametrize("seed", range(60))
def test_csv_records_whatever_the_ranges(seed, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 7)
    rng = random.Random(seed)
    rows = [["".join(rng.choices('ab",\n\r é', k=rng.randint(0, 8))) or "z" for _ in range(3)] for _ in range(rng.randint(1, 8))]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
    data = out.getvalue().encode()
    data = data.rstrip(b"\r\n") if seed % 3 == 0 else data + b"\n\n" if seed % 3 == 1 else data
    for size in (1, 2, 3, 5, 11, 64, 1000):
        found = by_ranges(G.Csv, data, size)
        assert [next(csv.reader(io.StringIO(r.decode(), newline=""))) for _, r in found] == rows


@pytest.mark.parametrize("text", ["[1, 2]", '["a"]', '[{"a": 1}, null]', '[[{"a": 1}]]', '[{"a": "open', '[{"a": 1', '[{"a": 1} {"b": 2} x]'])
def test_documents_that_hold_no_records_fail(text):
    with pytest.raises(ValueError):
        by_ranges(G.Json, text.encode(), 1000)


SCHEMA = "id long, text string, tags array<string>, note string"
CSV_SCHEMA = "id long, text string, note string"


@pytest.fixture()
def rows():
    rng = random.Random(0)
    return [{"id": i, "text": "".join(rng.choices(['line\n', '"quoted"', "a, b", "é\\", "[{", "}]", " "], k=rng.randint(0, 60))) + ".",
             "tags": [f"t{i}"] * (i % 3), "note": None if i % 5 else f"n{i}"} for i in range(3_000)]


def test_one_json_document_by_many_tasks(spark, tmp_dir, rows):
    path = os.path.join(tmp_dir, "all.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False)
    got = R.read_json_array(spark, path, SCHEMA)
    assert sorted((r.asDict() for r in got.collect()), key=lambda r: r["id"]) == rows
    assert sum(n > 0 for n in [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]) > 3
    whole = R.read_json_array(spark, path, SCHEMA, split=False)
    assert got.exceptAll(whole).count() == whole.exceptAll(got).count() == 0


@pytest.mark.parametrize("sep", [",", "\t"])
def test_one_csv_file_by_many_tasks(spark, tmp_dir, rows, sep):
    path = os.path.join(tmp_dir, "all.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n")  # a blank line before the header
        out = csv.writer(f, delimiter=sep, lineterminator="\n")
        out.writerow(["id", "text", "note"])
        out.writerows([r["id"], r["text"], r["note"]] for r in rows)
    got = R.read_delimited(spark, path, CSV_SCHEMA, sep, multi_line=True)
    back = {r["id"]: (r["text"], r["note"]) for r in got.collect()}
    assert back == {r["id"]: (r["text"], r["note"]) for r in rows}
    assert len([r for r in got.groupBy(F.spark_partition_id()).count().collect()]) > 3
    whole = R.read_delimited(spark, path, CSV_SCHEMA, sep, multi_line=True, split=False)
    assert got.exceptAll(whole).count() == whole.exceptAll(got).count() == 0


def test_folders_globs_compressed_and_empty_files(spark, tmp_dir, rows):
    folder = os.path.join(tmp_dir, "many.json")
    os.makedirs(folder)
    for n, part in enumerate((rows[:1_000], rows[1_000:], [])):
        with open(f"{folder}/{n}.json", "w", encoding="utf-8") as f:
            json.dump(part, f)
    for name in ("_SUCCESS", ".hidden", "empty.json"):
        open(f"{folder}/{name}", "w").close()
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(R.read_json_array(spark, folder, SCHEMA)) == ids(R.read_json_array(spark, [f"{folder}/0.json", f"{folder}/1.json"], SCHEMA)) == list(range(3_000))
    assert ids(R.read_json_array(spark, f"{folder}/[01].json", SCHEMA)) == list(range(3_000))
    with gzip.open(os.path.join(tmp_dir, "x.json.gz"), "wt", encoding="utf-8") as f:
        json.dump(rows[:5], f)
    assert ids(R.read_json_array(spark, os.path.join(tmp_dir, "x.json.gz"), SCHEMA)) == list(range(5))


def test_malformed_records_fail(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.json")
    with open(path, "w") as f:
        f.write('[{"id": 1}, {"id": nothing}]')
    with pytest.raises(Exception):
        R.read_json_array(spark, path, T.StructType.fromDDL(SCHEMA)).collect()
