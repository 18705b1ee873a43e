"""Assets (E1-E4, A8, J5) and file sources / sinks."""

from __future__ import annotations

import base64
import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions import assets as E
from evalframe.operators import assets as A
from evalframe.sinks import writers as W
from evalframe.sources import readers as R


def test_is_url_and_resolve_path(spark):
    rows = [("http://example.com/image.jpg", "/base"), ("/path/to/image.jpg", "/base"), ("rel/a.jpg", "/base/"),
            ("rel/a.jpg", ""), ("HTTP://x", "b"), ("rel/a.jpg", "/"), ("./x/./y/", "d//e"), ("x/../y", "/b/./c")]
    df = spark.createDataFrame(rows, "p string, b string")
    out = df.select(E.is_url("p").alias("u"), E.resolve_path("b", "p").alias("r")).collect()
    assert [r["u"] for r in out] == [True] + [False] * 7
    for (p, b), r in zip(rows, out):
        if not p.startswith("http"):
            assert r["r"] == str(pathlib.PurePosixPath(b) / p)


def test_data_url_has_no_line_breaks(spark):
    payload = bytes(range(256)) * 4
    df = spark.createDataFrame([(bytearray(payload),)], "c binary")
    got = df.select(E.data_url("c")).collect()[0][0]
    assert got == "data:image/jpeg;base64," + base64.b64encode(payload).decode()


def test_binary_file_assets_and_resolution(spark, tmp_dir):
    root = os.path.join(tmp_dir, "assets")
    os.makedirs(os.path.join(root, "img"))
    for name in ("a.jpg", "b.jpg"):
        with open(os.path.join(root, "img", name), "wb") as f:
            f.write(name.encode() * 10)
    files = A.read_assets(spark, root, glob="*.jpg")
    assert sorted(r["length"] for r in files.collect()) == [50, 50]
    items = spark.createDataFrame([(1, ["img/a.jpg", "img/missing.jpg", "http://x/y.png"]), (2, None), (3, ["img/b.jpg"])],
                                  "id int, images array<string>")
    res = {r["id"]: r for r in A.resolve_assets(items, files, "id", "images", root).collect()}
    assert res[1]["resolved_images"] == [f"{root}/img/a.jpg", f"{root}/img/missing.jpg", "http://x/y.png"]
    assert res[1]["n_missing"] == 1 and res[2]["n_missing"] == 0 and res[2]["resolved_images"] == []
    refs = A.explode_refs(items, "id", "images", root)
    missing = A.missing_assets(refs, files).select("path").collect()
    assert [r[0] for r in missing] == [f"{root}/img/missing.jpg"]
    urls = A.attach_data_urls(refs.where(F.col("id") == 3), files).collect()
    assert urls[0]["data_url"] == "data:image/jpeg;base64," + base64.b64encode(b"b.jpg" * 10).decode()


SCHEMA = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("object", T.StringType()),
                       T.StructField("correct_ids", T.ArrayType(T.IntegerType())), T.StructField("note", T.StringType())])
ROWS = [{"image_id": "007", "object": "皿", "correct_ids": [0], "note": None},
        {"image_id": "8", "object": 'a "quoted"\nline', "correct_ids": [], "note": "NA"}]


def test_jsonl_roundtrip_and_schema(spark, tmp_dir):
    src = os.path.join(tmp_dir, "items.jsonl")
    with open(src, "w", encoding="utf-8") as f:
        for r in ROWS:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
        f.write("\n")  # blank line: skipped
    df = R.read_dataset(spark, src, SCHEMA)
    assert [r.asDict() for r in df.collect()] == ROWS  # "007" stays text
    out = os.path.join(tmp_dir, "out.jsonl")
    W.write_jsonl(df, out)
    text = "".join(open(os.path.join(out, p), encoding="utf-8").read() for p in sorted(os.listdir(out)) if p.endswith(".json"))
    assert '"note":null' in text and "皿" in text


def test_bad_jsonl_line_fails(spark, tmp_dir):
    src = os.path.join(tmp_dir, "bad.jsonl")
    with open(src, "w") as f:
        f.write('{"image_id": "1"}\n{not json\n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, src, SCHEMA).collect()


def test_json_array_document(spark, tmp_dir):
    src = os.path.join(tmp_dir, "items.json")
    with open(src, "w", encoding="utf-8") as f:
        json.dump(ROWS, f, ensure_ascii=False, indent=2)
    df = R.read_dataset(spark, src, SCHEMA)
    assert [r.asDict() for r in df.collect()] == ROWS


@pytest.mark.parametrize("sep,suffix", [(",", "csv"), ("\t", "tsv")])
def test_delimited_roundtrip_with_na(spark, tmp_dir, sep, suffix):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame([(1, 'a, "b"\nc'), (2, "NA"), (3, " padded "), (4, None)], schema)
    path = os.path.join(tmp_dir, f"d.{suffix}")
    W.write_delimited(df, path, sep)
    back = {r["id"]: r["text"] for r in R.read_dataset(spark, path, schema, multi_line=True).collect()}
    assert back == {1: 'a, "b"\nc', 2: None, 3: " padded ", 4: None}
    keep = {r["id"]: r["text"] for r in R.read_dataset(spark, path, schema, na_values=None, multi_line=True).collect()}
    assert keep[2] == "NA"


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        R.read_dataset(spark, "/x/data.parquet", SCHEMA)


def test_partitioned_results_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame(
        [(1, "perception", "selection", "random", "en", "api", "4", "1"),
         (2, "taxonomic", "yes_no_classification", None, "ja", "hf", "m", "yes")],
        "id long, task string, sub_task string, sub_subtask string, lang string, model_type string, model_name string, parsed string")
    root = os.path.join(tmp_dir, "results")
    W.write_results(df, root)
    back = W.read_results(spark, root, df.schema)
    key = lambda d: d["id"]
    assert sorted((r.asDict() for r in back.collect()), key=key) == sorted((r.asDict() for r in df.collect()), key=key)
    # a rerun of one run replaces only that run's partition
    W.write_results(df.where("id = 1").withColumn("parsed", F.lit("2")), root)
    again = {r["id"]: r["parsed"] for r in W.read_results(spark, root, df.schema).collect()}
    assert again == {1: "2", 2: "yes"}


def test_few_shot_file_order(spark, tmp_dir):
    src = os.path.join(tmp_dir, "fs.jsonl")
    with open(src, "w") as f:
        for i in range(30):
            f.write(json.dumps({"user": f"u{i}", "assistant": f"a{i}"}) + "\n")
    from evalframe.operators.fewshot import few_shot_sets
    ex = R.read_few_shot(spark, src).withColumn("k", F.lit(1))
    fs = few_shot_sets(ex, ["k"]).collect()[0]["few_shot"]
    assert [x["user"] for x in fs] == [f"u{i}" for i in range(30)]


def test_few_shot_json_array_order(spark, tmp_dir):
    src = os.path.join(tmp_dir, "fs.json")
    with open(src, "w") as f:
        json.dump([{"user": f"u{i}", "assistant": f"a{i}", "images": [f"i{i}.jpg"] if i % 2 else None}
                   for i in range(12)], f)
    from evalframe.operators.fewshot import few_shot_sets
    ex = R.read_few_shot(spark, src).withColumn("k", F.lit(1))
    fs = few_shot_sets(ex, ["k"]).collect()[0]["few_shot"]
    assert [x["user"] for x in fs] == [f"u{i}" for i in range(12)]
    assert fs[1]["images"] == ["i1.jpg"] and fs[0]["images"] is None


def test_few_shot_directory_order(spark, tmp_dir):
    """Examples of a directory come in the order of its files, whatever their sizes."""
    from evalframe.operators.fewshot import few_shot_sets

    src = os.path.join(tmp_dir, "fs.jsonl")
    os.makedirs(src)
    want = []
    for part, n in (("part-0", 2), ("part-1", 300), ("part-2", 1)):
        with open(os.path.join(src, part + ".jsonl"), "w") as f:
            for i in range(n):
                f.write(json.dumps({"user": f"{part}-{i}", "assistant": "a" * n}) + "\n")
                want.append(f"{part}-{i}")
    fs = few_shot_sets(R.read_few_shot(spark, src).withColumn("k", F.lit(1)), ["k"]).collect()[0]["few_shot"]
    assert [x["user"] for x in fs] == want


@pytest.mark.parametrize("base,path,want", [
    ("s3://bucket/images", "img/a.jpg", "s3://bucket/images/img/a.jpg"),
    ("hdfs://nn:8020//d/", "./i", "hdfs://nn:8020/d/i"),
    ("/base", "s3://other/x.jpg", "s3://other/x.jpg"),
    ("s3://bucket", "/abs/x.jpg", "/abs/x.jpg"),
])
def test_resolve_path_in_stores(spark, base, path, want):
    from evalframe.functions.assets import resolve_path

    assert spark.range(1).select(resolve_path(F.lit(base), F.lit(path))).first()[0] == want


def test_writers_keep_other_runs_on_a_plain_session(spark, tmp_dir):
    """Dynamic overwrite is set on the writer, not taken from the session."""
    schema = ("id long, task string, sub_task string, sub_subtask string, lang string, model_type string, model_name string, "
              "accuracy double")
    rows = [spark.createDataFrame([(1, "t", "s", "x", "en", "api", m, 1.0)], schema) for m in ("m1", "m2")]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        for df in rows:
            W.write_results(df, os.path.join(tmp_dir, "r"))
            W.write_scores(df, os.path.join(tmp_dir, "s"))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    for d in ("r", "s"):
        assert {r["model_name"] for r in spark.read.json(os.path.join(tmp_dir, d)).select("model_name").collect()} == {"m1", "m2"}
