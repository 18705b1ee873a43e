"""Responder (F1, F2), end-to-end plans (P1-P8) and streaming."""

from __future__ import annotations

import os
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalframe.operators.respond import EchoChoiceResponder, NotFoundError, ReplayResponder, respond, retry_waits
from evalframe.plans import task_plans as PL
from evalframe.plans import q_task_plans as Q
from tests.conftest import SF_SMALL

# responders defined here run inside Python workers, which cannot import tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_retry_waits_schedule():
    assert retry_waits(5) == [10.0, 20.0, 40.0, 80.0]
    assert retry_waits(1) == []


class _AlwaysDown:
    input_columns = ()

    def respond(self, requests):
        raise ConnectionError("down")


class _Missing:
    def respond(self, requests):
        raise NotFoundError("gone")


def test_failures_become_error_rows(spark):
    df = spark.createDataFrame([(1, "p")], "id long, prompt string")
    waits = []
    row = respond(df, _AlwaysDown, sleep=waits.append).collect()[0]
    assert row["raw_response"] is None and row["attempts"] == 5 and row["error"].startswith("exhausted")
    assert row["waited_s"] == 150.0
    row = respond(df, _Missing, sleep=lambda s: None).collect()[0]
    assert row["attempts"] == 1 and row["error"].startswith("not_found")


def test_echo_responder_spreads_partitions(spark):
    df = spark.range(200).select(F.col("id"), F.lit("Object: x\nOptions: 3:a, 4:b\nAnswer: ").alias("prompt")).coalesce(1)
    out = respond(df, EchoChoiceResponder, partitions=4)
    assert out.rdd.getNumPartitions() == 4
    assert {r["raw_response"] for r in out.collect()} == {"3"}
    default = respond(df, EchoChoiceResponder)
    assert default.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def _py_extract(s):
    m = re.match(r"\({0,1}(-1|[0-5]|[A-B]|yes|no)[.,:;)]{0,1}", s.strip())
    return m.group(1) if m else "-100"


def test_selection_pipeline_brute_force(spark, tmp_dir):
    """P1 end to end: scores equal a plain-Python scoring of the same items,
    and the result table is written once, partitioned by run."""
    items = Q.selection_items(spark, SF_SMALL)
    run = PL.Run("perception", "selection", "en", "api", "m/1")
    root = os.path.join(tmp_dir, "results")
    scores = {r["sub_subtask"]: r for r in PL.eval_selection(
        spark, items, run, ReplayResponder, few_shot=Q._fs_sets(spark, SF_SMALL), few_shot_keys=["fs_id"],
        results_root=root, scores_root=os.path.join(tmp_dir, "scores")).collect()}
    want: dict[str, list[int]] = {}
    for r in items.collect():
        gold = r["correct_ids"][0] if r["correct_ids"] else -1
        lab = _py_extract(r["recorded_response"])
        pred = int(lab) if re.fullmatch(r"-?\d+", lab) else -100
        want.setdefault(r["sub_subtask"], []).append(int(gold == pred))
    assert set(scores) == set(want)
    for k, v in want.items():
        assert scores[k]["accuracy"] == pytest.approx(sum(v) / len(v))
        assert scores[k]["n_rows"] == len(v)
    assert os.path.isdir(os.path.join(root, "task=perception", "sub_task=selection"))


def test_generation_requires_images(spark):
    items = Q.selection_items(spark, SF_SMALL)
    with pytest.raises(ValueError):
        PL.eval_generation(spark, items, PL.Run("perception", "generation", "ja", "api", "m"), ReplayResponder,
                           with_images=True)


def test_eval_run_covers_every_scored_task(spark):
    got = {(r["task"], r["sub_task"], r["lang"]) for r in Q.eval_run_scores(spark, SF_SMALL).collect()}
    assert got == {("perception", "selection", "ja"), ("perception", "selection", "en"),
                   ("commonsense", "classification", "ja"), ("commonsense", "classification", "en"),
                   ("taxonomic", "yes_no_classification", "ja"), ("taxonomic", "a_b_classification", "ja"),
                   ("taxonomic", "multiple_choice_classification", "ja")}


class _AlwaysYes:
    input_columns = ()
    wants_messages = False

    def respond(self, requests):
        return ["yes"] * len(requests)


def test_resume_answers_only_missing_rows(spark, tmp_dir):
    items = Q.yes_no_items(spark, SF_SMALL)
    run = PL.Run("taxonomic", "yes_no_classification", "ja", "api", "m")
    root = os.path.join(tmp_dir, "results")
    PL.eval_yes_no(spark, items.where(F.col("id") % 2 == 0), run, ReplayResponder, results_root=root)
    PL.eval_yes_no(spark, items, run, _AlwaysYes, results_root=root, resume=True)
    rows = spark.read.parquet(root).select("id", "zero_shot", "raw_response").collect()
    recorded = {r["id"]: r["recorded_response"] for r in items.collect()}
    assert sorted(r["id"] for r in rows) == sorted(recorded)          # each item exactly once
    for r in rows:
        assert r["raw_response"] == (recorded[r["id"]] if r["id"] % 2 == 0 else "yes")


def test_request_profiles(spark):
    from evalframe.constants import TURN
    from evalframe.functions.requests import prepare_request

    df = spark.createDataFrame(
        [("Sys", [(0, " u1 ", "a1", None)], "look <image> here", ["i1", "i2", "i3"]),
         ("Sys", [], "<image><image>", ["i1"])],
        "system string, few_shot array<struct<ord:bigint,user:string,assistant:string,images:array<string>>>, "
        "zero_shot string, images array<string>")

    def get(family):
        return df.withColumns(prepare_request(family, "system", "few_shot", "zero_shot", "images")).collect()

    g = get("gemma2_instruct")
    assert g[0]["prompt_text"] == (TURN["bos"] + TURN["start"] + "user\nSys\n\n u1" + TURN["end"] + TURN["start"] + "model\na1"
                                   + TURN["end"] + TURN["start"] + "user\nlook <image> here" + TURN["end"]
                                   + TURN["start"] + "model\n")
    assert g[0]["request_images"] == [] and g[0]["placeholder_error"] is False
    i = get("idefics2")
    assert i[0]["request_images"] == ["i1", "i2"] and i[1]["placeholder_error"] is True
    m = get("mllama_instruct")
    assert m[0]["messages"][0]["role"] == "user" and m[0]["messages"][-1]["content"][-1]["text"] == "look  here"
    assert [p["image"] for p in m[0]["messages"][-1]["content"][:-1]] == ["i1", "i2", "i3"]
    f = get("molmo")
    assert f[0]["prompt_text"] == "Sys\n\n u1 \na1\n\nlook  here"
    q = get("qwen2_5_instruct")
    assert q[1]["prompt_text"].startswith("<|im_start|>system\nSys<|im_end|>\n")
    with pytest.raises(ValueError):
        prepare_request("nope", "system", "few_shot", "zero_shot")


def test_placeholder_mismatch_rows_are_not_sent(spark):
    items = spark.createDataFrame([(1, "a <image> <image>", ["x"], "0"), (2, "b", ["x"], "1")],
                                  "id long, zero_shot string, images array<string>, recorded_response string")
    items = items.withColumns({"system": F.lit("S"), "few_shot": F.array().cast(
        "array<struct<ord:bigint,user:string,assistant:string,images:array<string>>>")})
    run = PL.Run("perception", "generation", "ja", "api", "m", family="gpt4o")
    out = {r["id"]: r for r in PL._respond_and_persist(spark, items, run, ReplayResponder, None, ["id"], "images").collect()}
    assert out[1]["error"] == "placeholder_mismatch" and out[1]["raw_response"] is None and out[1]["attempts"] == 0
    assert out[2]["raw_response"] == "1"


class _BatchRecorder:
    input_columns = ()

    def respond(self, requests):
        return [str(len(requests))] * len(requests)


def test_batch_size_caps_calls(spark):
    df = spark.range(50).select("id", F.lit("p").alias("prompt")).coalesce(1)
    got = {r["raw_response"] for r in respond(df, _BatchRecorder, batch_size=8, partitions=1).collect()}
    assert got <= {"8", "2"} and "8" in got


class _ParamsEcho:
    input_columns = ()
    wants_messages = False

    def respond(self, requests):
        return [";".join(f"{k}={v}" for k, v in sorted(r["gen_params"].items())) for r in requests]


@pytest.mark.parametrize("backend", ["api", "vllm", "hf"])
def test_gen_params_reach_responder(spark, backend):
    from tests.test_params_routing import py_defaults, text
    from evalframe.constants import DEFAULT_GEN_PARAMS
    from evalframe.functions.params import value_text

    items = Q.yes_no_items(spark, SF_SMALL).limit(5)
    run = PL.Run("taxonomic", "yes_no_classification", "ja", backend, "m", gen_params=dict(DEFAULT_GEN_PARAMS))
    rows = PL._respond_and_persist(spark, items.withColumns({
        "zero_shot": F.lit("q"), "system": F.lit("s"),
        "few_shot": F.array().cast("array<struct<ord:bigint,user:string,assistant:string,images:array<string>>>")}),
        run, _ParamsEcho, None, ["id"], typed=False).collect()
    want = text(py_defaults({k: value_text(v) for k, v in DEFAULT_GEN_PARAMS.items()}, backend))
    typed = {"None": "null", "True": "true", "False": "false"}   # Python values, not their texts in a map
    got = {";".join(f"{k}={typed.get(v, v)}" for k, v in (p.split("=") for p in r["raw_response"].split(";"))) for r in rows}
    assert got == {want.replace("model=None", "model=m")} and any("=True" in r["raw_response"] or "=False" in r["raw_response"] for r in rows)


class _ImagesEcho:
    input_columns = ()
    wants_messages = False

    def respond(self, requests):
        return [",".join(r["images"] or []) for r in requests]


def test_image_paths_resolved_against_image_dir(spark):
    items = spark.createDataFrame([(1, ["a/x.jpg", "http://h/y.png", "/abs/z.jpg"])], "id long, image array<string>")
    items = items.withColumns({"zero_shot": F.lit("q"), "system": F.lit("s"), "few_shot": F.array().cast(
        "array<struct<ord:bigint,user:string,assistant:string,images:array<string>>>")})
    run = PL.Run("perception", "generation", "ja", "api", "m", image_dir="/data/img/")
    row = PL._respond_and_persist(spark, items, run, _ImagesEcho, None, ["id"], "image").collect()[0]
    assert row["raw_response"] == "/data/img/a/x.jpg,http://h/y.png,/abs/z.jpg"


class _Outage:
    """Down for the first two calls, whatever they hold."""
    input_columns = ()
    wants_messages = False

    def __init__(self):
        self.calls = 0

    def respond(self, requests):
        self.calls += 1
        if self.calls <= 2:
            raise TimeoutError("busy")
        return [str(len(requests))] * len(requests)


def test_retries_repeat_the_batch(spark):
    df = spark.range(20).select("id", F.lit("p").alias("prompt")).coalesce(1)
    rows = respond(df, _Outage, sleep=lambda s: None, partitions=1).collect()
    assert {(r["raw_response"], r["attempts"], r["waited_s"], r["error"]) for r in rows} == {("20", 3, 30.0, None)}


class _BadRow:
    input_columns = ("id",)
    wants_messages = False

    def respond(self, requests):
        if any(r["row"]["id"] == 7 for r in requests):
            raise ValueError("cannot be sent")
        return ["ok"] * len(requests)


def test_other_failures_are_not_repeated(spark):
    df = spark.range(20).select("id", F.lit("p").alias("prompt")).coalesce(1)
    waits = []
    rows = {r["id"]: r for r in respond(df, _BadRow, sleep=waits.append, partitions=1).collect()}
    assert rows[7]["error"].startswith("failed: ValueError") and rows[7]["attempts"] == 1 and rows[7]["waited_s"] == 0
    assert all(r["raw_response"] == "ok" for i, r in rows.items() if i != 7)


def test_closures_do_not_share_responders(spark):
    from evalframe.operators.respond import responder_key

    def factory(answer):
        def make():
            return _AlwaysYes()
        make.reuse_across_tasks = True
        return make

    a, b = factory("a"), factory("b")
    assert responder_key(a) != responder_key(b) and responder_key(_AlwaysYes) == responder_key(_AlwaysYes)
    a.responder_id = b.responder_id = "same"
    assert responder_key(a) == responder_key(b)


def test_missing_model_fails_the_run(spark, tmp_dir):
    with pytest.raises(RuntimeError, match="not_found"):
        PL.eval_yes_no(spark, Q.yes_no_items(spark, SF_SMALL), PL.Run("taxonomic", "yes_no_classification", "ja", "api", "m"),
                       _Missing, results_root=os.path.join(tmp_dir, "results"))


class _FailsOdd:
    input_columns = ("id",)
    wants_messages = False

    def respond(self, requests):
        if any(r["row"]["id"] % 2 for r in requests):
            raise ValueError("odd")
        return ["yes"] * len(requests)


def test_failed_rows_are_counted_apart_and_asked_again(spark, tmp_dir):
    items = spark.createDataFrame([(i, "t", 1) for i in range(6)], "id long, term string, label int")
    run, root = PL.Run("taxonomic", "yes_no_classification", "ja", "api", "m"), os.path.join(tmp_dir, "results")
    first = PL.eval_yes_no(spark, items, run, _FailsOdd, results_root=root).first()
    assert (first["accuracy"], first["n_rows"], first["n_error"], first["n_invalid"]) == (1.0, 3, 3, 0)
    second = PL.eval_yes_no(spark, items, run, _AlwaysYes, results_root=root, resume=True).first()
    assert (second["accuracy"], second["n_rows"], second["n_error"]) == (1.0, 6, 0)


def test_resume_with_null_and_shared_ids(spark, tmp_dir):
    items = spark.createDataFrame([(None, "a", 1), (None, "b", 1), (1, "c", 1), (1, "d", 1)], "id long, term string, label int")
    run, root = PL.Run("taxonomic", "yes_no_classification", "ja", "api", "m"), os.path.join(tmp_dir, "results")
    keep = ["id", "term"]
    PL.eval_yes_no(spark, items.where("term in ('a', 'c')"), run, _AlwaysYes, results_root=root, keep=keep)
    out = PL.eval_yes_no(spark, items, run, _AlwaysYes, results_root=root, keep=keep, resume=True).first()
    assert out["n_rows"] == 4 and spark.read.parquet(root).count() == 4


def test_resume_needs_a_readable_table(spark, tmp_dir):
    root = os.path.join(tmp_dir, "results")
    os.makedirs(root)
    open(os.path.join(root, "part-0.parquet"), "w").write("broken")
    with pytest.raises(Exception):
        PL.eval_yes_no(spark, Q.yes_no_items(spark, SF_SMALL), PL.Run("taxonomic", "yes_no_classification", "ja", "api", "m"),
                       _AlwaysYes, results_root=root, resume=True)


def test_subset_rerun_scores_only_its_rows(spark, tmp_dir):
    items = Q.selection_items(spark, SF_SMALL)
    run, root = PL.Run("perception", "selection", "en", "api", "m"), os.path.join(tmp_dir, "results")
    PL.eval_selection(spark, items, run, ReplayResponder, results_root=root)
    out = PL.eval_selection(spark, items, run, ReplayResponder, results_root=root, sub_subtasks=["choice2_ans1"])
    assert [r["sub_subtask"] for r in out.collect()] == ["choice2_ans1"]


def test_few_shot_images_are_resolved(spark):
    items = spark.createDataFrame([(1, ["a.jpg"])], "id long, image array<string>").withColumns({
        "zero_shot": F.lit("q"), "system": F.lit("s"), "few_shot": F.array(F.struct(
            F.lit(0).cast("long").alias("ord"), F.lit("u").alias("user"), F.lit("a").alias("assistant"),
            F.array(F.lit("fs.jpg")).alias("images")))})
    run = PL.Run("perception", "generation", "ja", "api", "m", image_dir="s3://b/i")
    req, _ = PL._request_columns(items, run, "image", True)
    parts = [p["image"] for m in req.first()["messages"] for p in m["content"] if p["image"]]
    assert parts == ["s3://b/i/fs.jpg", "s3://b/i/a.jpg"]
