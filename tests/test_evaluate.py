"""``evaluate``: registry validation, file layout, per-task plans, scores."""

from __future__ import annotations

import json
import os
import sys

import pytest
from pyspark import cloudpickle

from evalframe.plans.evaluate import evaluate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANSWERS = {"cup": "(1) smooth", "pan": "0", "stone": "-1", "glass": "2", "soft": "yes", "hard": "no", "odd": "maybe",
           "silk:smooth": "1", "rock:fluffy": "4", "ice:cold": "2"}


class KeyedResponder:
    """Answers from a table keyed by the item's object / term."""
    input_columns = None
    wants_messages = False

    def respond(self, requests):
        out = []
        for r in requests:
            row = r["row"]
            key = f"{row['object']}:{row['term']}" if row.get("object") and row.get("term") else (row.get("object") or row.get("term"))
            out.append(ANSWERS.get(key, "?"))
        return out


def _write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")


def _sel(obj, correct, k):
    return {"image_id": f"00{len(obj)}{obj}", "image": ["img/a.jpg"], "object": obj, "correct_ids": correct,
            "all_ids_with_term": [f"{i}:w{i}" for i in range(k)]}


@pytest.fixture()
def data_root(tmp_dir):
    root = os.path.join(tmp_dir, "data")
    base = os.path.join(root, "perception", "selection")
    _write(os.path.join(base, "choice2_ans1", "ja.jsonl"), [_sel("cup", [1], 2), _sel("pan", [1], 2)])
    _write(os.path.join(base, "random", "ja.jsonl"), [_sel("stone", [], 3), _sel("glass", [2], 3)])
    for sst in ("choice2_ans1", "random"):
        _write(os.path.join(base, sst, "few_shot_ja.jsonl"), [{"user": "u", "assistant": "0"}])
    cc = os.path.join(root, "commonsense", "classification")
    _write(os.path.join(cc, "ja.jsonl"), [
        {"id": 1, "object": "silk", "term": "smooth", "naturalness": 1, "naturalness_by_worker": [1, 1, 2, 1, 1]},
        {"id": 2, "object": "rock", "term": "fluffy", "naturalness": 5, "naturalness_by_worker": [5, 5, 5, 5, 5]},
        {"id": 3, "object": "ice", "term": "cold", "naturalness": 2, "naturalness_by_worker": [3, 2, 2, 2, 4]}])
    _write(os.path.join(cc, "few_shot_ja.jsonl"), [{"user": "u1", "assistant": "1"}, {"user": "u2", "assistant": "2"}])
    yn = os.path.join(root, "taxonomic", "yes_no_classification")
    _write(os.path.join(yn, "ja.jsonl"), [{"id": 1, "term": "soft", "label": 1}, {"id": 2, "term": "hard", "label": 1},
                                         {"id": 3, "term": "odd", "label": 0}])
    _write(os.path.join(yn, "few_shot_ja.jsonl"), [{"user": "u", "assistant": "yes"}])
    return root


def test_invalid_combination_fails_before_running(spark, data_root, tmp_dir):
    with pytest.raises(ValueError, match="unknown task combinations"):
        evaluate(spark, ["perception", "taxonomic"], ["selection"], "ja", "api", "gpt-4m", KeyedResponder,
                 os.path.join(tmp_dir, "out"), data_root=data_root)
    assert not os.path.exists(os.path.join(tmp_dir, "out"))


def test_evaluate_scores(spark, data_root, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    sel = {r["sub_subtask"]: r for r in evaluate(spark, ["perception"], ["selection"], "ja", "api", "org/gpt-4x", KeyedResponder,
                                                 out, data_root=data_root, sub_subtasks=["choice2_ans1", "random"]).collect()}
    assert sel["choice2_ans1"]["accuracy"] == 0.5 and sel["random"]["accuracy"] == 1.0
    assert sel["random"]["n_rows"] == 2
    cc = evaluate(spark, ["commonsense"], ["classification"], "ja", "api", "org/gpt-4x", KeyedResponder, out,
                  data_root=data_root).collect()[0]
    # silk: pred 1 gold 1 (not unanimous); rock: pred 4 vs unanimous 5 -> 1.0; ice: pred 2 gold 2 -> 0
    assert cc["accuracy"] == pytest.approx(2 / 3) and cc["n_distance"] == 3
    assert cc["average_distance"] == pytest.approx((0.0 + 1.0 + 0.0) / 3)
    yn = evaluate(spark, ["taxonomic"], ["yes_no_classification"], "ja", "api", "org/gpt-4x", KeyedResponder, out,
                  data_root=data_root).collect()[0]
    assert yn["accuracy"] == pytest.approx(1 / 3) and yn["n_invalid"] == 1
    results = spark.read.parquet(os.path.join(out, "results"))
    assert results.where("task = 'perception'").count() == 4 and results.where("task = 'commonsense'").count() == 3


def test_evaluate_concurrent_combinations(spark, data_root, tmp_dir):
    gen = os.path.join(data_root, "commonsense", "generation")
    _write(os.path.join(gen, "ja.jsonl"), [{"image_id": "1", "object": "cup", "terms": ["smooth"]},
                                          {"image_id": "2", "object": "silk", "terms": ["soft"]}])
    _write(os.path.join(gen, "few_shot_ja.jsonl"), [{"user": "u", "assistant": "a"}])
    out = os.path.join(tmp_dir, "out")
    scores = evaluate(spark, ["commonsense"], ["classification", "generation"], "ja", "api", "gpt-4m", KeyedResponder, out,
                      data_root=data_root, max_parallel=2).collect()
    assert [(r["task"], r["sub_task"], r["n_rows"]) for r in scores] == [("commonsense", "classification", 3)]
    results = spark.read.parquet(os.path.join(out, "results"))
    assert results.where("sub_task = 'generation'").count() == 2
    assert results.where("sub_task = 'classification'").count() == 3


def test_command_line(spark, data_root, tmp_dir, capsys):
    from evalframe.__main__ import main

    main(["--task", "taxonomic", "--sub-task", "yes_no_classification", "--lang", "ja", "--model-type", "api",
          "--model-name", "gpt-4o", "--responder", "tests.test_evaluate:KeyedResponder",
          "--save-dir", os.path.join(tmp_dir, "cli"), "--data-root", data_root])
    assert "yes_no_classification" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--task", "taxonomic", "--sub-task", "yes_no_classification", "--lang", "ja", "--model-type", "vllm",
              "--model-name", "gpt-4o", "--responder", "tests.test_evaluate:KeyedResponder",
              "--save-dir", os.path.join(tmp_dir, "cli2"), "--data-root", data_root])


class CountingKeyed(KeyedResponder):
    """Marks answers so a test can tell which run produced a row."""

    def respond(self, requests):
        return [a + " (second run)" for a in super().respond(requests)]


SUBS = ["choice2_ans1", "random"]


def test_evaluate_resume(spark, data_root, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    base = os.path.join(data_root, "perception", "selection", "choice2_ans1", "ja.jsonl")
    full = open(base, encoding="utf-8").read()
    with open(base, "w", encoding="utf-8") as f:      # first run sees only the first item
        f.write(full.splitlines()[0] + "\n")
    evaluate(spark, ["perception"], ["selection"], "ja", "api", "gpt-4m", KeyedResponder, out, data_root=data_root,
             sub_subtasks=SUBS)
    with open(base, "w", encoding="utf-8") as f:
        f.write(full)
    with pytest.raises(ValueError):
        evaluate(spark, ["perception"], ["selection"], "ja", "api", "gpt-4m", KeyedResponder, out, data_root=data_root,
                 resume=True, max_parallel=2, sub_subtasks=SUBS)
    scores = {r["sub_subtask"]: r for r in evaluate(spark, ["perception"], ["selection"], "ja", "api", "gpt-4m",
                                                    CountingKeyed, out, data_root=data_root, resume=True,
                                                    sub_subtasks=SUBS).collect()}
    assert scores["choice2_ans1"]["n_rows"] == 2 and scores["random"]["n_rows"] == 2
    rows = spark.read.parquet(os.path.join(out, "results")).select("sub_subtask", "object", "raw_response").collect()
    second = {(r["sub_subtask"], r["object"]) for r in rows if r["raw_response"].endswith("(second run)")}
    assert second == {("choice2_ans1", "pan")}      # only the item missing after the first run was asked


def test_export_jsonl_names(spark, data_root, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    evaluate(spark, ["taxonomic"], ["yes_no_classification"], "ja", "api", "gpt-4m", KeyedResponder, out,
             data_root=data_root, export_jsonl=True)
    evaluate(spark, ["perception"], ["selection"], "ja", "api", "gpt-4m", KeyedResponder, out, data_root=data_root,
             sub_subtasks=SUBS, export_jsonl=True)
    yn = spark.read.json(os.path.join(out, "jsonl", "task=taxonomic"))
    assert {"original_model_inference", "model_inference", "zero_shot"} <= set(yn.columns)
    sel = spark.read.json(os.path.join(out, "jsonl", "task=perception"))
    assert {"original_response", "response"} <= set(sel.columns) and "parsed" not in sel.columns
    assert yn.count() == 3 and sel.count() == 4
