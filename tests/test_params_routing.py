"""Generation parameters (F3-F5), truncation (F7), routing (F6) and base
names (C10) against plain-Python implementations of the same rules."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from evalframe.constants import API_PARAM_DEFAULTS, BATCH_PARAM_DEFAULTS
from evalframe.functions import params as G
from evalframe.functions import prompts as C
from evalframe.functions import routing as RT
from evalframe.plans.q_params import MODEL_NAMES, param_rows
from tests.conftest import SF_SMALL

FALSY = {"0", "0.0", "false", "False", "", "None"}


def truthy(v):
    return v is not None and v not in FALSY


def py_api(d):
    d = dict(d)
    if truthy(d.get("max_new_tokens")):
        d["max_completion_tokens"] = d.pop("max_new_tokens")
        d.pop("do_sample", None)
        d.pop("num_beams", None)
    return d


def py_batch(d):
    d = dict(d)
    if truthy(d.get("max_new_tokens")):
        d["max_tokens"] = d.pop("max_new_tokens")
        d.pop("do_sample", None)
        if "num_beams" in d:
            d["n"] = d.pop("num_beams")
    return d


def py_defaults(d, backend):
    if backend == "api":
        d = py_api(d)
        d.setdefault("model", "m")
        for k, v in API_PARAM_DEFAULTS.items():
            d.setdefault(k, G.value_text(v))
    elif backend == "vllm":
        d = py_batch(d)
        for k, v in BATCH_PARAM_DEFAULTS.items():
            d.setdefault(k, G.value_text(v))
    else:
        d = dict(d)
        d.setdefault("max_new_tokens", "1024")
        d.setdefault("do_sample", "true")
        d.setdefault("temperature", "0.05" if truthy(d["do_sample"]) else None)
        d.setdefault("top_p", "1.0" if truthy(d["do_sample"]) else None)
        d.setdefault("num_beams", "1")
        d.setdefault("use_cache", "true")
    return d


def text(d):
    return ";".join(sorted(f"{k}={'null' if v is None else v}" for k, v in d.items()))


def test_params_brute_force(spark):
    pr = param_rows(spark, SF_SMALL)
    rows = pr.select("id", "backend", "params", G.params_text(G.gen_params_api("params")).alias("api"),
                     G.params_text(G.gen_params_batch("params")).alias("batch"),
                     G.params_text(G.gen_params_defaults("params", "backend", F.lit("m"))).alias("dflt")).collect()
    assert rows
    for r in rows:
        d = dict(r["params"])
        assert r["api"] == text(py_api(d))
        assert r["batch"] == text(py_batch(d))
        assert r["dflt"] == text(py_defaults(d, r["backend"]))


def test_batch_strict_missing_num_beams(spark):
    df = spark.createDataFrame([({"max_new_tokens": "8"},)], "m map<string,string>")
    assert df.select(G.params_text(G.gen_params_batch("m"))).collect()[0][0] == "max_tokens=8"
    with pytest.raises(Exception):
        df.select(G.gen_params_batch("m", strict=True)).collect()


def test_left_truncate(spark):
    cases = [(list("abcdef"), 2), (list("abc"), 5), (list("abc"), 0), (list("abc"), None), ([], 3)]
    df = spark.createDataFrame(cases, "t array<string>, n int")
    got = [r[0] for r in df.select(G.left_truncate("t", "n")).collect()]
    want = [t if not n else t[-n:] for t, n in cases]
    assert got == want


def py_route(name, backend):
    n = name.lower()
    if backend == "api":
        return "gpt4o" if "gpt-4" in n else None
    vllm = backend == "vllm"
    if "llama-3.2" in n and "vision" in n:
        return "mllama_instruct" if "instruct" in n else None
    if "llava" in n:
        if "1.5" in n or "v1.5" in n:
            return "llava"
        if "next" in n or "1.6" in n or "v1.6" in n:
            return "llava_next"
        if "onevision" in n:
            return "llava_onevision"
        return None
    if "idefics2" in n:
        return "idefics2"
    if "idefics3" in n:
        return "idefics3"
    if "qwen2-vl" in n:
        return "qwen2_vl_vllm" if vllm else "qwen2_vl"
    if "molmo" in n:
        return "molmo"
    if vllm:
        return None
    if "llama-3" in n:
        return "llama3_instruct" if "instruct" in n else None
    if "llama-2" in n:
        return "llama2_instruct" if ("chat" in n or "instruct" in n) else None
    if "gemma-2" in n:
        return "gemma2_instruct"
    if "qwen2.5" in n:
        return "qwen2_5_instruct" if "instruct" in n else None
    if "qwen2" in n:
        return "qwen2_instruct" if "instruct" in n else None
    if "llm-jp-3" in n:
        return "llm_jp_3_instruct" if "instruct" in n else None
    return None


def test_routing_and_basename(spark):
    rows = [(n, b) for n in MODEL_NAMES for b in ("hf", "vllm", "api")] + [("a/b/", "hf")]
    df = spark.createDataFrame(rows, "name string, backend string")
    out = df.select("name", "backend", RT.route_model("name", "backend").alias("f"),
                    C.model_basename("name").alias("b")).collect()
    for r in out:
        assert r["f"] == py_route(r["name"], r["backend"]), (r["name"], r["backend"])
        assert r["b"] == pathlib.PurePosixPath(r["name"]).name


def test_render_and_choice_text(spark):
    df = spark.createDataFrame([("cup", ["0:a", "1:b"])], "o string, c array<string>")
    assert df.select(C.prompt_selection("o", "c", "O={object} C={choices}")).collect()[0][0] == "O=cup C=0:a, 1:b"
    bad = spark.createDataFrame([(["0:a", None],)], "c array<string>")
    with pytest.raises(Exception):
        bad.select(C.choice_text("c")).collect()
    with pytest.raises(KeyError):
        C.render("{missing}", object=F.lit("x"))
