"""Registered queries: generation parameters (F3-F5), truncation (F7),
model routing (F6) and model base names (C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.constants import API_PARAM_DEFAULTS, BATCH_PARAM_DEFAULTS, BATCH_CAPABLE_FAMILIES
from evalframe.functions import params as G
from evalframe.functions import prompts as C
from evalframe.functions import routing as RT
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register

# Model names the routing is exercised with (one per part row, cycling).
MODEL_NAMES = (
    "meta-llama/Llama-3.2-11B-Vision-Instruct", "meta-llama/Llama-3.2-11B-Vision",
    "llava-hf/llava-1.5-7b-hf", "llava-hf/llava-v1.6-mistral-7b-hf", "llava-hf/llava-onevision-qwen2-7b-ov-hf",
    "llava-hf/bakLlava-v1-hf", "HuggingFaceM4/idefics2-8b", "HuggingFaceM4/Idefics3-8B-Llama3",
    "Qwen/Qwen2-VL-7B-Instruct", "allenai/Molmo-7B-D-0924", "meta-llama/Meta-Llama-3-8B-Instruct",
    "meta-llama/Meta-Llama-3-8B", "meta-llama/Llama-2-7b-chat-hf", "meta-llama/Llama-2-7b-hf",
    "google/gemma-2-2b-jpn-it", "Qwen/Qwen2.5-7B-Instruct", "Qwen/Qwen2.5-7B", "Qwen/Qwen2-7B-Instruct",
    "Qwen/Qwen2-7B", "llm-jp/llm-jp-3-13b-instruct", "llm-jp/llm-jp-3-13b", "gpt-4o-2024-08-06", "gpt-4o-mini",
    "mistralai/Mistral-7B-Instruct-v0.3", "4",
)
BACKENDS = ("hf", "vllm", "api")


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    i = F.col("p_partkey")
    names = F.array(*[F.lit(n) for n in MODEL_NAMES])
    name = F.get(names, (i % len(MODEL_NAMES)).cast("int"))
    return p.select(
        i.alias("id"),
        F.when(i % 7 == 0, F.concat(name, F.lit("/"))).otherwise(name).alias("model_name"),
        F.get(F.array(*[F.lit(b) for b in BACKENDS]), (i % 3).cast("int")).alias("backend"),
    )


_MODEL_SQL = f"""
model_rows AS (
  SELECT p_partkey AS id,
         CASE WHEN p_partkey % 7 = 0 THEN [{', '.join(O.lit(n) for n in MODEL_NAMES)}][p_partkey % {len(MODEL_NAMES)} + 1] || '/'
              ELSE [{', '.join(O.lit(n) for n in MODEL_NAMES)}][p_partkey % {len(MODEL_NAMES)} + 1] END AS model_name,
         [{', '.join(O.lit(b) for b in BACKENDS)}][p_partkey % 3 + 1] AS backend
  FROM part)"""


@register("route_model", O.with_(_MODEL_SQL) + f"""
SELECT id, model_name, backend, family, family IS NOT NULL AS supported,
       coalesce(family IN ({', '.join(O.lit(f) for f in BATCH_CAPABLE_FAMILIES)}), false) AS batch_capable
FROM (SELECT *, {RT.route_sql('model_name', 'backend')} AS family FROM model_rows)""")
def route_model(spark: SparkSession, sf: str) -> DataFrame:
    m = model_rows(spark, sf).withColumn("family", RT.route_model("model_name", "backend"))
    return m.select("id", "model_name", "backend", "family", F.col("family").isNotNull().alias("supported"),
                    RT.batch_capable("family").alias("batch_capable"))


@register("model_basename", O.with_(_MODEL_SQL)
          + "SELECT id, model_name, regexp_extract(model_name, '([^/]+)/*$', 1) AS basename FROM model_rows")
def model_basename(spark: SparkSession, sf: str) -> DataFrame:
    return model_rows(spark, sf).select("id", "model_name", C.model_basename("model_name").alias("basename"))


# ---------------------------------------------------------------------------
# generation parameters
# ---------------------------------------------------------------------------

def param_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per part row: a parameter map with some keys absent and some null."""
    p = fx.table(spark, sf, "part")
    i = F.col("p_partkey")
    entries = F.array(
        F.struct(F.lit("max_new_tokens").alias("k"), (F.col("p_size") * 32).cast("string").alias("v"), (i % 5 != 0).alias("p")),
        F.struct(F.lit("do_sample").alias("k"), F.when(i % 2 == 0, "true").otherwise("false").alias("v"), (i % 3 != 0).alias("p")),
        F.struct(F.lit("temperature").alias("k"), F.when(i % 8 == 0, F.lit(None).cast("string")).otherwise(F.lit("0.01")).alias("v"),
                 (i % 4 != 1).alias("p")),
        F.struct(F.lit("top_p").alias("k"), F.lit("1.0").alias("v"), (i % 6 != 2).alias("p")),
        F.struct(F.lit("num_beams").alias("k"), F.lit("1").alias("v"), (i % 7 != 3).alias("p")),
    )
    present = F.filter(entries, lambda e: e["p"])
    m = F.map_from_entries(F.transform(present, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))
    return p.select(i.alias("id"), m.alias("params"), F.get(F.array(*[F.lit(b) for b in BACKENDS]), (i % 3).cast("int")).alias("backend"))


_PARAM_SQL = f"""
param_rows AS (
  SELECT p_partkey AS id,
         list_transform(list_filter([
           {{'k': 'max_new_tokens', 'v': CAST(p_size * 32 AS VARCHAR), 'p': p_partkey % 5 <> 0}},
           {{'k': 'do_sample', 'v': CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, 'p': p_partkey % 3 <> 0}},
           {{'k': 'temperature', 'v': CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE '0.01' END, 'p': p_partkey % 4 <> 1}},
           {{'k': 'top_p', 'v': '1.0', 'p': p_partkey % 6 <> 2}},
           {{'k': 'num_beams', 'v': '1', 'p': p_partkey % 7 <> 3}}], lambda e: e.p),
           lambda e: {{'k': e.k, 'v': e.v}}) AS e,
         [{', '.join(O.lit(b) for b in BACKENDS)}][p_partkey % 3 + 1] AS backend
  FROM part),
param_flags AS (
  SELECT *,
         list_transform(e, lambda x: x.k) AS keys,
         list_filter(e, lambda x: x.k = 'max_new_tokens')[1].v AS mnt,
         list_filter(e, lambda x: x.k = 'do_sample')[1].v AS ds,
         len(list_filter(e, lambda x: x.k = 'do_sample')) > 0 AS has_ds,
         list_filter(e, lambda x: x.k = 'num_beams')[1].v AS nb,
         len(list_filter(e, lambda x: x.k = 'num_beams')) > 0 AS has_nb
  FROM param_rows)"""


def _truthy_sql(v: str) -> str:
    return f"coalesce({v} IS NOT NULL AND {v} NOT IN ('0', '0.0', 'false', 'False', '', 'None'), false)"


def _text_sql(lst: str) -> str:
    return f"array_to_string(list_sort(list_transform({lst}, lambda x: x.k || '=' || coalesce(x.v, 'null'))), ';')"


_API_SQL = f"""CASE WHEN {_truthy_sql('mnt')} THEN list_transform(
        list_filter(e, lambda x: x.k NOT IN ('do_sample', 'num_beams', 'max_completion_tokens')),
        lambda x: {{'k': CASE WHEN x.k = 'max_new_tokens' THEN 'max_completion_tokens' ELSE x.k END, 'v': x.v}})
     ELSE e END"""

_BATCH_SQL = f"""CASE WHEN {_truthy_sql('mnt')} THEN list_concat(
        list_transform(list_filter(e, lambda x: x.k NOT IN ('do_sample', 'num_beams', 'max_tokens')
                                              AND NOT (has_nb AND x.k = 'n')),
                       lambda x: {{'k': CASE WHEN x.k = 'max_new_tokens' THEN 'max_tokens' ELSE x.k END, 'v': x.v}}),
        CASE WHEN has_nb THEN [{{'k': 'n', 'v': nb}}] ELSE [] END)
     ELSE e END"""


@register("gen_params_api", O.with_(_PARAM_SQL) + f"SELECT id, {_text_sql(_API_SQL)} AS params FROM param_flags")
def gen_params_api(spark: SparkSession, sf: str) -> DataFrame:
    return param_rows(spark, sf).select("id", G.params_text(G.gen_params_api("params")).alias("params"))


@register("gen_params_batch", O.with_(_PARAM_SQL) + f"SELECT id, {_text_sql(_BATCH_SQL)} AS params FROM param_flags")
def gen_params_batch(spark: SparkSession, sf: str) -> DataFrame:
    return param_rows(spark, sf).select("id", G.params_text(G.gen_params_batch("params")).alias("params"))


def _defaults_list_sql(d: dict) -> str:
    items = []
    for k, v in d.items():
        t = G.value_text(v)
        items.append(f"{{'k': {O.lit(k)}, 'v': {O.lit(t) if t is not None else 'CAST(NULL AS VARCHAR)'}}}")
    return "[" + ", ".join(items) + "]"


def _fill_sql(lst: str, defaults: str) -> str:
    return f"list_concat({lst}, list_filter({defaults}, lambda d: NOT list_contains(list_transform({lst}, lambda x: x.k), d.k)))"


_SAMPLING = f"CASE WHEN has_ds THEN {_truthy_sql('ds')} ELSE true END"
_LOCAL_DEFAULTS_SQL = (f"[{{'k': 'max_new_tokens', 'v': '1024'}}, {{'k': 'do_sample', 'v': 'true'}}, {{'k': 'num_beams', 'v': '1'}}, "
                       f"{{'k': 'use_cache', 'v': 'true'}}, {{'k': 'temperature', 'v': CASE WHEN {_SAMPLING} THEN '0.05' END}}, "
                       f"{{'k': 'top_p', 'v': CASE WHEN {_SAMPLING} THEN '1.0' END}}]")


@register("gen_params_defaults", O.with_(_PARAM_SQL) + f"""
SELECT id, backend,
       CASE backend WHEN 'api' THEN {_text_sql(_fill_sql('(' + _API_SQL + ')', _defaults_list_sql({'model': 'replay-model', **API_PARAM_DEFAULTS})))}
                    WHEN 'vllm' THEN {_text_sql(_fill_sql('(' + _BATCH_SQL + ')', _defaults_list_sql(BATCH_PARAM_DEFAULTS)))}
                    ELSE {_text_sql(_fill_sql('e', _LOCAL_DEFAULTS_SQL))} END AS params
FROM param_flags""")
def gen_params_defaults(spark: SparkSession, sf: str) -> DataFrame:
    pr = param_rows(spark, sf)
    return pr.select("id", "backend", G.params_text(G.gen_params_defaults("params", "backend", F.lit("replay-model"))).alias("params"))


@register("left_truncate", """
SELECT doc_id AS id, n, array_to_string(CASE WHEN n = 0 THEN t ELSE t[greatest(1, len(t) - n + 1):len(t)] END, ' ') AS text,
       CAST(len(CASE WHEN n = 0 THEN t ELSE t[greatest(1, len(t) - n + 1):len(t)] END) AS INTEGER) AS n_tokens
FROM (SELECT doc_id, CAST(doc_id % 16 AS INTEGER) AS n, string_split(text, ' ') AS t FROM documents)""")
def left_truncate(spark: SparkSession, sf: str) -> DataFrame:
    ta = fx.token_arrays(spark, sf).withColumn("n", (F.col("id") % 16).cast("int"))
    tr = ta.select("id", "n", G.left_truncate("tokens", "n").alias("t"))
    return tr.select("id", "n", F.array_join("t", " ").alias("text"), F.size("t").alias("n_tokens"))
