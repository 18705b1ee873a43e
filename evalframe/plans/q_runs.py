"""Registered queries: task registry (A7), run matrix (J1), run resolution.

Requests are derived from the part table: every part row asks for a list of
tasks and sub_tasks in one language, some of them invalid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.operators import runs as R
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register

TASKS = ("perception", "commonsense", "taxonomic")
SUB_TASKS = ("generation", "selection", "classification", "a_b_classification", "yes_no_classification",
             "multiple_choice_classification")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Per part row: lang, a task list (1-3 tasks) and a sub_task list (1-2)."""
    p = fx.table(spark, sf, "part")
    i = F.col("p_partkey")
    tasks = F.array(*[F.lit(t) for t in TASKS])
    subs = F.array(*[F.lit(s) for s in SUB_TASKS])
    nt = (i % 3 + 1).cast("int")
    s0 = (i % len(SUB_TASKS)).cast("int")
    s1 = (F.floor(i / 7).cast("long") % len(SUB_TASKS)).cast("int")
    return p.select(
        i.alias("id"),
        F.when(i % 4 == 0, F.lit("en")).otherwise(F.lit("ja")).alias("lang"),
        F.slice(tasks, 1, nt).alias("tasks"),
        F.array_distinct(F.array(F.get(subs, s0), F.get(subs, s1))).alias("sub_tasks"),
    )


_REQ_SQL = f"""
req AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'en' ELSE 'ja' END AS lang,
         [{', '.join(O.lit(t) for t in TASKS)}][1:CAST(p_partkey % 3 + 1 AS INTEGER)] AS tasks,
         [{', '.join(O.lit(s) for s in SUB_TASKS)}][p_partkey % {len(SUB_TASKS)} + 1] AS s0,
         [{', '.join(O.lit(s) for s in SUB_TASKS)}][(p_partkey // 7) % {len(SUB_TASKS)} + 1] AS s1
  FROM part),
matrix AS (
  SELECT id, lang, unnest(tasks) AS task, sub_task
  FROM (SELECT id, lang, tasks, unnest(list_distinct([s0, s1])) AS sub_task FROM req))"""


def _registry_sql() -> str:
    rows = []
    for lang, task, sub_task, sst, ds, fs, _gp in R.default_registry_rows():
        rows.append(f"({O.lit(lang)}, {O.lit(task)}, {O.lit(sub_task)}, "
                    f"{O.lit(sst) if sst else 'CAST(NULL AS VARCHAR)'}, {O.lit(ds)}, {O.lit(fs)})")
    return "registry(lang, task, sub_task, sub_subtask, dataset_path, few_shot_path) AS (VALUES " + ", ".join(rows) + ")"


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_matrix(requests(spark, sf), "tasks", "sub_tasks")


@register("run_matrix", O.with_(_REQ_SQL) + "SELECT id, lang, task, sub_task FROM matrix")
def run_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(spark, sf).select("id", "lang", "task", "sub_task")


@register("resolve_runs", O.with_(_REQ_SQL, _registry_sql()) + """
SELECT m.id, m.lang, m.task, m.sub_task, r.sub_subtask, r.dataset_path, r.few_shot_path
FROM matrix m JOIN registry r ON m.lang = r.lang AND m.task = r.task AND m.sub_task = r.sub_task""")
def resolve_runs(spark: SparkSession, sf: str) -> DataFrame:
    resolved, _ = R.resolve_runs(matrix(spark, sf), R.registry(spark))
    return resolved.select("id", "lang", "task", "sub_task", "sub_subtask", "dataset_path", "few_shot_path")


@register("missing_runs", O.with_(_REQ_SQL, _registry_sql()) + """
SELECT m.id, m.lang, m.task, m.sub_task FROM matrix m
WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE m.lang = r.lang AND m.task = r.task AND m.sub_task = r.sub_task)""")
def missing_runs(spark: SparkSession, sf: str) -> DataFrame:
    _, missing = R.resolve_runs(matrix(spark, sf), R.registry(spark))
    return missing.select("id", "lang", "task", "sub_task")
