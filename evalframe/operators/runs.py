"""Run registry (A7), run matrix (J1), resolution (J2), sub_subtask union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.constants import DEFAULT_GEN_PARAMS, MULTI_CHOICE_SUB_SUBTASKS, SELECTION_SUB_SUBTASKS, TASK_COMBINATIONS

GEN_PARAMS_TYPE = T.StructType([
    T.StructField("max_new_tokens", T.IntegerType()),
    T.StructField("do_sample", T.BooleanType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("num_beams", T.IntegerType()),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("lang", T.StringType(), False),
    T.StructField("task", T.StringType(), False),
    T.StructField("sub_task", T.StringType(), False),
    T.StructField("sub_subtask", T.StringType(), True),
    T.StructField("dataset_path", T.StringType(), False),
    T.StructField("few_shot_path", T.StringType(), False),
    T.StructField("gen_params", GEN_PARAMS_TYPE, False),
])


def _sub_subtasks(task: str, sub_task: str) -> Sequence[str | None]:
    if (task, sub_task) == ("perception", "selection"):
        return SELECTION_SUB_SUBTASKS
    if (task, sub_task) == ("taxonomic", "multiple_choice_classification"):
        return MULTI_CHOICE_SUB_SUBTASKS
    return (None,)


def default_registry_rows(data_root: str = "data") -> list[tuple]:
    """Registry rows for the nine valid (lang, task, sub_task) combinations;
    dataset paths follow ``{root}/{task}/{sub_task}/[{sub_subtask}/]{lang}.jsonl``."""
    rows = []
    gp = tuple(DEFAULT_GEN_PARAMS[f.name] for f in GEN_PARAMS_TYPE.fields)
    for lang, task, sub_task in TASK_COMBINATIONS:
        for sst in _sub_subtasks(task, sub_task):
            base = f"{data_root}/{task}/{sub_task}" + (f"/{sst}" if sst else "")
            rows.append((lang, task, sub_task, sst, f"{base}/{lang}.jsonl", f"{base}/few_shot_{lang}.jsonl", gp))
    return rows


def registry(spark: SparkSession, rows: Sequence[tuple] | None = None, data_root: str = "data") -> DataFrame:
    """The task registry as a small DataFrame (A7): one row per runnable
    (lang, task, sub_task, sub_subtask).  Its size is fixed by configuration."""
    return spark.createDataFrame(list(rows) if rows is not None else default_registry_rows(data_root), REGISTRY_SCHEMA)


def run_matrix(requests: DataFrame, tasks_col: str = "tasks", sub_tasks_col: str = "sub_tasks") -> DataFrame:
    """Every requested task x every requested sub_task.

    Each request row carries its own short lists (bounded by the task label
    space), so the product is a per-row expansion with ``explode``; no join.
    """
    return (requests.withColumn("task", F.explode(tasks_col))
            .withColumn("sub_task", F.explode(sub_tasks_col))
            .drop(tasks_col, sub_tasks_col))


def resolve_runs(requests: DataFrame, reg: DataFrame, keys: Sequence[str] = ("lang", "task", "sub_task")) -> tuple[DataFrame, DataFrame]:
    """Look up each request in the registry.

    Returns ``(resolved, missing)``: the equi-join with the registry (AQE
    broadcasts it by its measured size) and the requests without a registry
    entry (``left_anti``).  Check ``missing`` before running anything;
    the harness only failed midway.
    """
    resolved = requests.join(reg, list(keys), "inner")
    missing = requests.join(reg.select(*keys).distinct(), list(keys), "left_anti")
    return resolved, missing


def require_all_resolved(missing: DataFrame) -> None:
    """Raise listing the unresolvable requests (the request bounds their number)."""
    unknown = sorted(missing.distinct().collect())
    if unknown:
        raise ValueError(f"unknown task combinations: {[tuple(r) for r in unknown]}")


def union_sub_subtasks(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Concatenate per-sub_subtask datasets with a ``sub_subtask`` column (J4);
    bag semantics, missing columns filled with null."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("sub_subtask", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
