"""``evaluate``: the whole evaluation of one model, as the command line ran it.

    scores = evaluate(spark, tasks=["perception", "taxonomic"], sub_tasks=["selection", "yes_no_classification"],
                      lang="ja", model_type="api", model_name="gpt-4o", make_responder=MyResponder,
                      save_dir="s3://bucket/eval", data_root="s3://bucket/data")

1. every requested task x sub_task is checked against the registry first
   (unknown combinations raise before anything runs);
2. for each valid combination, the item files of its sub_subtasks are read
   with the task's explicit schema and concatenated with a ``sub_subtask``
   column, and its few-shot files become one few-shot set per sub_subtask;
3. the combination's plan runs (prompt -> responder -> persisted results ->
   scores); results and scores land in ``{save_dir}/results`` and
   ``{save_dir}/scores``, partitioned by run.

The registry rows (at most a handful per combination) are read on the driver;
item rows never are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions import prompts as C
from evalframe.functions.routing import route_model
from evalframe.operators import assets as AS
from evalframe.operators import fewshot as FS
from evalframe.operators import runs as R
from evalframe.plans import task_plans as PL
from evalframe.schemas import ITEM_SCHEMAS
from evalframe.session import apply_required_conf
from evalframe.sinks import writers as W
from evalframe.sinks.run_table import RUN_COLUMNS, RunTable
from evalframe.sources import readers as RD

SCORE_COLUMNS = ("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name", "accuracy",
                 "average_distance", "n_distance", "n_rows", "n_invalid", "n_error")


def _read_items(spark: SparkSession, path: str, schema: T.StructType, rename: Mapping[str, str] | None) -> DataFrame:
    if not rename:
        return RD.read_dataset(spark, path, schema)
    back = {v: k for k, v in rename.items()}
    file_schema = T.StructType([T.StructField(back.get(f.name, f.name), f.dataType, True) for f in schema.fields])
    return RD.read_dataset(spark, path, file_schema).withColumnsRenamed(dict(rename))


def _score_frame(df: DataFrame) -> DataFrame:
    cols = {"average_distance": F.lit(None).cast("double"), "n_distance": F.lit(0).cast("long")}
    df = df.withColumns({k: v for k, v in cols.items() if k not in df.columns})
    return df.select(*SCORE_COLUMNS)


FAMILY_OF_SUB_TASK = {"selection": "selection", "generation": "generation"}


def _export(spark: SparkSession, results: str | RunTable, out: str, combos: list, model_type: str, model_name: str) -> None:
    """JSON Lines export of this call's runs, one family at a time."""
    for lg, task, sub_task in combos:
        family = FAMILY_OF_SUB_TASK.get(sub_task, "classification")
        run = dict(zip(RUN_COLUMNS, (task, sub_task, lg, model_type, model_name)))
        if isinstance(results, RunTable):
            mine = results.current(run).drop("item_key", "item_copy")
        else:
            mine = W.read_results(spark, results, fmt="parquet")
            for column, value in run.items():
                mine = mine.where(F.col(column) == value)
        W.export_jsonl(mine.drop("call"), out, family)


def _commit_scores(spark: SparkSession, scores: DataFrame, combos: list, model_type: str, model_name: str, root: str,
                   sub_subtasks: Sequence[str] | None) -> DataFrame:
    """Each combination's scores as a commit that replaces its earlier ones."""
    table, out = RunTable(spark, root), None
    for lg, task, sub_task in combos:
        run = dict(zip(RUN_COLUMNS, (task, sub_task, lg, model_type, model_name)))
        mine = scores.where((F.col("task") == task) & (F.col("sub_task") == sub_task)).withColumn("error", F.lit(None).cast("string"))
        table.commit(table.copies(mine, ["sub_subtask"]), run, table.log(), True, sub_subtasks)
        kept = table.current(run).select(*scores.columns)
        if sub_subtasks is not None:
            kept = kept.where(F.col("sub_subtask").isNull() | F.col("sub_subtask").isin(list(sub_subtasks)))
        out = kept if out is None else out.unionByName(kept)
    return out


def _require_images(spark: SparkSession, items: DataFrame, image_dir: str) -> None:
    """Every image of items and examples is listed under ``image_dir`` (E3);
    URLs are not probed."""
    shots = F.flatten(F.transform("few_shot", lambda x: F.coalesce(x["images"], F.array().cast("array<string>"))))
    named = F.array_distinct(F.concat(F.coalesce("image", F.array().cast("array<string>")), shots))
    refs = AS.explode_refs(items.select(F.lit(0).alias("item"), named.alias("images")), "item", "images", image_dir)
    missing = AS.missing_assets(refs.select("path").distinct(), AS.read_assets(spark, image_dir, with_content=False))
    n, example = missing.agg(F.count("path"), F.min("path")).first()
    if n:
        raise FileNotFoundError(f"{n} image files are missing, such as {example}")


def evaluate(spark: SparkSession, tasks: Sequence[str], sub_tasks: Sequence[str], lang: str, model_type: str,
             model_name: str, make_responder: Callable[[], Any], save_dir: str, data_root: str = "data",
             registry_rows: Sequence[tuple] | None = None, family: str | None = "route", image_dir: str | None = None,
             sub_subtasks: Sequence[str] | None = None, rename: Mapping[str, str] | None = None,
             strict: bool = False, max_parallel: int = 1, resume: bool = False,
             export_jsonl: bool = False, system_texts: Mapping[tuple[str, str], Mapping[str, str]] | None = None,
             templates: Mapping[tuple[str, str], Mapping[str, str]] | None = None,
             check_images: bool = True, isolated: bool = False) -> DataFrame | None:
    """Run every requested (task, sub_task) for one model and language.

    Returns the score rows of the scored combinations (generation has none),
    read back from ``{save_dir}/scores``; ``None`` if only generation ran.
    The model's request family is routed from its name (an unsupported model
    raises) unless ``family`` names one; ``None`` is no family's profile.  Runs
    are tagged with the model's base name.  ``system_texts`` and ``templates``
    give instruction texts and prompt templates by ``(task, lang)``; names that
    are not given keep the defaults of that language.  With an
    ``image_dir``, image files that items or examples name and that are not
    there fail a run before the model is called (unless ``check_images`` is off).
    ``max_parallel > 1`` runs that many combinations concurrently.
    ``export_jsonl=True`` also writes each run's result rows to
    ``{save_dir}/jsonl`` as JSON Lines with the task family's answer-column
    names.  ``resume=True`` answers only items missing from ``{save_dir}/results``
    (keyed by sub_subtask and the item id) and appends them; it runs the
    combinations one after another, since appends to one table from
    concurrent jobs are not isolated the way partition overwrites are.
    ``isolated=True`` keeps the results in commits (``sinks.run_table``): then
    resumed runs may be concurrent, in one call or in several, and a run that
    is killed while it writes leaves nothing behind that is read.
    """
    apply_required_conf(spark)
    if family == "route":
        family, base_name = spark.range(1).select(route_model(F.lit(model_name), F.lit(model_type)),
                                                  C.model_basename(F.lit(model_name))).first()
        if family is None:
            raise ValueError(f"model {model_name!r} is not supported for {model_type}")
    else:
        base_name = spark.range(1).select(C.model_basename(F.lit(model_name))).first()[0]
    model_name = base_name
    if resume and max_parallel > 1 and not isolated:
        raise ValueError("resume appends to the result table: use max_parallel=1, or isolated=True")
    reg = R.registry(spark, registry_rows, data_root)
    req = spark.createDataFrame([(lang, list(tasks), list(sub_tasks))],
                                "lang string, tasks array<string>, sub_tasks array<string>")
    resolved, missing = R.resolve_runs(R.run_matrix(req), reg)
    R.require_all_resolved(missing)

    by_combo: dict[tuple[str, str, str], list] = defaultdict(list)
    for r in resolved.collect():   # configuration rows, bounded by the registry
        if sub_subtasks is None or r["sub_subtask"] is None or r["sub_subtask"] in sub_subtasks:
            by_combo[(r["lang"], r["task"], r["sub_task"])].append(r)

    results_root, scores_root = f"{save_dir.rstrip('/')}/results", f"{save_dir.rstrip('/')}/scores"

    results: str | RunTable = RunTable(spark, results_root) if isolated else results_root

    def run_combo(item: tuple[tuple[str, str, str], list]) -> DataFrame | None:
        (lg, task, sub_task), rows = item
        schema = ITEM_SCHEMAS[(task, sub_task)]
        items = None
        examples = None
        for r in rows:
            it = _read_items(spark, r["dataset_path"], schema, rename).withColumn(
                "sub_subtask", F.lit(r["sub_subtask"]).cast("string"))
            ex = RD.read_few_shot(spark, r["few_shot_path"]).withColumn(
                PL.FEW_SHOT_KEY, F.lit(r["sub_subtask"] or ""))
            items = it if items is None else items.unionByName(it)
            examples = ex if examples is None else examples.unionByName(ex)
        items = items.withColumn(PL.FEW_SHOT_KEY, F.coalesce("sub_subtask", F.lit("")))
        sets = FS.few_shot_sets(examples, [PL.FEW_SHOT_KEY])
        if image_dir and check_images and "image" in items.columns:
            _require_images(spark, FS.attach_few_shot(items, sets, [PL.FEW_SHOT_KEY]), image_dir)
        gp = rows[0]["gen_params"].asDict() if rows[0]["gen_params"] is not None else None
        run = PL.Run(task=task, sub_task=sub_task, lang=lg, model_type=model_type, model_name=model_name,
                     family=family, gen_params=gp, image_dir=image_dir,
                     system_texts=C.system_texts(lg) | dict((system_texts or {}).get((task, lg), {})),
                     templates=C.templates(lg) | dict((templates or {}).get((task, lg), {})))
        keep = [f.name for f in schema.fields] + ["sub_subtask"]
        # an item is known by all its columns: ids may be null or shared
        common = dict(results_root=results, keep=keep, resume=resume, resume_keys=keep, few_shot=sets, few_shot_keys=[PL.FEW_SHOT_KEY])
        if sub_task == "generation":
            PL.eval_generation(spark, items, run, make_responder, with_images=(task == "perception"), **common)
            return None
        if sub_task == "selection":
            out = PL.eval_selection(spark, items, run, make_responder, sub_subtasks=sub_subtasks, **common)
        elif sub_task == "multiple_choice_classification":
            out = PL.eval_selection(spark, items, run, make_responder, multi_choice=True, sub_subtasks=sub_subtasks, **common)
        elif sub_task == "classification":
            votes = "naturalness_by_worker" if lg == "ja" else None
            out = PL.eval_pair_rating(spark, items, run, make_responder, votes_col=votes, **common)
        elif sub_task == "yes_no_classification":
            out = PL.eval_yes_no(spark, items, run, make_responder, strict=strict, **common)
        elif sub_task == "a_b_classification":
            out = PL.eval_a_b(spark, items, run, make_responder, strict=strict, **common)
        else:
            raise ValueError(f"no plan for {task}/{sub_task}")
        return _score_frame(out)

    # Each combination writes its own partitions of the result table (dynamic
    # partition overwrite stages every job separately), so combinations may
    # run concurrently and share the cluster; scores are written once, after.
    combos = sorted(by_combo.items())
    if max_parallel > 1 and len(combos) > 1:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max_workers=max_parallel) as pool:
            outs = list(pool.map(run_combo, combos))
    else:
        outs = [run_combo(c) for c in combos]
    scores: DataFrame | None = None
    for out in outs:
        if out is not None:
            scores = out if scores is None else scores.unionByName(out)
    if export_jsonl:
        _export(spark, results, f"{save_dir.rstrip('/')}/jsonl", list(by_combo), model_type, model_name)
    if scores is None:
        return None
    if isolated:
        return _commit_scores(spark, scores, [c for c in by_combo if FAMILY_OF_SUB_TASK.get(c[2]) != "generation"], model_type, model_name,
                              scores_root, sub_subtasks)
    W.write_scores(scores, scores_root)
    back = W.read_results(spark, scores_root, scores.schema)
    mine = F.lit(False)
    for lg, task, sub_task in by_combo:
        mine = mine | ((F.col("lang") == lg) & (F.col("task") == task) & (F.col("sub_task") == sub_task))
    if sub_subtasks is not None:
        mine = mine & (F.col("sub_subtask").isNull() | F.col("sub_subtask").isin(list(sub_subtasks)))
    return back.where(mine & (F.col("model_type") == model_type) & (F.col("model_name") == model_name))
