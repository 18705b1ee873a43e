"""End-to-end evaluation plans.

Every plan has the same shape:

    items -> prompt / system / few-shot / conversation columns (map-side)
          -> responder (mapInPandas, once per row)
          -> parse + tag -> WRITE the result table (partitioned by run)
          -> read the written rows back -> score (one partial+final aggregate)
          -> write the score table

The result table is Parquet by default (typed, columnar, splittable; set
``RESULTS_FORMAT = "json"`` or export with ``sinks.writers.write_jsonl`` for
JSON Lines).  The write in the middle is deliberate: the model call is the expensive,
non-deterministic step, so its output is persisted once and everything after
it reads the persisted rows.  A lazy plan with two actions would call the
model twice, and a lost executor after the write costs nothing but a re-read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions import assets as A
from evalframe.functions import chat as D
from evalframe.functions import params as GP
from evalframe.functions import parsing as P
from evalframe.functions import prompts as C
from evalframe.functions import requests as R
from evalframe.functions import stats as ST
from evalframe.operators import fewshot as FS
from evalframe.operators import metrics as M
from evalframe.operators.joins import unused_name
from evalframe.operators.respond import respond
from evalframe.session import scratch_dir
from evalframe.sinks import writers as W
from evalframe.sinks.run_table import KEYS, RUN_COLUMNS, RunTable


@dataclass
class Run:
    """Run metadata; becomes the result table's partition columns."""
    task: str
    sub_task: str
    lang: str
    model_type: str
    model_name: str
    family: str | None = None
    gen_params: dict[str, Any] | None = None
    image_dir: str | None = None
    system_texts: dict[str, str] = field(default_factory=lambda: dict(C.SYSTEM_TEXTS))
    templates: dict[str, str] = field(default_factory=lambda: dict(C.TEMPLATES))


# A key that items and sets have for their join alone.
FEW_SHOT_KEY = "_fs_key"
# Messages of a request before and after its examples', as the responder gets them.
BEFORE, AFTER = "_messages_before", "_messages_after"


def _with_few_shot(items: DataFrame, few_shot: DataFrame | None, keys: Sequence[str], run: Run, typed: bool = True,
                   tasks: int = 0) -> DataFrame:
    """The items with their examples, in ``tasks`` partitions (0: as they come).
    Images are resolved and messages written where there is one row a set."""
    if few_shot is None:
        dealt = items.repartition(tasks) if tasks else items
        if "few_shot" in items.columns:   # attached by the caller
            return dealt
        return dealt.withColumns({"few_shot": F.array().cast(FS.FEW_SHOT_TYPE), FS.MESSAGES_JSON: F.lit("[]")})
    if run.image_dir:
        few_shot = few_shot.withColumn("few_shot", _resolved_examples(run.image_dir))
    sets = FS.with_messages_json(few_shot, R.part_form(run.family, typed))
    out = FS.deal_with_few_shot(items, sets, keys, tasks) if tasks else FS.attach_few_shot(items, sets, keys)
    return out.drop(FEW_SHOT_KEY)


RESULTS_FORMAT = "parquet"


def _resolved(image_dir: str, paths: Column) -> Column:
    """Paths relative to the run's image directory, URLs untouched."""
    return F.transform(paths, lambda x: F.when(A.is_url(x), x).otherwise(A.resolve_path(F.lit(image_dir), x)))


def _resolved_examples(image_dir: str) -> Column:
    return F.transform("few_shot", lambda x: x.withField("images", _resolved(image_dir, x["images"])))


def _with_resolved_images(prompted: DataFrame, run: Run, images_col: str | None) -> DataFrame:
    """Images of items, and of few-shot examples that the caller attached,
    resolved before any message is built of them; image bytes never shuffle:
    the responder reads them at the call site."""
    if not run.image_dir:
        return prompted
    cols = {images_col: _resolved(run.image_dir, F.col(images_col))} if images_col else {}
    if "few_shot" in prompted.columns and FS.MESSAGES_JSON not in prompted.columns:
        cols["few_shot"] = _resolved_examples(run.image_dir)
    return prompted.withColumns(cols)


def _request_columns(prompted: DataFrame, run: Run, images_col: str | None, typed: bool) -> tuple[DataFrame, str | None]:
    """Messages, the prompt sent, the images sent and the placeholder check;
    also the messages ``BEFORE`` and ``AFTER`` the examples' where these are
    written once a set.

    With ``run.family`` set (see ``functions.routing.route_model``) the
    family's request profile decides system handling, placeholder handling
    and the chat format; otherwise part-form (``typed``) or text-form
    messages with a system turn are built and the prompt is the rendered item
    text.
    """
    prompted = _with_resolved_images(prompted, run, images_col)
    around = R.around_few_shot(run.family, "system", "zero_shot", images_col, typed)
    pieces = dict(zip((BEFORE, AFTER), around)) if around is not None and FS.MESSAGES_JSON in prompted.columns else {}
    if run.family:
        cols = R.prepare_request(run.family, "system", "few_shot", "zero_shot", images_col)
        return prompted.withColumns(cols | pieces).withColumn("prompt", F.coalesce("prompt_text", "zero_shot")), "request_images"
    msgs = D.conversation("system", "few_shot", "zero_shot", images_col if typed else None, typed=typed)
    error = D.placeholder_error(F.col("zero_shot"), F.col(images_col)) if images_col and typed else F.lit(False)
    return prompted.withColumns({"messages": msgs, "prompt": F.col("zero_shot"), "placeholder_error": error} | pieces), images_col


def _table_exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def _done_keys(spark: SparkSession, root: str, run: Run, keys: Sequence[str], fmt: str) -> DataFrame | None:
    """Keys of the items answered for this run in an existing result table
    (rows of failed calls are not answers).  ``None`` only if there is no
    table; a table that cannot be read, or lacks a key, is an error."""
    if not _table_exists(spark, root):
        return None
    prior = W.read_results(spark, root, fmt=fmt)
    flt = F.col("error").isNull()
    for k in ("task", "sub_task", "lang", "model_type", "model_name"):
        flt = flt & (F.col(k) == getattr(run, k))
    return prior.where(flt).select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()


def _skip_done(prompted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left_anti`` on the keys, null-safe (``sub_subtask`` is null outside
    selection and multiple choice)."""
    cond = None
    for k in keys:
        c = prompted[k].eqNullSafe(done[f"_done_{k}"])
        cond = c if cond is None else cond & c
    return prompted.join(done, cond, "left_anti")


def _respond_and_persist(spark: SparkSession, items: DataFrame, run: Run, make_responder: Callable[[], Any],
                         results_root: str | RunTable | None, keep: Sequence[str], images_col: str | None = None,
                         responder_partitions: int | None = None, results_format: str | None = None,
                         typed: bool = True, resume: bool = False,
                         resume_keys: Sequence[str] | None = None,
                         sub_subtasks: Sequence[str] | None = None,
                         derive: Callable[[DataFrame], DataFrame] | None = None, texts: dict[str, Column] | None = None,
                         few_shot: DataFrame | None = None, few_shot_keys: Sequence[str] = ()) -> DataFrame:
    """Request assembly -> responder -> parse -> tag -> write; returns the
    written rows of this run, re-read.

    The items that are left to ask are dealt to the responder's tasks first;
    they get their examples, their ``texts`` (``zero_shot``, ``system``) and
    messages where they are asked, so none of these is shuffled.
    Only the columns the result table keeps, the prompt, and what the
    responder declares it reads cross into Python; nested few-shot arrays and
    messages stay in the JVM unless the responder asks for them.  Rows whose
    text has more image placeholders than images are not sent (error
    ``placeholder_mismatch``; the harness raised).  ``resume=True`` skips keys
    already in this run's results (null-safe ``left_anti`` on ``resume_keys``,
    default all kept item columns) and appends, so a re-run after a crash calls
    the model only for the missing rows; failed rows are asked again, and of
    failed rows only this call's are read back (``call`` names the call that
    wrote a row).  A model that does not exist for any row of this call fails
    the run.  With a ``RunTable`` for ``results_root`` the rows are committed to
    it, isolated from other writers, and items are known by their digest and
    copy.  Columns that ``derive`` adds to the parsed rows are saved with them.
    """
    root = results_root or scratch_dir(spark, "results")
    fmt = results_format or RESULTS_FORMAT
    table, call = (root if isinstance(root, RunTable) else None), uuid.uuid4().hex
    rkeys = list(resume_keys or keep)
    if table is not None:
        seen, known = table.log(), {k: getattr(run, k) for k in RUN_COLUMNS}
        items = table.copies(items, rkeys)
        keep = [*keep, *KEYS]
        if resume:
            items = table.pending(items, known, seen)
    elif resume:
        done = _done_keys(spark, root, run, rkeys, fmt)
        if done is not None:
            items = _skip_done(items, done, rkeys)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if responder_partitions is None else responder_partitions
    prompted = _with_few_shot(items, few_shot, few_shot_keys, run, typed, tasks).withColumns(texts or {})
    req, sent_images = _request_columns(prompted, run, images_col, typed)
    # normalised once for the backend exactly as the wrapper would
    gen_params = GP.normalized_params(run.gen_params, run.model_type, run.model_name) if run.gen_params is not None else None
    wants_messages = getattr(make_responder, "wants_messages", True)
    inputs = getattr(make_responder, "input_columns", None)
    if inputs is None:
        inputs = [c for c in prompted.columns if c not in ("messages", "few_shot", FS.MESSAGES_JSON, *KEYS)]
    apart = BEFORE in req.columns and "messages" not in (*keep, *inputs)
    messages = ([BEFORE, FS.MESSAGES_JSON, AFTER] if apart else ["messages"]) if wants_messages else []
    needed = list(dict.fromkeys(list(keep) + ["zero_shot", "prompt", "placeholder_error"] + list(inputs)
                                + ([sent_images] if sent_images else []) + messages))
    narrow = req.select(*needed)
    answered = respond(narrow, make_responder, prompt_col="prompt", images_col=sent_images,
                       messages_col=messages if apart else next(iter(messages), None), pass_columns=list(inputs),
                       skip_col="placeholder_error", partitions=0, gen_params=gen_params, returned=[*keep, "zero_shot"])
    parsed = answered.withColumn("parsed", P.extract_choice("raw_response"))
    answer_columns = parsed.columns
    if derive is not None:
        parsed = derive(parsed)
    derived = [c for c in parsed.columns if c not in answer_columns]
    tagged = C.tag_run(parsed, task=run.task, sub_task=run.sub_task, lang=run.lang, model_type=run.model_type,
                       model_name=run.model_name).withColumn("call", F.lit(call))
    cols = list(dict.fromkeys(list(keep) + ["zero_shot", "raw_response", "parsed", "attempts", "error", "call", *derived]
                              + list(W.RESULT_PARTITIONS)))
    out = tagged.select(*cols)
    if table is not None:
        written = table.commit(out, known, seen, replaces=not resume, sub_subtasks=sub_subtasks)
        _require_model(run, spark.read.schema(out.schema).parquet(f"{table.root}/rows/commit={written}"))
        return C.select_sub_subtasks(table.current(known, out.schema), sub_subtasks)
    W.write_results(out, root, fmt=fmt, mode="append" if resume else "overwrite")
    back = W.read_results(spark, root, out.schema, fmt=fmt)
    mine = back.where((F.col("task") == run.task) & (F.col("sub_task") == run.sub_task) & (F.col("lang") == run.lang)
                      & (F.col("model_type") == run.model_type) & (F.col("model_name") == run.model_name))
    if sub_subtasks is not None:  # earlier runs of other sub_subtasks lie in the same table
        mine = C.select_sub_subtasks(mine, sub_subtasks)
    asked = mine.where(F.col("call") == call)
    _require_model(run, asked)
    if resume:  # what failed before was asked again
        mine = mine.where("error IS NULL").unionByName(asked.where("error IS NOT NULL"))
    return mine


def _require_model(run: Run, written: DataFrame) -> None:
    gone = written.where(F.col("error").startswith("not_found")).select("error").first()
    if gone is not None:
        raise RuntimeError(f"{run.model_name}: {gone['error']}")


def _finish_scores(spark: SparkSession, scores: DataFrame, scores_root: str | None) -> DataFrame:
    if scores_root is None:
        return scores
    W.write_scores(scores, scores_root)
    return W.read_results(spark, scores_root, scores.schema)


# ---------------------------------------------------------------------------
# P1 selection, P7 multiple choice
# ---------------------------------------------------------------------------

def eval_selection(spark: SparkSession, items: DataFrame, run: Run, make_responder: Callable[[], Any],
                   few_shot: DataFrame | None = None, few_shot_keys: Sequence[str] = ("sub_subtask",),
                   sub_subtasks: Sequence[str] | None = None, results_root: str | None = None,
                   scores_root: str | None = None, keep: Sequence[str] = ("id",), multi_choice: bool = False,
                   responder_partitions: int | None = None, resume: bool = False,
                   resume_keys: Sequence[str] | None = None) -> DataFrame:
    """Choice selection (P1) / multiple choice (P7): accuracy per sub_subtask.

    ``items`` has ``sub_subtask``, ``object`` (selection), ``all_ids_with_term``,
    ``correct_ids`` and optionally ``image``.
    """
    items = C.select_sub_subtasks(items, sub_subtasks)
    if multi_choice:
        zero_shot = C.prompt_multi_choice("all_ids_with_term", run.templates["multi_choice"])
        system = F.lit(run.system_texts["multi_choice"])
    else:
        zero_shot = C.prompt_selection("object", "all_ids_with_term", run.templates["selection"])
        system = C.system_instruction("sub_subtask", run.system_texts["selection"], run.system_texts["selection_random"])
    images = "image" if "image" in items.columns else None
    texts = {"zero_shot": zero_shot, "system": system}
    keep = list(dict.fromkeys(list(keep) + ["sub_subtask", "correct_ids"]))
    results = _respond_and_persist(spark, items, run, make_responder, results_root, keep, images, responder_partitions,
                                   texts=texts, few_shot=few_shot, few_shot_keys=few_shot_keys, resume=resume, resume_keys=resume_keys, sub_subtasks=sub_subtasks)
    scored = results.select(*M.RUN_KEYS, "error", P.gold_or_none("correct_ids").alias("gold"),
                            (P.code_int("parsed") if multi_choice else P.code_selection("parsed")).alias("pred"))
    return _finish_scores(spark, M.accuracy(scored, by=list(M.RUN_KEYS), error="error"), scores_root)


# ---------------------------------------------------------------------------
# P2 generation
# ---------------------------------------------------------------------------

def eval_generation(spark: SparkSession, items: DataFrame, run: Run, make_responder: Callable[[], Any],
                    few_shot: DataFrame | None = None, few_shot_keys: Sequence[str] = (),
                    results_root: str | None = None, keep: Sequence[str] = ("id", "object"),
                    with_images: bool = False, resume: bool = False,
                    resume_keys: Sequence[str] | None = None) -> DataFrame:
    """Free-text generation (P2): results only, no metric.  Perception items
    carry ``image`` (mandatory there); commonsense items have none."""
    if with_images and "image" not in items.columns:
        raise ValueError("perception generation items need an 'image' column")
    images = "image" if with_images else None
    texts = {
        "zero_shot": C.prompt_generation("object", run.templates["generation"]),
        "system": F.lit(run.system_texts["generation"]),
    }
    results = _respond_and_persist(spark, items, run, make_responder, results_root, keep, images,
                                   texts=texts, few_shot=few_shot, few_shot_keys=few_shot_keys, resume=resume, resume_keys=resume_keys)
    return C.answer_columns(results, "generation")


# ---------------------------------------------------------------------------
# P3 / P4 pair rating
# ---------------------------------------------------------------------------

def _with_row_distance(votes_col: str) -> Callable[[DataFrame], DataFrame]:
    """Each row's vote-distribution distance, where the item has its votes (H7)."""
    def derive(df: DataFrame) -> DataFrame:
        stats = [unused_name(n, df.columns) for n in ("_vote_mean", "_vote_sd", "_unanimous")]
        known = df.withColumns(dict(zip(stats, (ST.vote_mean_array(votes_col), ST.vote_std_array(votes_col), ST.vote_unanimous_array(votes_col)))))
        return known.withColumn("distribution_distance", ST.distribution_distance(
            P.gold_label("naturalness"), P.code_int("parsed"), *stats)).drop(*stats)
    return derive


def eval_pair_rating(spark: SparkSession, items: DataFrame, run: Run, make_responder: Callable[[], Any],
                     votes: DataFrame | None = None, few_shot: DataFrame | None = None,
                     few_shot_keys: Sequence[str] = (), results_root: str | None = None,
                     scores_root: str | None = None, keep: Sequence[str] = ("id",), resume: bool = False,
                     resume_keys: Sequence[str] | None = None, votes_col: str | None = None) -> DataFrame:
    """Pair rating: accuracy (P4) and, with votes, the vote-distribution
    distance and its average (P3).  Votes come either long-form as ``votes``
    (``item``, ``vote``; aggregated per item) or as an array column of each
    item (``votes_col``, e.g. ``naturalness_by_worker``; no grouping at all).

    ``items`` has ``id``, ``object``, ``term`` and ``naturalness`` (gold).
    Votes are aggregated per item (partial aggregation) and joined on the item
    key; both sides are hash-partitioned on it, so the join adds one shuffle of
    the item side only.
    """
    texts = {
        "zero_shot": C.prompt_pair_rating("object", "term", F.lit(run.lang),
                                          {run.lang: run.templates[f"pair_rating_{run.lang}"]}),
        "system": F.lit(run.system_texts["pair_rating"]),
    }
    keep = list(dict.fromkeys(list(keep) + ["naturalness"] + ([votes_col] if votes_col else [])))
    results = _respond_and_persist(spark, items, run, make_responder, results_root, keep, typed=False,
                                   texts=texts, few_shot=few_shot, few_shot_keys=few_shot_keys, resume=resume, resume_keys=resume_keys,
                                   derive=_with_row_distance(votes_col) if votes_col else None)
    scored = results.select("id", *M.RUN_KEYS, "error", P.gold_label("naturalness").alias("gold"), P.code_int("parsed").alias("pred"),
                            *([votes_col] if votes_col else []))
    if votes_col:
        with_d = scored.withColumns({"vote_mean": ST.vote_mean_array(votes_col), "vote_sd": ST.vote_std_array(votes_col),
                                     "unanimous": ST.vote_unanimous_array(votes_col)})
        return _finish_scores(spark, M.distance_scores(M.with_distance(with_d), by=list(M.RUN_KEYS), error="error"), scores_root)
    if votes is None:
        return _finish_scores(spark, M.accuracy(scored, by=list(M.RUN_KEYS), error="error"), scores_root)
    stats = M.vote_stats(votes).withColumnRenamed("item", "id")
    with_d = M.with_distance(scored.join(stats, "id", "left"))
    scores = M.distance_scores(with_d, by=list(M.RUN_KEYS), error="error")
    return _finish_scores(spark, scores, scores_root)


# ---------------------------------------------------------------------------
# P5 yes/no, P6 A/B
# ---------------------------------------------------------------------------

def eval_yes_no(spark: SparkSession, items: DataFrame, run: Run, make_responder: Callable[[], Any],
                few_shot: DataFrame | None = None, few_shot_keys: Sequence[str] = (),
                results_root: str | None = None, scores_root: str | None = None, keep: Sequence[str] = ("id",),
                strict: bool = False, resume: bool = False, resume_keys: Sequence[str] | None = None) -> DataFrame:
    """Yes/no classification (P5): ``items`` has ``term`` and ``label`` (0/1)."""
    texts = {
        "zero_shot": C.prompt_yes_no("term", run.templates["yes_no"]),
        "system": F.lit(run.system_texts["yes_no"]),
    }
    results = _respond_and_persist(spark, items, run, make_responder, results_root, list(keep) + ["label"],
                                   texts=texts, few_shot=few_shot, few_shot_keys=few_shot_keys, typed=False, resume=resume, resume_keys=resume_keys)
    scored = results.select(*M.RUN_KEYS, "error", P.gold_label("label").alias("gold"), P.code_yes_no("parsed", strict).alias("pred"))
    return _finish_scores(spark, M.accuracy(scored, by=list(M.RUN_KEYS), error="error"), scores_root)


def eval_a_b(spark: SparkSession, items: DataFrame, run: Run, make_responder: Callable[[], Any],
             few_shot: DataFrame | None = None, few_shot_keys: Sequence[str] = (),
             results_root: str | None = None, scores_root: str | None = None, keep: Sequence[str] = ("id",),
             strict: bool = False, resume: bool = False, resume_keys: Sequence[str] | None = None) -> DataFrame:
    """A/B classification (P6): ``items`` has ``all_ids_with_term`` (``A:..``,
    ``B:..``) and ``correct_ids``."""
    texts = {
        "zero_shot": C.prompt_a_b("all_ids_with_term", run.templates["a_b"]),
        "system": F.lit(run.system_texts["a_b"]),
    }
    results = _respond_and_persist(spark, items, run, make_responder, results_root, list(keep) + ["correct_ids"],
                                   texts=texts, few_shot=few_shot, few_shot_keys=few_shot_keys, typed=False, resume=resume, resume_keys=resume_keys)
    scored = results.select(*M.RUN_KEYS, "error", P.gold_first("correct_ids").alias("gold"), P.code_a_b("parsed", strict).alias("pred"))
    return _finish_scores(spark, M.accuracy(scored, by=list(M.RUN_KEYS), error="error"), scores_root)
