"""Registered queries: whole runs through ``evaluate`` over item files.

The items of every combination are written as JSON Lines in the registry's
layout, with each item's recorded answer in a field that no plan reads, and
few-shot files of examples chosen from all conversations; ``evaluate`` reads
them back, routes the model, attaches the examples, asks the responder, saves
results and scores.  The responder reads the messages it is sent: its answer is
the item's recorded one and their digest, which SQL computes from the templates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.constants import MULTI_CHOICE_SUB_SUBTASKS, SELECTION_SUB_SUBTASKS
from evalframe.operators.respond import DigestResponder, ReplayResponder
from evalframe.functions import prompts as C
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans import q_task_plans as Q
from evalframe.plans import task_plans as PL
from evalframe.plans.catalog import register
from evalframe.plans.evaluate import evaluate
from evalframe.schemas import ITEM_SCHEMAS
from evalframe.session import scratch_dir
from evalframe.sinks import writers as W
from evalframe.sinks.run_table import RUN_COLUMNS, RunTable

MODEL = "org/gpt-4-replay"
# The field of an item that holds its recorded answer.
ANSWER_FIELDS = ("image_url", "naturalness_str", "label_str", "correct_terms")
# One call of ``evaluate`` each: language, task, sub_tasks.
SECTIONS = {"selection": SELECTION_SUB_SUBTASKS, "multiple_choice_classification": MULTI_CHOICE_SUB_SUBTASKS}
CALLS = (("ja", "perception", ("generation", "selection")), ("ja", "commonsense", ("generation", "classification")),
         ("ja", "taxonomic", ("a_b_classification", "yes_no_classification", "multiple_choice_classification")),
         ("en", "perception", ("selection",)), ("en", "commonsense", ("classification",)))


class FieldReplay(DigestResponder):
    """Answers with what the item's answer field holds, then the digest of what
    it was sent."""

    input_columns = None

    def respond(self, requests: list[dict]) -> list[str]:
        out = []
        for r, digest in zip(requests, super().respond(requests)):
            held = next(r["row"][f] for f in ANSWER_FIELDS if f in r["row"])
            out.append(f"{held if isinstance(held, str) else held[0]} #{digest}")
        return out


def _write_items(items: DataFrame, path: str, task: str, sub_task: str) -> None:
    """Items in their file schema; fields a fixture does not have are null."""
    schema = ITEM_SCHEMAS[task, sub_task]
    answer = next(f for f in ANSWER_FIELDS if f in schema.names)
    value = F.col("recorded_response")
    have = {**{c: F.col(c) for c in items.columns}, "image_id": F.col("id").cast("string"),
            answer: value if schema[answer].dataType.simpleString() == "string" else F.array(value)}
    W.write_jsonl(items.select(*[(have.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema]), path)


# A few-shot file holds as many examples.
N_SHOTS = 5
# Parts that the conversations are divided into: one for each section, or all in one.
PARTS = sorted({1, *map(len, SECTIONS.values())})


def _once(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as it is written to a scratch table: computed once, however often it is read."""
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_pairs(pairs: DataFrame) -> DataFrame:
    """All examples that a few-shot file may hold: the shortest of each class
    that lies whole in one part, whatever the parts."""
    size = F.length("user") + F.length("assistant")
    place = Window.partitionBy(F.col("fs_id") % math.lcm(*PARTS)).orderBy(size, "fs_id", "ord")
    return pairs.withColumn("place", F.row_number().over(place)).where(F.col("place") <= N_SHOTS).drop("place")


def few_shot_file(pairs: DataFrame, part: int, parts: int) -> DataFrame:
    """The shortest examples of the conversations of one part, shortest first."""
    pairs = pairs.where(F.col("fs_id") % parts == part)
    return pairs.orderBy(F.length("user") + F.length("assistant"), "fs_id", "ord").limit(N_SHOTS).select("user", "assistant", "images")


_SHOTS_SQL = f"""
shots AS (
  SELECT parts, part, string_agg('user[text=' || "user" || ']|assistant[text=' || assistant || ']', '|' ORDER BY r) AS shots
  FROM (SELECT *, row_number() OVER (PARTITION BY parts, part ORDER BY length("user") + length(assistant), fs_id, ord) AS r
        FROM (SELECT *, fs_id % parts AS part FROM few_shot_pairs, (SELECT unnest([1, 4, 5]) AS parts)))
  WHERE r <= {N_SHOTS} GROUP BY parts, part)"""


def _write_inputs(spark: SparkSession, sf: str, root: str) -> None:
    votes = fx.votes_long(spark, sf).groupBy("item").agg(F.collect_list("vote").alias("naturalness_by_worker"))   # an item's votes
    choices, pairs = fx.choice_responses(spark, sf), Q.pair_items(spark, sf)
    rated = _once(spark, pairs.join(votes, pairs["id"] == votes["item"], "left"), "rated-items")
    examples = _once(spark, short_pairs(fx.few_shot_pairs(spark, sf)), "short-pairs")
    for lang, task, sub_tasks in CALLS:
        for sub_task in sub_tasks:
            base = f"{root}/{task}/{sub_task}"
            sections = SECTIONS.get(sub_task)
            if sections:
                for i, section in enumerate(sections):
                    _write_items(choices.where(F.col("sub_subtask") == section), f"{base}/{section}/{lang}.jsonl", task, sub_task)
                    W.write_jsonl(few_shot_file(examples, i, len(sections)), f"{base}/{section}/few_shot_{lang}.jsonl")
                continue
            items = {"generation": lambda: Q.generation_items(spark, sf, task == "perception"), "classification": lambda: rated,
                     "yes_no_classification": lambda: Q.yes_no_items(spark, sf), "a_b_classification": lambda: Q.a_b_items(spark, sf)}[sub_task]()
            _write_items(items, f"{base}/{lang}.jsonl", task, sub_task)
            W.write_jsonl(few_shot_file(examples, 0, 1), f"{base}/few_shot_{lang}.jsonl")


def _whole_run(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Scores of all nine combinations, and the folder of their results."""
    data, out = scratch_dir(spark, "evaluate-data"), scratch_dir(spark, "evaluate-out")
    _write_inputs(spark, sf, data)
    scores = None
    for lang, task, sub_tasks in CALLS:
        got = evaluate(spark, [task], list(sub_tasks), lang, "api", MODEL, FieldReplay, out, data_root=data)
        scores = got if scores is None else scores.unionByName(got)
    return scores, f"{out}/results"


_GENERATED_SQL = " UNION ALL ".join(
    f"SELECT '{task}' AS task, 'generation' AS sub_task, CAST(NULL AS VARCHAR) AS sub_subtask, 'ja' AS lang, 'api' AS model_type, "
    f"'replay-model' AS model_name, CAST(NULL AS DOUBLE) AS accuracy, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_invalid, "
    f"CAST(NULL AS DOUBLE) AS average_distance, CAST(0 AS BIGINT) AS n_distance FROM choice_items"
    for task in ("perception", "commonsense"))


@register("evaluate_run", f"""
SELECT * REPLACE ('gpt-4-replay' AS model_name) FROM (
SELECT task, sub_task, sub_subtask, lang, model_type, model_name, accuracy, n_rows, n_invalid, average_distance, n_distance
FROM ({Q._P8_SQL}) UNION ALL ({O.with_(O.CHOICE_ITEMS)} {_GENERATED_SQL}))""")
def evaluate_run(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows of all nine combinations, and the answered rows of the
    generation runs, which have no score."""
    scores, results = _whole_run(spark, sf)
    scores = Q._round(scores).select(*Q.SCORE_COLS, "average_distance", "n_distance")
    generated = W.read_results(spark, results, fmt="parquet").where("sub_task = 'generation' and error is null")
    rows = generated.groupBy("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = rows.withColumns({"accuracy": F.lit(None).cast("double"), "n_invalid": F.lit(0).cast("long"),
                             "average_distance": F.lit(None).cast("double"), "n_distance": F.lit(0).cast("long")})
    return scores.unionByName(rows.select(*scores.columns))


_LIST = "array_to_string(i.all_ids_with_term, ', ')"


def _sent_sql(lang: str, task: str, sub_task: str) -> str:
    """What a combination's items are sent, and what is answered."""
    systems, templates = C.system_texts(lang), C.templates(lang)
    sections = SECTIONS.get(sub_task)
    items, key, slots = {
        "selection": ("choice_responses", "selection", {"object": "i.object", "choices": _LIST}),
        "multiple_choice_classification": ("choice_responses", "multi_choice", {"choices": _LIST}),
        "generation": ("(SELECT *, lower(object) || ' looks smooth and cool' AS recorded_response FROM choice_items)", "generation", {"object": "i.object"}),
        "classification": ("pair_items", f"pair_rating_{lang}", {"object": "i.object", "term": "i.term"}),
        "yes_no_classification": ("yes_no_items", "yes_no", {"term": "'word' || i.id"}),
        "a_b_classification": ("a_b_items", "a_b", {"choices": "'A:rough' || i.id || ', B:smooth' || i.id"}),
    }[sub_task]
    system = O.lit(systems["pair_rating" if sub_task == "classification" else key])
    section, part, where = "CAST(NULL AS VARCHAR)", "0", ""
    if sections:
        part = "CASE i.sub_subtask " + " ".join(f"WHEN '{x}' THEN {n}" for n, x in enumerate(sections)) + " END"
        section, where = "i.sub_subtask", "WHERE i.sub_subtask IN (" + ", ".join(f"'{x}'" for x in sections) + ")"
    if sub_task == "selection":
        system = f"CASE WHEN i.sub_subtask = 'random' THEN {O.lit(systems['selection_random'])} ELSE {system} END"
    image = "'image=images/' || i.id || '.jpg,' || " if (task, sub_task) == ("perception", "generation") else ""
    return f"""
SELECT '{task}' AS task, '{sub_task}' AS sub_task, {section} AS sub_subtask, '{lang}' AS lang, CAST(i.id AS BIGINT) AS id,
       i.recorded_response AS answer,
       md5('system[text=' || {system} || ']|' || coalesce(s.shots || '|', '') || 'user[' || {image}'text=' || {O.render_sql(templates[key], **slots)} || ']') AS digest
FROM {items} i LEFT JOIN shots s ON s.parts = {len(sections) if sections else 1} AND s.part = {part} {where}"""


@register("evaluate_requests", O.with_(O.CHOICE_ITEMS, O.PAIR_ITEMS, O.YES_NO, O.A_B, O.FEW_SHOT_PAIRS, _SHOTS_SQL) + " UNION ALL ".join(
    _sent_sql(lang, task, sub_task) for lang, task, sub_tasks in CALLS for sub_task in sub_tasks))
def evaluate_requests(spark: SparkSession, sf: str) -> DataFrame:
    """P3, P4, P6, P7 and the others as a whole run sends them: every item's
    request (system text, examples from its few-shot file, image, prompt) and
    its answer, from the saved results."""
    _, results = _whole_run(spark, sf)
    saved = W.read_results(spark, results, T.StructType.fromDDL(
        "id long, image_id string, raw_response string, task string, sub_task string, sub_subtask string, lang string"), fmt="parquet")
    return saved.select("task", "sub_task", "sub_subtask", "lang", F.coalesce("id", F.col("image_id").cast("long")).alias("id"),
                        F.expr("left(raw_response, length(raw_response) - 34)").alias("answer"), F.expr("right(raw_response, 32)").alias("digest"))


class FlakyReplay(ReplayResponder):
    """Fails for every fourth item."""

    input_columns = ("id", "recorded_response")

    def respond(self, requests: list[dict]) -> list:
        return [ValueError("flaky") if r["row"]["id"] % 4 == 0 else a for r, a in zip(requests, super().respond(requests))]


class SecondReplay(ReplayResponder):
    """Marks its answers."""

    def respond(self, requests: list[dict]) -> list[str]:
        return [a + " (second)" for a in super().respond(requests)]


@register("resume_run", O.with_(O.A_B) + """
SELECT id, copy, recorded_response || CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN ' (second)' ELSE '' END AS raw_response,
       CAST(NULL AS VARCHAR) AS error
FROM a_b_items, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR id % 5 = 0""")
def resume_run(spark: SparkSession, sf: str) -> DataFrame:
    """P8 resumed over all items, every fifth of them twice: a first run that
    saw two thirds and failed for some, a writer that was killed before it
    published, then the resumed run."""
    items = Q.a_b_items(spark, sf)
    items = items.unionByName(items.where(F.col("id") % 5 == 0))
    table = RunTable(spark, scratch_dir(spark, "resumed"))
    run = Q._run("taxonomic", "a_b_classification", "ja")
    answer = lambda df, responder, resume: PL.eval_a_b(
        spark, df, run, responder, results_root=table, keep=("id", "all_ids_with_term"), resume=resume)
    answer(items.where(F.col("id") % 3 != 0), FlakyReplay, False)
    table._stage(table.current({k: getattr(run, k) for k in RUN_COLUMNS}))
    answer(items, SecondReplay, True)
    rows = table.current({k: getattr(run, k) for k in RUN_COLUMNS})
    return rows.select("id", F.col("item_copy").cast("int").alias("copy"), "raw_response", "error")
