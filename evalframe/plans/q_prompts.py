"""Registered queries: prompts (C), few-shot (A6, J3) and sub_subtask union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.constants import SELECTION_SUB_SUBTASKS
from evalframe.functions import parsing as P
from evalframe.functions import prompts as C
from evalframe.operators import fewshot as FS
from evalframe.operators import runs as R
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register

T = C.TEMPLATES
ST = C.SYSTEM_TEXTS
_CHOICES = "array_to_string(all_ids_with_term, ', ')"


@register("choice_text", O.with_(O.CHOICE_ITEMS) + f"SELECT id, {_CHOICES} AS choices FROM choice_items")
def choice_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.choice_items(spark, sf).select("id", C.choice_text("all_ids_with_term").alias("choices"))


@register("prompt_generation", O.with_(O.CHOICE_ITEMS)
          + f"SELECT id, {O.render_sql(T['generation'], object='object')} AS prompt FROM choice_items")
def prompt_generation(spark: SparkSession, sf: str) -> DataFrame:
    return fx.choice_items(spark, sf).select("id", C.prompt_generation("object").alias("prompt"))


@register("prompt_selection", O.with_(O.CHOICE_ITEMS)
          + f"SELECT id, {O.render_sql(T['selection'], object='object', choices=_CHOICES)} AS prompt FROM choice_items")
def prompt_selection(spark: SparkSession, sf: str) -> DataFrame:
    return fx.choice_items(spark, sf).select("id", C.prompt_selection("object", "all_ids_with_term").alias("prompt"))


@register("prompt_pair_rating", O.with_(O.PAIR_ITEMS) + f"""
SELECT id, lang, CASE lang WHEN 'en' THEN {O.render_sql(T['pair_rating_en'], object='object', term='term')}
                           WHEN 'ja' THEN {O.render_sql(T['pair_rating_ja'], object='object', term='term')} END AS prompt
FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'ja' ELSE 'en' END AS lang FROM pair_items)""")
def prompt_pair_rating(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.pair_rating_items(spark, sf).withColumn("lang", F.when(F.col("id") % 2 == 0, "ja").otherwise("en"))
    return it.select("id", "lang", C.prompt_pair_rating("object", "term", "lang").alias("prompt"))


@register("prompt_yes_no", O.with_(O.CHOICE_ITEMS)
          + f"SELECT id, {O.render_sql(T['yes_no'], term='object')} AS prompt FROM choice_items")
def prompt_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    return fx.choice_items(spark, sf).select("id", C.prompt_yes_no("object").alias("prompt"))


_AB_SQL = """
ab_choices AS (
  SELECT p_partkey AS id, ['A:' || lower(p_type), 'B:' || coalesce(string_split(p_name, ' ')[1], '')] AS choices
  FROM part)"""


def a_b_choice_items(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array(
        F.concat(F.lit("A:"), F.lower("p_type")),
        F.concat(F.lit("B:"), F.coalesce(F.get(F.split("p_name", " "), 0), F.lit(""))),
    ).alias("choices"))


_AB_PROMPT_SQL = O.render_sql(T["a_b"], choices="array_to_string(choices, ', ')")


@register("prompt_a_b", O.with_(_AB_SQL) + f"SELECT id, {_AB_PROMPT_SQL} AS prompt FROM ab_choices")
def prompt_a_b(spark: SparkSession, sf: str) -> DataFrame:
    return a_b_choice_items(spark, sf).select("id", C.prompt_a_b("choices").alias("prompt"))


@register("prompt_multi_choice", O.with_(O.CHOICE_ITEMS)
          + f"SELECT id, {O.render_sql(T['multi_choice'], choices=_CHOICES)} AS prompt FROM choice_items WHERE sub_subtask <> 'random'")
def prompt_multi_choice(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.choice_items(spark, sf).where(F.col("sub_subtask") != "random")
    return it.select("id", C.prompt_multi_choice("all_ids_with_term").alias("prompt"))


@register("system_instruction", O.with_(O.CHOICE_ITEMS) + f"""
SELECT id, sub_subtask, CASE WHEN sub_subtask = 'random' THEN {O.lit(ST['selection_random'])}
                             ELSE {O.lit(ST['selection'])} END AS system
FROM choice_items""")
def system_instruction(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.choice_items(spark, sf)
    return it.select("id", "sub_subtask",
                     C.system_instruction("sub_subtask", ST["selection"], ST["selection_random"]).alias("system"))


@register("tag_run", O.with_(O.CHOICE_ITEMS) + """
SELECT id, 'perception' AS task, 'selection' AS sub_task, sub_subtask, 'ja' AS lang, 'hf' AS model_type,
       'Qwen2-VL-7B-Instruct' AS model_name FROM choice_items""")
def tag_run(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.choice_items(spark, sf).select("id", "sub_subtask")
    return C.tag_run(it, task="perception", sub_task="selection", lang="ja", model_type="hf",
                     model_name="Qwen2-VL-7B-Instruct").select(
        "id", "task", "sub_task", "sub_subtask", "lang", "model_type", "model_name")


@register("select_sub_subtasks", O.with_(O.CHOICE_ITEMS)
          + "SELECT id, sub_subtask FROM choice_items WHERE sub_subtask IN ('choice2_ans1', 'random')")
def select_sub_subtasks(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.choice_items(spark, sf).select("id", "sub_subtask")
    return C.select_sub_subtasks(it, ["choice2_ans1", "random"])


@register("answer_columns", O.with_(O.CHOICE_ITEMS) + f"""
SELECT id, recorded_response AS original_response, {O.extract_sql('recorded_response')} AS response
FROM choice_responses""")
def answer_columns(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.choice_responses(spark, sf).select(
        "id", F.col("recorded_response").alias("raw_response"), P.extract_choice("recorded_response").alias("parsed"))
    return C.answer_columns(it, "selection")


@register("union_sub_subtasks", O.with_(O.CHOICE_ITEMS) + "SELECT id, sub_subtask, k FROM choice_items")
def union_sub_subtasks(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset per sub_subtask, concatenated with bag semantics."""
    items = fx.choice_items(spark, sf).select("id", "sub_subtask", "k")
    per_sub = {s: items.where(F.col("sub_subtask") == s).drop("sub_subtask") for s in SELECTION_SUB_SUBTASKS}
    return R.union_sub_subtasks(per_sub).select("id", "sub_subtask", "k")


@register("few_shot_sets", O.with_(O.FEW_SHOT_PAIRS) + """
SELECT fs_id, count(*) AS n_examples, string_agg("user", chr(10) ORDER BY ord) AS users,
       string_agg(assistant, chr(10) ORDER BY ord) AS assistants
FROM few_shot_pairs GROUP BY fs_id""")
def few_shot_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = FS.few_shot_sets(fx.few_shot_pairs(spark, sf), ["fs_id"])
    return sets.select(
        "fs_id", F.size("few_shot").cast("long").alias("n_examples"),
        F.array_join(F.transform("few_shot", lambda x: x["user"]), "\n").alias("users"),
        F.array_join(F.transform("few_shot", lambda x: x["assistant"]), "\n").alias("assistants"),
    )


def items_with_few_shot(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.choice_responses(spark, sf).withColumn("fs_id", fx.few_shot_id(spark, sf, F.col("id")))
    sets = FS.few_shot_sets(fx.few_shot_pairs(spark, sf), ["fs_id"])
    return FS.attach_few_shot(items, sets, ["fs_id"])


@register("attach_few_shot", O.with_(O.CHOICE_ITEMS, O.FEW_SHOT_PAIRS) + """
SELECT i.id, CAST(count(f.ord) AS BIGINT) AS n_shots, coalesce(min(f.ord), -1) AS first_ord
FROM choice_items i LEFT JOIN few_shot_pairs f ON f.fs_id = i.id % (SELECT max(conv_id) + 1 FROM conversations)
GROUP BY i.id""")
def attach_few_shot(spark: SparkSession, sf: str) -> DataFrame:
    it = items_with_few_shot(spark, sf)
    return it.select("id", F.size("few_shot").cast("long").alias("n_shots"),
                     F.coalesce(F.get("few_shot", 0)["ord"], F.lit(-1).cast("long")).alias("first_ord"))
