"""Registered queries: conversation assembly and chat formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.constants import CHATML, HEADER, INST, INSTRUCTION_RESPONSE, TURN
from evalframe.functions import chat as D
from evalframe.functions import prompts as C
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register
from evalframe.plans.q_prompts import items_with_few_shot

ST = C.SYSTEM_TEXTS
NL = "chr(10)"
WS = O.WS_CHARS_SQL
_SYS_SQL = f"CASE WHEN sub_subtask = 'random' THEN {O.lit(ST['selection_random'])} ELSE {O.lit(ST['selection'])} END"


def _system(sub: str = "sub_subtask"):
    return C.system_instruction(sub, ST["selection"], ST["selection_random"])


def _parts_str(msgs):
    """``role[type=value,...]|...`` summary of part-form messages."""
    return F.array_join(F.transform(msgs, lambda m: F.concat(
        m["role"], F.lit("["),
        F.array_join(F.transform(m["content"], lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], p["image"]))), ","),
        F.lit("]"))), "|")


@register("system_message", O.with_(O.CHOICE_ITEMS) + f"""
SELECT id, CAST(1 AS INTEGER) AS n_msgs, 'system' AS role, {_SYS_SQL} AS text FROM choice_items""")
def system_message(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.choice_items(spark, sf).select("id", D.system_message(_system()).alias("m"))
    return m.select("id", F.size("m").alias("n_msgs"), F.col("m")[0]["role"].alias("role"),
                    F.col("m")[0]["content"][0]["text"].alias("text"))


@register("system_as_user", O.with_(O.CHOICE_ITEMS) + f"""
SELECT id, CAST(1 AS INTEGER) AS n_msgs, 'user' AS role, {_SYS_SQL} AS text FROM choice_items""")
def system_as_user(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.choice_items(spark, sf).select("id", D.system_as_user(_system()).alias("m"))
    return m.select("id", F.size("m").alias("n_msgs"), F.col("m")[0]["role"].alias("role"),
                    F.col("m")[0]["content"][0]["text"].alias("text"))


_PH_SQL = """
ph AS (
  SELECT doc_id AS id, text || repeat('<image>', CAST(doc_id % 3 AS INTEGER)) AS text,
         CASE WHEN doc_id % 5 = 0 THEN CAST(NULL AS VARCHAR[])
              ELSE list_transform(range(1, CAST(doc_id % 4 AS INTEGER) + 1),
                                  lambda j: 'img/' || CAST(doc_id AS VARCHAR) || '_' || CAST(j AS VARCHAR)) END AS images
  FROM documents)"""


@register("user_message", O.with_(_PH_SQL) + f"""
SELECT id, CAST(coalesce(len(images), 0) + 1 AS INTEGER) AS n_parts,
       'user[' || coalesce(array_to_string(list_transform(images, lambda x: 'image=' || x), ','), '')
       || CASE WHEN coalesce(len(images), 0) > 0 THEN ',' ELSE '' END || 'text=' || text || ']' AS rendered
FROM ph""")
def user_message(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.placeholder_text(spark, sf).select("id", D.user_message("text", "images").alias("m"))
    return m.select("id", F.size(F.col("m")[0]["content"]).alias("n_parts"), _parts_str(F.col("m")).alias("rendered"))


@register("few_shot_messages", O.with_(O.FEW_SHOT_PAIRS) + f"""
SELECT fs_id, CAST(2 * count(*) AS INTEGER) AS n_msgs,
       string_agg('user[text=' || "user" || ']|assistant[text=' || assistant || ']', '|' ORDER BY ord) AS rendered
FROM few_shot_pairs GROUP BY fs_id""")
def few_shot_messages(spark: SparkSession, sf: str) -> DataFrame:
    from evalframe.operators import fewshot as FS
    sets = FS.few_shot_sets(fx.few_shot_pairs(spark, sf), ["fs_id"])
    m = sets.select("fs_id", D.few_shot_messages("few_shot").alias("m"))
    return m.select("fs_id", F.size("m").alias("n_msgs"), _parts_str(F.col("m")).alias("rendered"))


_CONV_SQL = f"""
conv_items AS (
  SELECT i.id, i.sub_subtask, {O.render_sql(C.TEMPLATES['selection'], object='i.object', choices="array_to_string(i.all_ids_with_term, ', ')")} AS prompt,
         count(f.ord) AS n_shots,
         coalesce(string_agg('user[text=' || f."user" || ']|assistant[text=' || f.assistant || ']', '|' ORDER BY f.ord), '') AS shots,
         coalesce(string_agg(f."user" || chr(10) || f.assistant || chr(10) || chr(10), '' ORDER BY f.ord), '') AS flat_shots
  FROM choice_items i LEFT JOIN few_shot_pairs f ON f.fs_id = i.id % (SELECT max(conv_id) + 1 FROM conversations)
  GROUP BY i.id, i.sub_subtask, i.object, i.all_ids_with_term)"""


@register("conversation", O.with_(O.CHOICE_ITEMS, O.FEW_SHOT_PAIRS, _CONV_SQL) + f"""
SELECT id, CAST(2 + 2 * n_shots AS INTEGER) AS n_msgs,
       'system[text=' || {_SYS_SQL} || ']|' || CASE WHEN n_shots > 0 THEN shots || '|' ELSE '' END
       || 'user[text=' || prompt || ']' AS rendered
FROM conv_items""")
def conversation(spark: SparkSession, sf: str) -> DataFrame:
    it = items_with_few_shot(spark, sf)
    m = it.select("id", D.conversation(_system(), "few_shot", C.prompt_selection("object", "all_ids_with_term")).alias("m"))
    return m.select("id", F.size("m").alias("n_msgs"), _parts_str(F.col("m")).alias("rendered"))


@register("flat_prompt", O.with_(O.CHOICE_ITEMS, O.FEW_SHOT_PAIRS, _CONV_SQL) + f"""
SELECT id, {_SYS_SQL} || {NL} || {NL} || flat_shots || prompt AS prompt FROM conv_items""")
def flat_prompt(spark: SparkSession, sf: str) -> DataFrame:
    it = items_with_few_shot(spark, sf)
    return it.select("id", D.flat_prompt(_system(), "few_shot", C.prompt_selection("object", "all_ids_with_term")).alias("prompt"))


# ---------------------------------------------------------------------------
# placeholders
# ---------------------------------------------------------------------------

_PH_COUNT = "CAST((length(text) - length(replace(text, '<image>', ''))) / 7 AS INTEGER)"


@register("placeholder_check", O.with_(_PH_SQL) + f"""
SELECT id, {_PH_COUNT} AS n_placeholders,
       coalesce(images IS NOT NULL AND {_PH_COUNT} > len(images), false) AS placeholder_error
FROM ph""")
def placeholder_check(spark: SparkSession, sf: str) -> DataFrame:
    ph = fx.placeholder_text(spark, sf)
    return ph.select("id", D.placeholder_count("text").alias("n_placeholders"),
                     D.placeholder_error("text", "images").alias("placeholder_error"))


@register("placeholder_strip", O.with_(_PH_SQL) + "SELECT id, replace(text, '<image>', '') AS text FROM ph")
def placeholder_strip(spark: SparkSession, sf: str) -> DataFrame:
    ph = fx.placeholder_text(spark, sf)
    return ph.select("id", D.placeholder_strip("text").alias("text"))


@register("placeholder_fill", O.with_(_PH_SQL) + f"""
SELECT id, CASE WHEN images IS NULL OR len(images) - {_PH_COUNT} < 0 THEN NULL
                ELSE array_to_string(images[1:len(images) - {_PH_COUNT}], ',') END AS fill
FROM ph""")
def placeholder_fill(spark: SparkSession, sf: str) -> DataFrame:
    ph = fx.placeholder_text(spark, sf)
    return ph.select("id", F.array_join(D.placeholder_fill("text", "images"), ",").alias("fill"))


# ---------------------------------------------------------------------------
# chat formats over conversations
# ---------------------------------------------------------------------------

def text_messages(spark: SparkSession, sf: str) -> DataFrame:
    return fx.messages(spark, sf).select("conv_id", D.to_text_messages("messages").alias("m"))


@register("role_alternation", O.with_(O.MSG_RANKED) + """
SELECT conv_id, coalesce(bool_and(CASE WHEN NOT is_sys_head THEN (role = 'user') = (idx % 2 = 0) END), true) AS alternates
FROM msg_rest GROUP BY conv_id""")
def role_alternation(spark: SparkSession, sf: str) -> DataFrame:
    return text_messages(spark, sf).select("conv_id", D.role_alternation("m").alias("alternates"))


@register("fold_system_into_first_user", O.with_(O.MSG_RANKED) + f"""
SELECT conv_id, coalesce(string_agg(CASE WHEN NOT is_sys_head THEN role || ':' || folded END,
                                    {NL} || '---' || {NL} ORDER BY turn), '') AS rendered
FROM msg_rest GROUP BY conv_id""")
def fold_system_into_first_user(spark: SparkSession, sf: str) -> DataFrame:
    f = text_messages(spark, sf).select("conv_id", D.fold_system_into_first_user("m").alias("f"))
    return f.select("conv_id", F.array_join(F.transform("f", lambda x: F.concat(x["role"], F.lit(":"), x["content"])),
                                            "\n---\n").alias("rendered"))


@register("chat_chatml", O.with_(O.MSG_RANKED) + f"""
SELECT conv_id,
       CASE WHEN min(first_role) <> 'system' THEN {O.lit(CHATML['start'] + 'system' + chr(10) + CHATML['default_system'] + CHATML['end'] + chr(10))} ELSE '' END
       || string_agg({O.lit(CHATML['start'])} || role || {NL} || text || {O.lit(CHATML['end'])} || {NL}, '' ORDER BY turn)
       || {O.lit(CHATML['start'] + 'assistant' + chr(10))} AS prompt
FROM msg_rest GROUP BY conv_id""")
def chat_chatml(spark: SparkSession, sf: str) -> DataFrame:
    return text_messages(spark, sf).select("conv_id", D.chat_chatml("m").alias("prompt"))


_INST_CONTENT = (f"CASE WHEN idx = 0 AND has_sys THEN {O.lit(INST['sys_open'])} || first_text || {O.lit(INST['sys_close'])} || text "
                 f"ELSE text END")


@register("chat_inst", O.with_(O.MSG_RANKED) + f"""
SELECT conv_id,
       CASE WHEN coalesce(bool_and(CASE WHEN NOT is_sys_head THEN (role = 'user') = (idx % 2 = 0) END), true) THEN
         coalesce(string_agg(CASE WHEN is_sys_head THEN NULL
                                  WHEN role = 'user' THEN {O.lit(INST['bos'] + INST['inst_open'])} || trim({_INST_CONTENT}, {WS}) || {O.lit(INST['inst_close'])}
                                  WHEN role = 'assistant' THEN ' ' || trim({_INST_CONTENT}, {WS}) || {O.lit(' ' + INST['eos'])}
                                  ELSE '' END, '' ORDER BY turn), '')
       END AS prompt
FROM msg_rest GROUP BY conv_id""")
def chat_inst(spark: SparkSession, sf: str) -> DataFrame:
    return text_messages(spark, sf).select("conv_id", D.chat_inst("m").alias("prompt"))


_H = HEADER


@register("chat_header", O.with_(O.MSG_RANKED) + f"""
SELECT conv_id,
       {O.lit(_H['bos'] + _H['header_open'] + 'system' + _H['header_close'] + _H['knowledge_line'] + _H['date_prefix'] + _H['default_date'] + chr(10) + chr(10))}
       || CASE WHEN min(first_role) = 'system' THEN trim(min(first_text), {WS}) ELSE '' END || {O.lit(_H['eot'])}
       || coalesce(string_agg(CASE WHEN NOT is_sys_head THEN {O.lit(_H['header_open'])} || role || {O.lit(_H['header_close'])}
                                   || trim(text, {WS}) || {O.lit(_H['eot'])} END, '' ORDER BY turn), '')
       || {O.lit(_H['header_open'] + 'assistant' + _H['header_close'])} AS prompt
FROM msg_rest GROUP BY conv_id""")
def chat_header(spark: SparkSession, sf: str) -> DataFrame:
    return text_messages(spark, sf).select("conv_id", D.chat_header("m").alias("prompt"))


@register("chat_turn", O.with_(O.MSG_RANKED) + f"""
SELECT conv_id,
       CASE WHEN coalesce(bool_and(CASE WHEN NOT is_sys_head THEN role <> 'system' AND (role = 'user') = (idx % 2 = 0) END), true) THEN
         {O.lit(TURN['bos'])}
         || coalesce(string_agg(CASE WHEN NOT is_sys_head THEN {O.lit(TURN['start'])}
                                     || CASE WHEN role = 'assistant' THEN {O.lit(TURN['assistant_role'])} ELSE role END
                                     || {NL} || trim(folded, {WS}) || {O.lit(TURN['end'])} END, '' ORDER BY turn), '')
         || {O.lit(TURN['start'] + TURN['assistant_role'] + chr(10))}
       END AS prompt
FROM msg_rest GROUP BY conv_id""")
def chat_turn(spark: SparkSession, sf: str) -> DataFrame:
    """System text folded into the first turn (D6), then the turn format."""
    f = text_messages(spark, sf).select("conv_id", D.fold_system_into_first_user("m").alias("f"))
    return f.select("conv_id", D.chat_turn("f").alias("prompt"))


_IR = INSTRUCTION_RESPONSE


@register("chat_instruction_response", O.with_(O.MSG_RANKED) + f"""
SELECT conv_id,
       {O.lit(_IR['bos'])} || string_agg(
         CASE role WHEN 'user' THEN {O.lit(_IR['user_header'])} || text
                   WHEN 'system' THEN text
                   WHEN 'assistant' THEN {O.lit(_IR['response_header'])} || text || {O.lit(_IR['eos'])}
                   ELSE '' END
         || CASE WHEN rn = n_msgs - 1 THEN {O.lit(_IR['response_header'])} ELSE '' END, '' ORDER BY turn) AS prompt
FROM msg_rest GROUP BY conv_id""")
def chat_instruction_response(spark: SparkSession, sf: str) -> DataFrame:
    return text_messages(spark, sf).select("conv_id", D.chat_instruction_response("m").alias("prompt"))
