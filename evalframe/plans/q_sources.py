"""Registered queries: file sources and sinks.

Each query derives a table from the driver data, writes it with a sink into a
fresh directory under the shared checkpoint root, reads it back with the
matching source and returns the result.  The oracle is the derivation itself:
a faithful round trip returns exactly what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions import parsing as P
from evalframe.functions import prompts as C
from evalframe.operators import fewshot as FS
from evalframe.operators import metrics as M
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register
from evalframe.session import scratch_dir
from evalframe.sinks import writers as W
from evalframe.sources import readers as R

CHOICE_FILE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("object", T.StringType()),
    T.StructField("sub_subtask", T.StringType()),
    T.StructField("correct_ids", T.ArrayType(T.IntegerType())),
    T.StructField("all_ids_with_term", T.ArrayType(T.StringType())),
])

DOC_FILE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
])

_NA_LIST = ", ".join(O.lit(v) for v in R.PANDAS_NA_VALUES)


def _choice_out(df: DataFrame) -> DataFrame:
    return df.select("id", "object", "sub_subtask",
                     F.array_join(F.transform("correct_ids", lambda x: x.cast("string")), ",").alias("correct_ids"),
                     F.array_join("all_ids_with_term", ", ").alias("choices"))


_CHOICE_OUT_SQL = O.with_(O.CHOICE_ITEMS) + """
SELECT id, object, sub_subtask, array_to_string(list_transform(correct_ids, lambda x: CAST(x AS VARCHAR)), ',') AS correct_ids,
       array_to_string(all_ids_with_term, ', ') AS choices FROM choice_items"""


@register("read_jsonl", _CHOICE_OUT_SQL)
def read_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """B1 write + A1 read of the choice items (arrays, non-ASCII, nulls)."""
    path = scratch_dir(spark, "items") + "/items.jsonl"
    items = fx.choice_items(spark, sf).select(*[f.name for f in CHOICE_FILE_SCHEMA.fields])
    W.write_jsonl(items, path)
    return _choice_out(R.read_jsonl(spark, path, CHOICE_FILE_SCHEMA))


@register("read_dataset", _CHOICE_OUT_SQL)
def read_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the suffix picks the reader."""
    path = scratch_dir(spark, "dataset") + "/choice_items.jsonl"
    items = fx.choice_items(spark, sf).select(*[f.name for f in CHOICE_FILE_SCHEMA.fields])
    W.write_jsonl(items, path)
    return _choice_out(R.read_dataset(spark, path, CHOICE_FILE_SCHEMA))


@register("read_json_array", _CHOICE_OUT_SQL)
def read_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """A2: JSON documents each holding an array of records.

    Every task writes its records as one document per file (records of about
    1000 ids each, one line a document, spread over the tasks), read back by
    the reader itself: a file of several documents is one task's input.
    """
    path = scratch_dir(spark, "json-array") + "/items.json"
    items = fx.choice_items(spark, sf).select(*[f.name for f in CHOICE_FILE_SCHEMA.fields])
    docs = items.groupBy(F.floor(F.col("id") / 1000).alias("chunk")).agg(
        F.to_json(F.collect_list(F.struct(*[f.name for f in CHOICE_FILE_SCHEMA.fields]))).alias("value"))
    docs.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return _choice_out(R.read_json_array(spark, path, CHOICE_FILE_SCHEMA))


@register("read_few_shot", O.with_(O.FEW_SHOT_PAIRS) + """
SELECT fs_id, count(*) AS n, md5(string_agg("user" || chr(10) || assistant, chr(9) ORDER BY ord)) AS digest
FROM few_shot_pairs GROUP BY fs_id""")
def read_few_shot(spark: SparkSession, sf: str) -> DataFrame:
    """A6 on files: examples written as JSON Lines, a conversation's lines
    together and in order, come back as one list a conversation."""
    path = scratch_dir(spark, "few-shot") + "/few_shot.jsonl"
    pairs = fx.few_shot_pairs(spark, sf).repartition("fs_id").sortWithinPartitions("fs_id", "ord")
    W.write_jsonl(pairs.select(F.concat_ws("\n", F.col("fs_id").cast("string"), "user").alias("user"), "assistant", "images"), path)
    back = R.read_few_shot(spark, path)
    sets = FS.few_shot_sets(back.withColumn("fs_id", F.substring_index("user", "\n", 1).cast("long")), ["fs_id"])
    text = F.transform("few_shot", lambda x: F.concat(
        F.substring(x["user"], F.length(F.col("fs_id").cast("string")) + 2, F.length(x["user"])), F.lit("\n"), x["assistant"]))
    return sets.select("fs_id", F.size("few_shot").cast("long").alias("n"), F.md5(F.array_join(text, "\t")).alias("digest"))


_DOC_SQL = f"""
SELECT doc_id,
       CASE WHEN lang IN ({_NA_LIST}) THEN NULL ELSE lang END AS lang,
       CASE WHEN source IN ({_NA_LIST}) THEN NULL ELSE source END AS source,
       CASE WHEN text IN ({_NA_LIST}) THEN NULL ELSE text END AS text
FROM documents"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")


@register("read_csv", _DOC_SQL)
def read_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A3: multi-line quoted text, pandas missing-value spellings -> null."""
    path = scratch_dir(spark, "csv") + "/docs.csv"
    W.write_delimited(_docs(spark, sf), path, ",")
    return R.read_dataset(spark, path, DOC_FILE_SCHEMA, multi_line=True)


@register("read_tsv", _DOC_SQL)
def read_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """A4: tab-separated."""
    path = scratch_dir(spark, "tsv") + "/docs.tsv"
    W.write_delimited(_docs(spark, sf), path, "\t")
    return R.read_dataset(spark, path, DOC_FILE_SCHEMA, multi_line=True)


@register("convert_to_jsonl", _DOC_SQL)
def convert_to_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """CSV -> JSON Lines, read back."""
    d = scratch_dir(spark, "convert")
    W.write_delimited(_docs(spark, sf), d + "/docs.csv", ",")
    W.convert_to_jsonl(spark, d + "/docs.csv", DOC_FILE_SCHEMA, d + "/docs.jsonl", multi_line=True)
    return R.read_jsonl(spark, d + "/docs.jsonl", DOC_FILE_SCHEMA)


_RESULT_SQL = O.with_(O.CHOICE_ITEMS, O.YES_NO) + f"""
SELECT id, 'perception' AS task, 'selection' AS sub_task, sub_subtask, 'en' AS lang, 'api' AS model_type, '4' AS model_name,
       recorded_response AS raw_response, {O.extract_sql('recorded_response')} AS parsed
FROM choice_responses
UNION ALL
SELECT id, 'taxonomic', 'yes_no_classification', NULL, 'ja', 'hf', 'Qwen2-7B-Instruct',
       recorded_response, {O.extract_sql('recorded_response')}
FROM yes_no_items"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    sel = fx.choice_responses(spark, sf).select("id", "sub_subtask", F.col("recorded_response").alias("raw_response"))
    sel = C.tag_run(sel, task="perception", sub_task="selection", lang="en", model_type="api", model_name="4")
    yn = fx.yes_no_items(spark, sf).select("id", F.col("recorded_response").alias("raw_response"))
    yn = C.tag_run(yn, task="taxonomic", sub_task="yes_no_classification", lang="ja", model_type="hf",
                   model_name="Qwen2-7B-Instruct")
    both = sel.unionByName(yn)
    return both.withColumn("parsed", P.extract_choice("raw_response"))


RESULT_FILE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("raw_response", T.StringType()), T.StructField("parsed", T.StringType()),
    T.StructField("task", T.StringType()), T.StructField("sub_task", T.StringType()), T.StructField("sub_subtask", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("model_type", T.StringType()), T.StructField("model_name", T.StringType()),
])


@register("write_results", _RESULT_SQL)
def write_results(spark: SparkSession, sf: str) -> DataFrame:
    """B2: partitioned by run; a null sub_subtask and a numeric model name
    read back unchanged."""
    root = scratch_dir(spark, "results")
    W.write_results(_results(spark, sf), root)
    back = W.read_results(spark, root, RESULT_FILE_SCHEMA)
    return back.select("id", "task", "sub_task", "sub_subtask", "lang", "model_type", "model_name", "raw_response", "parsed")


SCORE_FILE_SCHEMA = T.StructType([
    T.StructField("sub_subtask", T.StringType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("n_rows", T.LongType()), T.StructField("n_invalid", T.LongType()),
    T.StructField("task", T.StringType()), T.StructField("sub_task", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("model_type", T.StringType()), T.StructField("model_name", T.StringType()),
])


@register("write_scores", O.with_(O.CHOICE_ITEMS, O.YES_NO) + f"""
SELECT task, sub_task, sub_subtask, lang, model_type, model_name,
       round(avg(CASE WHEN gold = pred THEN 1e0 ELSE 0e0 END), 9) AS accuracy, count(*) AS n_rows,
       CAST(sum(CASE WHEN pred = -100 THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid
FROM (
  SELECT 'perception' AS task, 'selection' AS sub_task, sub_subtask, 'en' AS lang, 'api' AS model_type, '4' AS model_name,
         coalesce(correct_ids[1], -1) AS gold, {O.code_int_sql(O.extract_sql('recorded_response'))} AS pred
  FROM choice_responses
  UNION ALL
  SELECT 'taxonomic', 'yes_no_classification', NULL, 'ja', 'hf', 'Qwen2-7B-Instruct', CAST(label AS INTEGER),
         CASE {O.extract_sql('recorded_response')} WHEN 'no' THEN 0 WHEN 'yes' THEN 1 ELSE -100 END
  FROM yes_no_items)
GROUP BY task, sub_task, sub_subtask, lang, model_type, model_name""")
def write_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows partitioned without sub_subtask (kept as a column)."""
    sel = fx.choice_responses(spark, sf).select(
        "sub_subtask", P.gold_or_none("correct_ids").alias("gold"),
        P.code_selection(P.extract_choice("recorded_response")).alias("pred"))
    sel = C.tag_run(sel, task="perception", sub_task="selection", lang="en", model_type="api", model_name="4")
    yn = fx.yes_no_items(spark, sf).select(P.gold_label("label").alias("gold"),
                                           P.code_yes_no(P.extract_choice("recorded_response")).alias("pred"))
    yn = C.tag_run(yn, task="taxonomic", sub_task="yes_no_classification", lang="ja", model_type="hf",
                   model_name="Qwen2-7B-Instruct")
    scored = sel.unionByName(yn)
    scores = M.accuracy(scored, by=list(M.RUN_KEYS)).withColumn("accuracy", F.round("accuracy", 9))
    root = scratch_dir(spark, "scores")
    W.write_scores(scores, root)
    back = W.read_results(spark, root, SCORE_FILE_SCHEMA)
    return back.select("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name", "accuracy", "n_rows", "n_invalid")
