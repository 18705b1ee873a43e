"""Registered queries: streaming responder and incremental scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions import parsing as P
from evalframe.functions import prompts as C
from evalframe.operators.respond import ReplayResponder
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register
from evalframe.plans.q_scoring import _acc_sql
from evalframe.session import scratch_dir
from evalframe.sinks import writers as W
from evalframe.streaming import incremental as S

ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("object", T.StringType()),
    T.StructField("sub_subtask", T.StringType()), T.StructField("correct_ids", T.ArrayType(T.IntegerType())),
    T.StructField("all_ids_with_term", T.ArrayType(T.StringType())), T.StructField("recorded_response", T.StringType()),
])
RUN = {"task": "perception", "sub_task": "selection", "lang": "en", "model_type": "api", "model_name": "replay-model"}


@register("stream_respond", O.with_(O.CHOICE_ITEMS) + f"""
SELECT id, sub_subtask, recorded_response AS raw_response, {O.extract_sql('recorded_response')} AS parsed
FROM choice_responses""")
def stream_respond(spark: SparkSession, sf: str) -> DataFrame:
    d = scratch_dir(spark, "stream-respond")
    items = fx.choice_responses(spark, sf).select(*[f.name for f in ITEM_SCHEMA.fields])
    W.write_jsonl(items, d + "/items")

    def prompt(batch: DataFrame) -> DataFrame:
        return batch.withColumn("zero_shot", C.prompt_selection("object", "all_ids_with_term"))

    q = S.respond_stream(spark, d + "/items", ITEM_SCHEMA, prompt, ReplayResponder, RUN, d + "/results",
                         checkpoint=d + "/ckpt")
    q.awaitTermination()
    back = spark.read.json(d + "/results")
    return back.select(F.col("id").cast("long").alias("id"), F.col("sub_subtask").cast("string").alias("sub_subtask"),
                       "raw_response", "parsed")


RESULT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("correct_ids", T.ArrayType(T.IntegerType())),
    T.StructField("parsed", T.StringType()),
] + [T.StructField(c, T.StringType()) for c in ("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name")])


@register("stream_scores", O.with_(O.CHOICE_ITEMS) + f"""
SELECT 'perception' AS task, 'selection' AS sub_task, sub_subtask, 'en' AS lang, 'api' AS model_type,
       'replay-model' AS model_name, {_acc_sql('gold', 'pred')}
FROM (SELECT sub_subtask, coalesce(correct_ids[1], -1) AS gold,
             {O.code_int_sql(O.extract_sql('recorded_response'))} AS pred FROM choice_responses)
GROUP BY sub_subtask""")
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = scratch_dir(spark, "stream-scores")
    res = fx.choice_responses(spark, sf).select("id", "correct_ids", "sub_subtask",
                                               P.extract_choice("recorded_response").alias("parsed"))
    res = C.tag_run(res, **RUN).select(*[f.name for f in RESULT_SCHEMA.fields])
    res.write.mode("overwrite").parquet(d + "/results")
    q = S.score_stream(spark, d + "/results", RESULT_SCHEMA, lambda: P.gold_or_none("correct_ids"),
                       lambda: P.code_selection("parsed"), d + "/scores", checkpoint=d + "/ckpt")
    q.awaitTermination()
    back = spark.read.schema(T.StructType(
        [T.StructField(c, T.StringType()) for c in ("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name")]
        + [T.StructField("accuracy", T.DoubleType()), T.StructField("n_rows", T.LongType()),
           T.StructField("n_invalid", T.LongType())])).json(d + "/scores")
    return back.withColumn("accuracy", F.round("accuracy", 9))


_RESCORED = "id % 3 = 0 AND id % 2 = 1"


@register("stream_rescored", O.with_(O.A_B) + f"""
SELECT 'perception' AS task, 'selection' AS sub_task, 'part' || CAST(id % 5 AS VARCHAR) AS sub_subtask, 'en' AS lang, 'api' AS model_type, 'replay-model' AS model_name,
       round(avg(CASE WHEN NOT failed THEN CASE WHEN gold = pred THEN 1e0 ELSE 0e0 END END), 9) AS accuracy,
       count(CASE WHEN NOT failed THEN 1 END) AS n_rows,
       CAST(sum(CASE WHEN NOT failed AND pred = -100 THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid,
       count(CASE WHEN failed THEN 1 END) AS n_error
FROM (SELECT id, correct_ids[1] AS gold, ({_RESCORED} AND id % 7 <> 0) AS failed,
             CASE WHEN {_RESCORED} THEN 0 ELSE CASE {O.extract_sql('recorded_response')} WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE -100 END END AS pred
      FROM a_b_items)
GROUP BY id % 5""")
def stream_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """H1 and H2 of results that are put right later, one file a micro-batch.
    A third of the calls fail at first and half of these again; a fifth of the
    answers are no choice and asked again; last comes a late old answer of
    every seventh item, which only counts where nothing else was answered."""
    d = scratch_dir(spark, "stream-rescored")
    i, recorded, odd = F.col("id"), F.col("recorded_response"), F.expr(_RESCORED)
    failed = F.lit(None).cast("string")
    parts = [(F.lit(True), 1, F.when(i % 3 == 0, failed).when(i % 5 == 0, F.lit("no choice")).otherwise(recorded)),
             ((i % 3 == 0) | (i % 5 == 0), 2, F.when(odd, failed).otherwise(recorded)),
             (i % 7 == 0, 0, F.lit("A"))]
    for n, (rows, version, answer) in enumerate(parts):
        part = F.concat(F.lit("part"), (i % 5).cast("string"))
        res = fx.a_b_items(spark, sf).where(rows).select("id", "correct_ids", part.alias("sub_subtask"), answer.alias("answer"))
        res = res.withColumns({"parsed": P.extract_choice("answer"), "error": F.when(F.col("answer").isNull(), "failed"), "version": F.lit(version).cast("long")})
        res = C.tag_run(res, **RUN).select(*[f.name for f in RESULT_SCHEMA.fields], "error", "version")
        res.coalesce(1).write.mode("overwrite").parquet(f"{d}/results/part={n}")
    schema = T.StructType([*RESULT_SCHEMA.fields, T.StructField("error", T.StringType()), T.StructField("version", T.LongType())])
    q = S.score_stream(spark, d + "/results/*", schema, lambda: P.gold_first("correct_ids"), lambda: P.code_a_b("parsed"),
                       d + "/scores", checkpoint=d + "/ckpt", max_files_per_trigger=1, item_keys=["id"], version_col="version")
    q.awaitTermination()
    names = ("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name")
    back = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField("accuracy", T.DoubleType())]
                                          + [T.StructField(c, T.LongType()) for c in ("n_rows", "n_invalid", "n_error")])).json(d + "/scores")
    return back.withColumn("accuracy", F.round("accuracy", 9))
