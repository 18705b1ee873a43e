"""Registered queries: the responder (F1, F2) and end-to-end plans.

The scored plans use a replay responder that answers with each item's recorded
response: the ``mapInPandas`` call, persistence, read-back, parsing and scoring
run for real, and the scores are comparable with SQL over the same answers.  A
replay needs no messages, so Spark leaves their assembly out of these plans;
the ``request_*`` queries run the same plans with a responder that answers with
a digest of the messages it was sent, which SQL computes from the templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.constants import DEFAULT_GEN_PARAMS, MODEL_PROFILES, TASK_COMBINATIONS
from evalframe.functions import prompts as C
from evalframe.functions import requests as RQ
from evalframe.operators import fewshot as FS
from evalframe.operators import runs as R
from evalframe.operators.balance import request_cost
from evalframe.operators.respond import BusyResponder, DigestResponder, DownResponder, PromptDigest, ReplayResponder, respond
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans import task_plans as PL
from evalframe.plans.catalog import register
from evalframe.plans.q_runs import matrix
from evalframe.plans.q_scoring import _acc_sql
from evalframe.session import scratch_dir
from evalframe.sinks import writers as W
from evalframe.streaming import retries as RT

MODEL = "replay-model"


def _round(df: DataFrame) -> DataFrame:
    cols = {c: F.round(c, 9) for c in ("accuracy", "average_distance") if c in df.columns}
    return df.withColumns(cols)


def _fs_sets(spark: SparkSession, sf: str) -> DataFrame:
    return FS.few_shot_sets(fx.few_shot_pairs(spark, sf), ["fs_id"])


# ---------------------------------------------------------------------------
# F1 / F2
# ---------------------------------------------------------------------------

@register("respond", O.with_(O.CHOICE_ITEMS) + """
SELECT id, recorded_response AS raw_response, CAST(1 AS INTEGER) AS attempts, CAST(NULL AS VARCHAR) AS error
FROM choice_responses""")
def respond_query(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.choice_responses(spark, sf).select("id", "recorded_response", F.col("object").alias("prompt"))
    out = respond(items, ReplayResponder)
    return out.select("id", "raw_response", "attempts", "error")


@register("respond_by_cost", """
SELECT doc_id AS id, md5('Word ' || repeat(CAST(doc_id AS VARCHAR) || ' ', CASE WHEN doc_id % 10 = 0 THEN 100 ELSE 1 END)) AS raw_response,
       CAST(1 AS INTEGER) AS attempts, CAST(NULL AS VARCHAR) AS error
FROM labels""")
def respond_by_cost(spark: SparkSession, sf: str) -> DataFrame:
    """F1 where every tenth prompt is a hundred times as long: tasks of equal
    cost, calls of a bounded one, the same answers."""
    i = F.col("doc_id")
    prompt = F.concat(F.lit("Word "), F.repeat(F.concat(i.cast("string"), F.lit(" ")), F.when(i % 10 == 0, 100).otherwise(1)))
    items = fx.table(spark, sf, "labels").select(i.alias("id"), prompt.alias("prompt"))
    out = respond(items, PromptDigest, cost=request_cost("prompt"), batch_cost=20_000)
    return out.select("id", "raw_response", "attempts", "error")


@register("retry_schedule", O.with_(O.CHOICE_ITEMS) + """
SELECT id, attempts, array_to_string(list_transform(range(0, attempts - 1), lambda i: CAST(CAST(10 * pow(2, i) AS BIGINT) AS VARCHAR)), ',') AS waits,
       10e0 * (pow(2, attempts - 1) - 1) AS waited_s
FROM (SELECT id, CAST(k AS INTEGER) AS attempts FROM choice_items)""")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """the waits before each repeated attempt of a client that is down, for
    requests of up to as many attempts as their item has choices (2 to 5): read
    from the attempts that the retry stream made."""
    items = fx.choice_items(spark, sf).select(F.col("id").cast("string").alias("request"), F.lit(None).cast("string").alias("payload"),
                                              F.col("k").cast("int").alias("most"))
    tried = _retried(spark, items, DownResponder)[0].groupBy("request").agg(
        F.max("attempt").alias("attempts"), F.array_sort(F.collect_list(F.struct("attempt", "wait_s"))).alias("tries"))
    waits = F.transform(F.filter("tries", lambda t: t["attempt"] > 1), lambda t: t["wait_s"])
    return tried.select(F.col("request").cast("long").alias("id"), "attempts",
                        F.array_join(F.transform(waits, lambda w: w.cast("long").cast("string")), ",").alias("waits"),
                        F.aggregate(waits, F.lit(0.0), lambda a, w: a + w).alias("waited_s"))


# A second of the retry queries' waits: the schedule is 10, 20, 40, 80 of them.
SECOND = 0.002


def _retried(spark: SparkSession, items: DataFrame, make_responder) -> list[DataFrame]:
    """Attempts, answers and dead letters of the items' requests, from files
    through the retry stream."""
    d = scratch_dir(spark, "retries")
    items.write.mode("overwrite").parquet(d + "/requests")
    stream = spark.readStream.schema(items.schema).parquet(d + "/requests")
    n = spark.read.schema(items.schema).parquet(d + "/requests").count()
    RT.run_until_settled(lambda told: RT.retry_stream(stream, make_responder, d, d + "/checkpoint", most_col="most", second=SECOND,
                                                      on_batch=told), n)
    return [spark.read.schema(RT.table_schema(kind)).parquet(f"{d}/{RT.TABLES[kind][0]}") if RT.written(spark, d, kind)
            else spark.createDataFrame([], RT.table_schema(kind)) for kind in RT.TABLES]


@register("retry_stream", O.with_(O.A_B) + """
SELECT id, CASE WHEN id % 11 = 0 OR id % 7 >= 5 THEN NULL ELSE recorded_response END AS raw_response,
       CAST(CASE WHEN id % 11 = 0 THEN 1 ELSE least(id % 7 + 1, 5) END AS INTEGER) AS attempts,
       CASE WHEN id % 11 = 0 THEN 0e0 ELSE 10e0 * (pow(2, least(id % 7, 4)) - 1) END AS waited_s,
       CASE WHEN id % 11 = 0 THEN 'failed: ValueError: bad item' WHEN id % 7 >= 5 THEN 'exhausted: ConnectionError: busy' END AS error
FROM a_b_items""")
def retry_stream(spark: SparkSession, sf: str) -> DataFrame:
    """F2 over all items with a client that is busy for the first ``id % 7``
    attempts of an item and cannot take every eleventh."""
    items = fx.a_b_items(spark, sf).select(F.col("id").cast("string").alias("request"),
                                           F.to_json(F.struct("id", "recorded_response")).alias("payload"), F.lit(5).alias("most"))
    _, answered, dead = _retried(spark, items, BusyResponder)
    rows = answered.unionByName(dead, allowMissingColumns=True)
    return rows.select(F.col("request").cast("long").alias("id"), "raw_response", "attempts", "waited_s", "error")


# ---------------------------------------------------------------------------
# fixture items per task family
# ---------------------------------------------------------------------------

def selection_items(spark, sf):
    return fx.choice_responses(spark, sf).withColumn("fs_id", fx.few_shot_id(spark, sf, F.col("id")))


def generation_items(spark, sf, with_images: bool):
    it = fx.choice_items(spark, sf).withColumn(
        "recorded_response", F.concat(F.lower("object"), F.lit(" looks smooth and cool")))
    if with_images:
        it = it.withColumn("image", F.array(F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".jpg"))))
    return it.withColumn("fs_id", fx.few_shot_id(spark, sf, F.col("id")))


def pair_items(spark, sf):
    return fx.pair_rating_items(spark, sf).withColumn("fs_id", fx.few_shot_id(spark, sf, F.col("id"))).withColumn("naturalness", ((F.col("id") % 5) + 1).cast("int"))


def yes_no_items(spark, sf):
    return fx.yes_no_items(spark, sf).withColumn("fs_id", fx.few_shot_id(spark, sf, F.col("id"))).withColumn("term", F.concat(F.lit("word"), F.col("id").cast("string")))


def a_b_items(spark, sf):
    return fx.a_b_items(spark, sf).withColumn("fs_id", fx.few_shot_id(spark, sf, F.col("id"))).withColumn("all_ids_with_term", F.array(
        F.concat(F.lit("A:rough"), F.col("id").cast("string")), F.concat(F.lit("B:smooth"), F.col("id").cast("string"))))


_GEN_SQL = """
SELECT id, object, {task} AS task, 'generation' AS sub_task, 'ja' AS lang, 'api' AS model_type, 'replay-model' AS model_name,
       lower(object) || ' looks smooth and cool' AS original_response
FROM choice_items"""

_SEL_SCORES_SQL = f"""
SELECT 'perception' AS task, 'selection' AS sub_task, sub_subtask, '{{lang}}' AS lang, 'api' AS model_type,
       'replay-model' AS model_name, {_acc_sql('gold', 'pred')}
FROM (SELECT sub_subtask, coalesce(correct_ids[1], -1) AS gold,
             {O.code_int_sql(O.extract_sql('recorded_response'))} AS pred FROM choice_responses)
GROUP BY sub_subtask"""

_MC_SCORES_SQL = f"""
SELECT 'taxonomic' AS task, 'multiple_choice_classification' AS sub_task, sub_subtask, 'ja' AS lang, 'api' AS model_type,
       'replay-model' AS model_name, {_acc_sql('gold', 'pred')}
FROM (SELECT sub_subtask, coalesce(correct_ids[1], -1) AS gold,
             {O.code_int_sql(O.extract_sql('recorded_response'))} AS pred FROM choice_responses WHERE sub_subtask <> 'random')
GROUP BY sub_subtask"""

_PAIR_SQL = f"""
pair_scored AS (
  SELECT p.id, CAST(p.id % 5 + 1 AS INTEGER) AS gold, {O.code_int_sql(O.extract_sql('p.recorded_response'))} AS pred,
         v.vote_mean, v.vote_sd, v.unanimous
  FROM pair_items p LEFT JOIN vote_stats v ON p.id = v.item),
pair_d AS (
  SELECT *, {O.distance_sql('gold', 'pred', 'vote_mean', 'vote_sd', 'unanimous')} AS distribution_distance FROM pair_scored)"""

_P3_SQL = f"""
SELECT 'commonsense' AS task, 'classification' AS sub_task, CAST(NULL AS VARCHAR) AS sub_subtask, 'ja' AS lang,
       'api' AS model_type, 'replay-model' AS model_name, {_acc_sql('gold', 'pred')},
       round(avg(distribution_distance), 9) AS average_distance, count(distribution_distance) AS n_distance
FROM pair_d"""

_P4_SQL = f"""
SELECT 'commonsense' AS task, 'classification' AS sub_task, CAST(NULL AS VARCHAR) AS sub_subtask, 'en' AS lang,
       'api' AS model_type, 'replay-model' AS model_name, {_acc_sql('gold', 'pred')}
FROM pair_d"""

_P5_SQL = f"""
SELECT 'taxonomic' AS task, 'yes_no_classification' AS sub_task, CAST(NULL AS VARCHAR) AS sub_subtask, 'ja' AS lang,
       'api' AS model_type, 'replay-model' AS model_name, {_acc_sql('gold', 'pred')}
FROM (SELECT CAST(label AS INTEGER) AS gold,
             CASE {O.extract_sql('recorded_response')} WHEN 'no' THEN 0 WHEN 'yes' THEN 1 ELSE -100 END AS pred
      FROM yes_no_items)"""

_P6_SQL = f"""
SELECT 'taxonomic' AS task, 'a_b_classification' AS sub_task, CAST(NULL AS VARCHAR) AS sub_subtask, 'ja' AS lang,
       'api' AS model_type, 'replay-model' AS model_name, {_acc_sql('gold', 'pred')}
FROM (SELECT correct_ids[1] AS gold,
             CASE {O.extract_sql('recorded_response')} WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE -100 END AS pred
      FROM a_b_items)"""

SCORE_COLS = ("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name", "accuracy", "n_rows", "n_invalid")


def _run(task, sub_task, lang):
    return PL.Run(task=task, sub_task=sub_task, lang=lang, model_type="api", model_name=MODEL,
                  gen_params=dict(DEFAULT_GEN_PARAMS))


def _shots(spark, sf):
    return {"few_shot": _fs_sets(spark, sf), "few_shot_keys": ["fs_id"]}


def p1(spark, sf, lang="en"):
    return PL.eval_selection(spark, selection_items(spark, sf), _run("perception", "selection", lang), ReplayResponder,
                             few_shot=_fs_sets(spark, sf), few_shot_keys=["fs_id"])


def p2(spark, sf, task="perception"):
    res = PL.eval_generation(spark, generation_items(spark, sf, task == "perception"), _run(task, "generation", "ja"),
                             ReplayResponder, few_shot=_fs_sets(spark, sf), few_shot_keys=["fs_id"], with_images=task == "perception")
    return res.select("id", "object", "task", "sub_task", "lang", "model_type", "model_name", "original_response")


def p3(spark, sf):
    return PL.eval_pair_rating(spark, pair_items(spark, sf), _run("commonsense", "classification", "ja"), ReplayResponder,
                               votes=fx.votes_long(spark, sf), **_shots(spark, sf))


def p4(spark, sf):
    return PL.eval_pair_rating(spark, pair_items(spark, sf), _run("commonsense", "classification", "en"), ReplayResponder,
                               **_shots(spark, sf))


def p5(spark, sf):
    return PL.eval_yes_no(spark, yes_no_items(spark, sf), _run("taxonomic", "yes_no_classification", "ja"), ReplayResponder,
                          **_shots(spark, sf))


def p6(spark, sf):
    return PL.eval_a_b(spark, a_b_items(spark, sf), _run("taxonomic", "a_b_classification", "ja"), ReplayResponder,
                       **_shots(spark, sf))


def p7(spark, sf):
    items = selection_items(spark, sf).where(F.col("sub_subtask") != "random")
    return PL.eval_selection(spark, items, _run("taxonomic", "multiple_choice_classification", "ja"), ReplayResponder,
                             few_shot=_fs_sets(spark, sf), few_shot_keys=["fs_id"], multi_choice=True)


@register("eval_selection", O.with_(O.CHOICE_ITEMS) + _SEL_SCORES_SQL.replace('{lang}', 'en'))
def eval_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _round(p1(spark, sf)).select(*SCORE_COLS)


@register("eval_generation", O.with_(O.CHOICE_ITEMS) + _GEN_SQL.replace('{task}', "'perception'"))
def eval_generation(spark: SparkSession, sf: str) -> DataFrame:
    return p2(spark, sf, "perception")


@register("eval_generation_text", O.with_(O.CHOICE_ITEMS) + _GEN_SQL.replace('{task}', "'commonsense'"))
def eval_generation_text(spark: SparkSession, sf: str) -> DataFrame:
    return p2(spark, sf, "commonsense")


@register("eval_pair_rating_votes", O.with_(O.VOTES, O.PAIR_ITEMS, _PAIR_SQL) + _P3_SQL)
def eval_pair_rating_votes(spark: SparkSession, sf: str) -> DataFrame:
    return _round(p3(spark, sf)).select(*SCORE_COLS, "average_distance", "n_distance")


@register("eval_pair_rating", O.with_(O.VOTES, O.PAIR_ITEMS, _PAIR_SQL) + _P4_SQL)
def eval_pair_rating(spark: SparkSession, sf: str) -> DataFrame:
    return _round(p4(spark, sf)).select(*SCORE_COLS)


@register("eval_yes_no", O.with_(O.YES_NO) + _P5_SQL)
def eval_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    return _round(p5(spark, sf)).select(*SCORE_COLS)


@register("eval_a_b", O.with_(O.A_B) + _P6_SQL)
def eval_a_b(spark: SparkSession, sf: str) -> DataFrame:
    return _round(p6(spark, sf)).select(*SCORE_COLS)


@register("eval_multi_choice", O.with_(O.CHOICE_ITEMS) + _MC_SCORES_SQL)
def eval_multi_choice(spark: SparkSession, sf: str) -> DataFrame:
    return _round(p7(spark, sf)).select(*SCORE_COLS)


# ---------------------------------------------------------------------------
# what the model is sent
# ---------------------------------------------------------------------------

def _sent(spark: SparkSession, root: str) -> DataFrame:
    return W.read_results(spark, root, fmt="parquet").select("id", F.col("raw_response").alias("digest"))


def _digest_sql(items: str, where: str, system: str, user: str) -> str:
    return f"""
SELECT i.id, md5('system[text=' || {system} || ']|' || coalesce(s.shots || '|', '') || 'user[' || {user} || ']') AS digest
FROM {items} i LEFT JOIN (
  SELECT fs_id, string_agg('user[text=' || "user" || ']|assistant[text=' || assistant || ']', '|' ORDER BY ord) AS shots
  FROM few_shot_pairs GROUP BY fs_id) s ON s.fs_id = i.id % (SELECT max(conv_id) + 1 FROM conversations) {where}"""


_CHOICES = "array_to_string(i.all_ids_with_term, ', ')"


@register("request_selection", O.with_(O.CHOICE_ITEMS, O.FEW_SHOT_PAIRS) + _digest_sql(
    "choice_items", "", f"CASE WHEN i.sub_subtask = 'random' THEN {O.lit(C.SYSTEM_TEXTS['selection_random'])} "
    f"ELSE {O.lit(C.SYSTEM_TEXTS['selection'])} END",
    "'text=' || " + O.render_sql(C.TEMPLATES["selection"], object="i.object", choices=_CHOICES)))
def request_selection(spark: SparkSession, sf: str) -> DataFrame:
    """P1's requests: system text by sub_subtask, few-shot turns, the prompt."""
    root = scratch_dir(spark, "requests")
    PL.eval_selection(spark, selection_items(spark, sf), _run("perception", "selection", "en"), DigestResponder,
                      results_root=root, **_shots(spark, sf))
    return _sent(spark, root)


@register("request_generation", O.with_(O.CHOICE_ITEMS, O.FEW_SHOT_PAIRS) + _digest_sql(
    "choice_items", "", O.lit(C.SYSTEM_TEXTS["generation"]),
    "'image=s3://bucket/images/' || i.id || '.jpg,text=' || " + O.render_sql(C.TEMPLATES["generation"], object="i.object")))
def request_generation(spark: SparkSession, sf: str) -> DataFrame:
    """P2's requests: the image, resolved against the run's image directory,
    comes before the text."""
    root = scratch_dir(spark, "requests")
    run = _run("perception", "generation", "en")
    run.image_dir = "s3://bucket//"
    PL.eval_generation(spark, generation_items(spark, sf, True), run, DigestResponder, results_root=root,
                       with_images=True, **_shots(spark, sf))
    return _sent(spark, root)


@register("request_yes_no", O.with_(O.YES_NO, O.FEW_SHOT_PAIRS) + _digest_sql(
    "yes_no_items", "", O.lit(C.SYSTEM_TEXTS["yes_no"]),
    "'text=' || " + O.render_sql(C.TEMPLATES["yes_no"], term="'word' || i.id")))
def request_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    """P5's requests, in text form."""
    root = scratch_dir(spark, "requests")
    PL.eval_yes_no(spark, yes_no_items(spark, sf), _run("taxonomic", "yes_no_classification", "en"), DigestResponder,
                   results_root=root, **_shots(spark, sf))
    return _sent(spark, root)


def _request_pair_rating(spark: SparkSession, sf: str, lang: str, votes: DataFrame | None) -> DataFrame:
    root = scratch_dir(spark, "requests")
    run = _run("commonsense", "classification", lang)
    run.system_texts, run.templates = C.system_texts(lang), C.templates(lang)
    PL.eval_pair_rating(spark, pair_items(spark, sf), run, DigestResponder, votes=votes, results_root=root, **_shots(spark, sf))
    return _sent(spark, root)


def _pair_request_sql(lang: str) -> str:
    return O.with_(O.PAIR_ITEMS, O.FEW_SHOT_PAIRS) + _digest_sql(
        "pair_items", "", O.lit(C.system_texts(lang)["pair_rating"]),
        "'text=' || " + O.render_sql(C.templates(lang)[f"pair_rating_{lang}"], object="i.object", term="i.term"))


@register("request_pair_rating_votes", _pair_request_sql("ja"))
def request_pair_rating_votes(spark: SparkSession, sf: str) -> DataFrame:
    """P3's requests: the Japanese five-point question; votes are not sent."""
    return _request_pair_rating(spark, sf, "ja", fx.votes_long(spark, sf))


@register("request_pair_rating", _pair_request_sql("en"))
def request_pair_rating(spark: SparkSession, sf: str) -> DataFrame:
    """P4's requests: the English question."""
    return _request_pair_rating(spark, sf, "en", None)


@register("request_a_b", O.with_(O.A_B, O.FEW_SHOT_PAIRS) + _digest_sql(
    "a_b_items", "", O.lit(C.system_texts("ja")["a_b"]),
    "'text=' || " + O.render_sql(C.templates("ja")["a_b"], choices="'A:rough' || i.id || ', B:smooth' || i.id")))
def request_a_b(spark: SparkSession, sf: str) -> DataFrame:
    """P6's requests: two lettered options on a line of their own."""
    root = scratch_dir(spark, "requests")
    run = _run("taxonomic", "a_b_classification", "ja")
    run.system_texts, run.templates = C.system_texts("ja"), C.templates("ja")
    PL.eval_a_b(spark, a_b_items(spark, sf), run, DigestResponder, results_root=root, **_shots(spark, sf))
    return _sent(spark, root)


@register("request_multi_choice", O.with_(O.CHOICE_ITEMS, O.FEW_SHOT_PAIRS) + _digest_sql(
    "choice_items", "WHERE i.sub_subtask <> 'random'", O.lit(C.system_texts("ja")["multi_choice"]),
    "'text=' || " + O.render_sql(C.templates("ja")["multi_choice"], choices=_CHOICES)))
def request_multi_choice(spark: SparkSession, sf: str) -> DataFrame:
    """P7's requests: the options within the question, no object."""
    root = scratch_dir(spark, "requests")
    run = _run("taxonomic", "multiple_choice_classification", "ja")
    run.system_texts, run.templates = C.system_texts("ja"), C.templates("ja")
    items = selection_items(spark, sf).where(F.col("sub_subtask") != "random")
    PL.eval_selection(spark, items, run, DigestResponder, results_root=root, multi_choice=True, **_shots(spark, sf))
    return _sent(spark, root)


# ---------------------------------------------------------------------------
# A whole run over the resolved requests
# ---------------------------------------------------------------------------

def _with_distance_cols(df: DataFrame) -> DataFrame:
    if "average_distance" not in df.columns:
        df = df.withColumns({"average_distance": F.lit(None).cast("double"), "n_distance": F.lit(0).cast("long")})
    return _round(df).select(*SCORE_COLS, "average_distance", "n_distance")


PIPELINE_FOR = {
    ("ja", "perception", "generation"): lambda s, sf: p2(s, sf, "perception"),
    ("ja", "commonsense", "generation"): lambda s, sf: p2(s, sf, "commonsense"),
    ("ja", "perception", "selection"): lambda s, sf: p1(s, sf, "ja"),
    ("en", "perception", "selection"): lambda s, sf: p1(s, sf, "en"),
    ("ja", "commonsense", "classification"): p3,
    ("en", "commonsense", "classification"): p4,
    ("ja", "taxonomic", "yes_no_classification"): p5,
    ("ja", "taxonomic", "a_b_classification"): p6,
    ("ja", "taxonomic", "multiple_choice_classification"): p7,
}
assert set(PIPELINE_FOR) == set(TASK_COMBINATIONS)


def eval_run_scores(spark: SparkSession, sf: str, max_parallel: int = 4) -> DataFrame:
    """Resolve the requested combinations first (unknown ones are reported by
    ``missing_runs``), then run each distinct valid combination once.  The
    distinct combinations are configuration (at most the registry's nine
    rows), so they are read on the driver; the rows stay in Spark.  The runs
    are independent, so up to ``max_parallel`` of them submit their jobs
    concurrently from driver threads and share the cluster's task slots."""
    from concurrent.futures import ThreadPoolExecutor

    resolved, _missing = R.resolve_runs(matrix(spark, sf), R.registry(spark))
    combos = sorted(tuple(r) for r in resolved.select("lang", "task", "sub_task").distinct().collect())
    with ThreadPoolExecutor(max_workers=max(1, max_parallel)) as pool:
        outs = list(pool.map(lambda c: (c, PIPELINE_FOR[c](spark, sf)), combos))
    scores = None
    for combo, out in outs:
        if combo[2] == "generation":
            continue  # results only, no score rows
        out = _with_distance_cols(out)
        scores = out if scores is None else scores.unionByName(out)
    return scores


_P8_SQL = (O.with_(O.CHOICE_ITEMS, O.VOTES, O.PAIR_ITEMS, _PAIR_SQL, O.YES_NO, O.A_B)
           + "\n UNION ALL \n".join([
               f"SELECT *, CAST(NULL AS DOUBLE) AS average_distance, CAST(0 AS BIGINT) AS n_distance FROM ({_SEL_SCORES_SQL.replace('{lang}', 'ja')})",
               f"SELECT *, CAST(NULL AS DOUBLE) AS average_distance, CAST(0 AS BIGINT) AS n_distance FROM ({_SEL_SCORES_SQL.replace('{lang}', 'en')})",
               f"SELECT * FROM ({_P3_SQL})",
               f"SELECT *, CAST(NULL AS DOUBLE) AS average_distance, CAST(0 AS BIGINT) AS n_distance FROM ({_P4_SQL})",
               f"SELECT *, CAST(NULL AS DOUBLE) AS average_distance, CAST(0 AS BIGINT) AS n_distance FROM ({_P5_SQL})",
               f"SELECT *, CAST(NULL AS DOUBLE) AS average_distance, CAST(0 AS BIGINT) AS n_distance FROM ({_P6_SQL})",
               f"SELECT *, CAST(NULL AS DOUBLE) AS average_distance, CAST(0 AS BIGINT) AS n_distance FROM ({_MC_SCORES_SQL})",
           ]))


@register("eval_run", _P8_SQL)
def eval_run(spark: SparkSession, sf: str) -> DataFrame:
    return eval_run_scores(spark, sf)


# ---------------------------------------------------------------------------
# per-family request assembly
# ---------------------------------------------------------------------------

FAMILIES = tuple(MODEL_PROFILES)
_TEXT_FAMILIES = tuple(f for f, p in MODEL_PROFILES.items() if not p[0])
_VISION_FAMILIES = tuple(f for f, p in MODEL_PROFILES.items() if p[0])
_FILL_FAMILIES = tuple(f for f, p in MODEL_PROFILES.items() if p[2] == "fill")
_USER_FIRST = tuple(f for f, p in MODEL_PROFILES.items() if p[1] in ("user", "fold"))
_FOLD = tuple(f for f, p in MODEL_PROFILES.items() if p[1] == "fold")
_PROMPTED = tuple(f for f, p in MODEL_PROFILES.items() if p[3] is not None)
SYSTEM_TEXT = "Answer briefly."


def _in(values) -> str:
    return "(" + ", ".join(O.lit(v) for v in values) + ")"


@register("model_requests", O.with_(O.FEW_SHOT_PAIRS) + f"""
, ph AS (
  SELECT doc_id AS id, text || repeat('<image>', CAST(doc_id % 3 AS INTEGER)) AS text,
         CASE WHEN doc_id % 5 = 0 THEN CAST(NULL AS VARCHAR[])
              ELSE list_transform(range(1, CAST(doc_id % 4 AS INTEGER) + 1),
                                  lambda j: 'img/' || CAST(doc_id AS VARCHAR) || '_' || CAST(j AS VARCHAR)) END AS images
  FROM documents),
shots AS (SELECT fs_id, count(*) AS n FROM few_shot_pairs GROUP BY fs_id),
base AS (
  SELECT ph.id, ph.images, coalesce(s.n, 0) AS n_shots,
         CAST((length(ph.text) - length(replace(ph.text, '<image>', ''))) / 7 AS INTEGER) AS n_tok,
         [{', '.join(O.lit(f) for f in FAMILIES)}][ph.id % {len(FAMILIES)} + 1] AS family
  FROM ph LEFT JOIN shots s ON s.fs_id = ph.id % (SELECT max(conv_id) + 1 FROM conversations))
SELECT id, family,
       CAST(CASE WHEN family IN {_in(_FOLD)} THEN 2 * n_shots + 1 ELSE 2 * n_shots + 2 END AS INTEGER) AS n_msgs,
       CASE WHEN family IN {_in(_USER_FIRST)} THEN 'user' ELSE 'system' END AS first_role,
       CAST(CASE WHEN family IN {_in(_TEXT_FAMILIES)} THEN 0
                 WHEN family IN {_in(_FILL_FAMILIES)} THEN
                      CASE WHEN images IS NULL OR n_tok > len(images) THEN 0 ELSE len(images) - n_tok END
                 ELSE coalesce(len(images), 0) END AS INTEGER) AS n_images,
       CASE WHEN family IN {_in(_VISION_FAMILIES)} THEN coalesce(images IS NOT NULL AND n_tok > len(images), false)
            ELSE false END AS placeholder_error,
       family IN {_in(_PROMPTED)} AS has_prompt_text
FROM base""")
def model_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every family's request profile over the same items: documents with
    image placeholders and image lists, few-shot sets, one system text."""
    ph = fx.placeholder_text(spark, sf).withColumn("fs_id", fx.few_shot_id(spark, sf, F.col("id")))
    base = FS.attach_few_shot(ph, _fs_sets(spark, sf), ["fs_id"]).withColumns({
        "system": F.lit(SYSTEM_TEXT),
        "family": F.get(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("id") % len(FAMILIES)).cast("int")),
    })
    request = None
    for fam in FAMILIES:  # one pass: each row's family picks its profile
        c = RQ.prepare_request(fam, "system", "few_shot", "text", "images")
        s = F.struct(F.size(c["messages"]).alias("n_msgs"), c["messages"][0]["role"].alias("first_role"),
                     F.size(c["request_images"]).alias("n_images"), c["placeholder_error"].alias("placeholder_error"),
                     c["prompt_text"].isNotNull().alias("has_prompt_text"))
        request = F.when(F.col("family") == fam, s) if request is None else request.when(F.col("family") == fam, s)
    return base.select("id", "family", request.alias("r")).select("id", "family", "r.*")
