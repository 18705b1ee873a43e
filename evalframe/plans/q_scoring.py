"""Registered queries: response parsing (G) and metrics (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions import parsing as P
from evalframe.functions import stats as S
from evalframe.operators import metrics as M
from evalframe.operators.vote_moments import VoteMoments
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register
from evalframe.session import scratch_dir

R9 = 9  # digits kept for doubles compared across engines


def r9(c):
    return F.round(c, R9)


# ---------------------------------------------------------------------------
# G: parsing
# ---------------------------------------------------------------------------

@register("strip_text", O.with_(O.RAW_TEXT) + f"SELECT src, k1, k2, trim(text, {O.WS_CHARS_SQL}) AS stripped FROM raw_text")
def strip_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.raw_text(spark, sf).select("src", "k1", "k2", P.strip_text("text").alias("stripped"))


@register("extract_choice", O.with_(O.RAW_TEXT) + f"SELECT src, k1, k2, {O.extract_sql('text')} AS parsed FROM raw_text")
def extract_choice(spark: SparkSession, sf: str) -> DataFrame:
    return fx.raw_text(spark, sf).select("src", "k1", "k2", P.extract_choice("text").alias("parsed"))


@register("code_selection", O.with_(O.RAW_TEXT) + f"""
SELECT src, k1, k2, parsed, {O.code_int_sql('parsed')} AS code
FROM (SELECT src, k1, k2, {O.extract_sql('text')} AS parsed FROM raw_text)""")
def code_selection(spark: SparkSession, sf: str) -> DataFrame:
    parsed = fx.raw_text(spark, sf).select("src", "k1", "k2", P.extract_choice("text").alias("parsed"))
    return parsed.withColumn("code", P.code_selection("parsed"))


@register("code_int", O.with_(O.PAIR_ITEMS) + f"""
SELECT id, parsed, {O.code_int_sql('parsed')} AS pred
FROM (SELECT id, {O.extract_sql('recorded_response')} AS parsed FROM pair_items)""")
def code_int(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.pair_rating_items(spark, sf).select("id", P.extract_choice("recorded_response").alias("parsed"))
    return items.withColumn("pred", P.code_int("parsed"))


@register("code_yes_no", O.with_(O.YES_NO) + f"""
SELECT id, parsed,
       CASE parsed WHEN 'no' THEN 0 WHEN 'yes' THEN 1 ELSE -100 END AS pred
FROM (SELECT id, {O.extract_sql('recorded_response')} AS parsed FROM yes_no_items)""")
def code_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.yes_no_items(spark, sf).select("id", P.extract_choice("recorded_response").alias("parsed"))
    return items.withColumn("pred", P.code_yes_no("parsed"))


@register("code_a_b", O.with_(O.A_B) + f"""
SELECT id, parsed,
       CASE parsed WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE -100 END AS pred
FROM (SELECT id, {O.extract_sql('recorded_response')} AS parsed FROM a_b_items)""")
def code_a_b(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.a_b_items(spark, sf).select("id", P.extract_choice("recorded_response").alias("parsed"))
    return items.withColumn("pred", P.code_a_b("parsed"))


@register("gold_or_none", O.with_(O.CHOICE_ITEMS) + "SELECT id, sub_subtask, coalesce(correct_ids[1], -1) AS gold FROM choice_items")
def gold_or_none(spark: SparkSession, sf: str) -> DataFrame:
    return fx.choice_items(spark, sf).select("id", "sub_subtask", P.gold_or_none("correct_ids").alias("gold"))


@register("gold_first", O.with_(O.A_B) + "SELECT id, correct_ids[1] AS gold FROM a_b_items")
def gold_first(spark: SparkSession, sf: str) -> DataFrame:
    return fx.a_b_items(spark, sf).select("id", P.gold_first("correct_ids").alias("gold"))


@register("gold_label", O.with_(O.YES_NO) + "SELECT id, CAST(label AS INTEGER) AS gold FROM yes_no_items")
def gold_label(spark: SparkSession, sf: str) -> DataFrame:
    return fx.yes_no_items(spark, sf).select("id", P.gold_label("label").alias("gold"))


# ---------------------------------------------------------------------------
# H: metrics
# ---------------------------------------------------------------------------

def _acc_sql(gold: str, pred: str) -> str:
    return (f"round(avg(CASE WHEN {gold} = {pred} THEN 1e0 ELSE 0e0 END), 9) AS accuracy, count(*) AS n_rows, "
            f"CAST(sum(CASE WHEN {pred} = -100 THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r9(F.col(c)) for c in cols})


@register("accuracy", O.with_(O.YES_NO) + f"""
SELECT {_acc_sql('gold', 'pred')}
FROM (SELECT CAST(label AS INTEGER) AS gold,
             CASE {O.extract_sql('recorded_response')} WHEN 'no' THEN 0 WHEN 'yes' THEN 1 ELSE -100 END AS pred
      FROM yes_no_items)""")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.yes_no_items(spark, sf)
    scored = it.select(P.gold_label("label").alias("gold"), P.code_yes_no(P.extract_choice("recorded_response")).alias("pred"))
    return _rounded(M.accuracy(scored), "accuracy")


def choice_scored(spark: SparkSession, sf: str) -> DataFrame:
    it = fx.choice_responses(spark, sf)
    return it.select(
        "id", "sub_subtask",
        P.gold_or_none("correct_ids").alias("gold"),
        P.code_selection(P.extract_choice("recorded_response")).alias("pred"),
    )


_CHOICE_SCORED_SQL = f"""
choice_scored AS (
  SELECT id, sub_subtask, coalesce(correct_ids[1], -1) AS gold,
         {O.code_int_sql(O.extract_sql('recorded_response'))} AS pred
  FROM choice_responses)"""


@register("accuracy_by_sub_subtask", O.with_(O.CHOICE_ITEMS, _CHOICE_SCORED_SQL) + f"""
SELECT sub_subtask, {_acc_sql('gold', 'pred')} FROM choice_scored GROUP BY sub_subtask""")
def accuracy_by_sub_subtask(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.accuracy(choice_scored(spark, sf), by=["sub_subtask"]), "accuracy")


@register("score_rows", O.with_(O.CHOICE_ITEMS, _CHOICE_SCORED_SQL) + f"""
SELECT 'perception' AS task, 'selection' AS sub_task, sub_subtask, 'en' AS lang, 'api' AS model_type,
       'replay' AS model_name, {_acc_sql('gold', 'pred')}
FROM choice_scored GROUP BY sub_subtask""")
def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    scores = M.accuracy(choice_scored(spark, sf), by=["sub_subtask"])
    scores = M.score_rows(scores, task="perception", sub_task="selection", lang="en", model_type="api", model_name="replay")
    return _rounded(scores, "accuracy").select("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name",
                                               "accuracy", "n_rows", "n_invalid")


def vote_stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.vote_stats(fx.votes_long(spark, sf))


@register("vote_mean", O.with_(O.VOTES) + "SELECT item, round(vote_mean, 9) AS vote_mean, n_votes FROM vote_stats")
def vote_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vote_stats(spark, sf).select("item", "vote_mean", "n_votes"), "vote_mean")


@register("vote_std", O.with_(O.VOTES) + "SELECT item, round(vote_sd, 9) AS vote_sd FROM vote_stats")
def vote_std(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vote_stats(spark, sf).select("item", "vote_sd"), "vote_sd")


@register("vote_unanimous", O.with_(O.VOTES) + "SELECT item, unanimous FROM vote_stats")
def vote_unanimous(spark: SparkSession, sf: str) -> DataFrame:
    return vote_stats(spark, sf).select("item", "unanimous")


@register("vote_stats_array", O.with_(O.VOTE_ARRAYS) + """
SELECT item, round(list_avg(votes), 9) AS vote_mean,
       round(sqrt(list_sum(list_transform(votes, lambda x: (x - list_avg(votes)) * (x - list_avg(votes)))) / (len(votes) - 1)), 9) AS vote_sd,
       list_min(votes) = list_max(votes) AS unanimous
FROM vote_arrays""")
def vote_stats_array(spark: SparkSession, sf: str) -> DataFrame:
    va = fx.vote_arrays(spark, sf)
    return va.select(
        "item",
        r9(S.vote_mean_array("votes")).alias("vote_mean"),
        r9(S.vote_std_array("votes")).alias("vote_sd"),
        S.vote_unanimous_array("votes").alias("unanimous"),
    )


@register("normal_pdf", O.with_(O.VOTES) + f"""
SELECT item, round(CASE WHEN vote_sd > 0 THEN {O.pdf_sql('vote_max', 'vote_mean', 'vote_sd')} END, 9) AS pdf
FROM vote_stats""")
def normal_pdf(spark: SparkSession, sf: str) -> DataFrame:
    vs = vote_stats(spark, sf)
    pdf = F.when(F.col("vote_sd") > 0, S.normal_pdf(F.col("vote_max"), F.col("vote_mean"), F.col("vote_sd")))
    return vs.select("item", r9(pdf).alias("pdf"))


def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Pair-rating items scored against their votes (gold = highest vote)."""
    items = fx.pair_rating_items(spark, sf).select(
        "id", P.code_int(P.extract_choice("recorded_response")).alias("pred"))
    vs = vote_stats(spark, sf).withColumnRenamed("item", "id")
    joined = items.join(vs, "id", "left").withColumn("gold", F.col("vote_max"))
    return M.with_distance(joined)


_PAIR_DISTANCE_SQL = f"""
pair_scored AS (
  SELECT p.id, {O.code_int_sql(O.extract_sql('p.recorded_response'))} AS pred, v.vote_max AS gold,
         v.vote_mean, v.vote_sd, v.unanimous
  FROM pair_items p LEFT JOIN vote_stats v ON p.id = v.item),
pair_distance AS (
  SELECT *, {O.distance_sql('gold', 'pred', 'vote_mean', 'vote_sd', 'unanimous')} AS distribution_distance
  FROM pair_scored)"""


@register("distribution_distance", O.with_(O.VOTES, O.PAIR_ITEMS, _PAIR_DISTANCE_SQL) + """
SELECT id, gold, pred, round(distribution_distance, 9) AS distribution_distance FROM pair_distance""")
def distribution_distance(spark: SparkSession, sf: str) -> DataFrame:
    d = pair_distance(spark, sf)
    return d.select("id", "gold", "pred", r9(F.col("distribution_distance")).alias("distribution_distance"))


@register("distribution_distance_array", O.with_(O.VOTE_ARRAYS) + f"""
SELECT item, round({O.distance_sql('gold', 'pred', 'mu', 'sd', 'unanimous')}, 9) AS distribution_distance
FROM (SELECT item, gold, pred, list_avg(votes) AS mu,
             sqrt(list_sum(list_transform(votes, lambda x: (x - list_avg(votes)) * (x - list_avg(votes)))) / (len(votes) - 1)) AS sd,
             list_min(votes) = list_max(votes) AS unanimous
      FROM vote_arrays)""")
def distribution_distance_array(spark: SparkSession, sf: str) -> DataFrame:
    va = fx.vote_arrays(spark, sf).select(
        "item", "gold", "pred", S.vote_mean_array("votes").alias("mu"), S.vote_std_array("votes").alias("sd"),
        S.vote_unanimous_array("votes").alias("unanimous"))
    d = S.distribution_distance("gold", "pred", "mu", "sd", "unanimous")
    return va.select("item", r9(d).alias("distribution_distance"))


@register("average_distance", O.with_(O.VOTES, O.PAIR_ITEMS, _PAIR_DISTANCE_SQL) + f"""
SELECT round(avg(distribution_distance), 9) AS average_distance, count(distribution_distance) AS n_distance,
       {_acc_sql('gold', 'pred')}
FROM pair_distance""")
def average_distance(spark: SparkSession, sf: str) -> DataFrame:
    s = M.distance_scores(pair_distance(spark, sf))
    return _rounded(s, "average_distance", "accuracy").select(
        "average_distance", "n_distance", "accuracy", "n_rows", "n_invalid")


@register("late_votes", O.with_(O.VOTES, O.PAIR_ITEMS, _PAIR_DISTANCE_SQL) + """
SELECT id, n_votes, round(d.vote_mean, 9) AS vote_mean, round(d.vote_sd, 9) AS vote_sd, d.unanimous, round(distribution_distance, 9) AS distribution_distance
FROM pair_distance d LEFT JOIN vote_stats v ON v.item = d.id""")
def late_votes(spark: SparkSession, sf: str) -> DataFrame:
    """H3 to H8 of votes that come in four batches, one of them committed
    twice, two folded before the others come: equal to all votes at once."""
    lines = fx.table(spark, sf, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("item"),
                                                   ((F.floor("l_quantity").cast("long") % 5) + 1).cast("int").alias("vote"))
    votes = VoteMoments(spark, scratch_dir(spark, "late-votes"))
    for batch in (0, 1, 1, 2, 3):
        votes.commit(f"b{batch}", lines.where(F.col("l_linenumber") % 4 == batch))
        if batch == 2:
            votes.compact()
    items = fx.pair_rating_items(spark, sf).select("id", P.code_int(P.extract_choice("recorded_response")).alias("pred"))
    joined = items.join(votes.stats().withColumnRenamed("item", "id"), "id", "left").withColumn("gold", F.col("vote_max"))
    return M.with_distance(joined).select("id", "n_votes", r9(F.col("vote_mean")).alias("vote_mean"), r9(F.col("vote_sd")).alias("vote_sd"),
                                          "unanimous", r9(F.col("distribution_distance")).alias("distribution_distance"))
