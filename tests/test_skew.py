"""Hot keys: one group holding most rows must give the same answer and keep
the partial-aggregation / skew-safe plan shapes."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from evalframe.operators import fewshot as FS
from evalframe.operators import metrics as M


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_run_group_accuracy(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.lit("cold")).alias("sub_subtask"),
        (F.col("id") % 3).cast("int").alias("gold"), (F.col("id") % 2).cast("int").alias("pred")).repartition(16)
    out = {r["sub_subtask"]: r for r in M.accuracy(df, by=["sub_subtask"]).collect()}
    hot = [i for i in range(n) if i % 10 < 9]
    assert out["hot"]["n_rows"] == len(hot)
    assert out["hot"]["accuracy"] == pytest.approx(sum((i % 3) == (i % 2) for i in hot) / len(hot))
    assert "partial_avg" in _plan(M.accuracy(df, by=["sub_subtask"]))


def test_hot_vote_item(spark):
    n = 20000
    votes = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("long").alias("item"),
                                  ((F.col("id") % 5) + 1).cast("int").alias("vote")).repartition(16)
    stats = M.vote_stats(votes)
    hot = stats.where("item = 0").collect()[0]
    vs = [(i % 5) + 1 for i in range(n) if i % 3 == 0]
    assert hot["n_votes"] == len(vs)
    assert hot["vote_mean"] == pytest.approx(statistics.fmean(vs))
    assert hot["vote_sd"] == pytest.approx(statistics.stdev(vs))
    plan = _plan(stats)
    assert "partial_stddev_samp" in plan and "collect_list" not in plan


def test_few_shot_join_hot_key(spark):
    """90% of items share one few-shot key.  The join is left to AQE whatever
    the sizes; salted, the items of a key are dealt over many partitions."""
    items = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.lit("cold")).alias("sub_subtask"))
    ex = spark.createDataFrame([("hot", i, f"u{i}", f"a{i}") for i in range(3)] + [("cold", 0, "u", "a")],
                               "sub_subtask string, ord long, user string, assistant string")
    sets = FS.few_shot_sets(ex, ["sub_subtask"])
    plain = FS.attach_few_shot(items, sets, ["sub_subtask"])
    salted = FS.attach_few_shot(items, sets, ["sub_subtask"], salts=16)
    assert "SortMergeJoin" in _plan(plain) and "_salt" in _plan(salted) and salted.columns == plain.columns
    for out in (plain, salted):
        got = {(r["sub_subtask"], r["k"]): r["n"] for r in out.groupBy("sub_subtask", F.size("few_shot").alias("k")).agg(
            F.count("*").alias("n")).collect()}
        assert got == {("hot", 3): 4500, ("cold", 1): 500}


def test_large_few_shot_set(spark):
    """A set of over 64 MiB is attached like any other."""
    examples = spark.range(70).select(F.lit("k").alias("key"), F.col("id").alias("ord"),
                                      F.rpad(F.col("id").cast("string"), 1 << 20, "x").alias("user"), F.lit("a").alias("assistant"))
    out = FS.attach_few_shot(spark.createDataFrame([(1, "k"), (2, "other")], "id long, key string"),
                             FS.few_shot_sets(examples, ["key"]), ["key"])
    size = F.aggregate("few_shot", F.lit(0), lambda n, x: n + F.length(x["user"]))
    assert {r["id"]: r["n"] for r in out.select("id", size.alias("n")).collect()} == {1: 70 << 20, 2: 0}
