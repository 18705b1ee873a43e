"""Heavy keys of joins; votes that come late."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalframe.operators import metrics as M
from evalframe.operators import skew as K
from evalframe.operators import vote_moments as V


@pytest.fixture()
def hot(spark):
    """A third of 30,000 rows on one key, a tenth on another, some null."""
    i = F.col("id")
    return spark.range(30_000).select("id", F.when(i % 3 == 0, "hot").when(i % 10 == 1, "warm").when(i % 100 == 2, F.lit(None).cast("string"))
                                      .otherwise(F.concat(F.lit("k"), (i % 5_000).cast("string"))).alias("key"))


def test_heavy_keys_are_found_and_bounded(hot):
    found = {r["heavy_key"]: r["salts"] for r in K.heavy_keys(hot, "key", 8).collect()}
    assert {"hot", "warm"} <= set(found) and len(found) <= 2 / (K.CHUNK / 8)
    assert found["hot"] == pytest.approx(8 / 3 / K.CHUNK, abs=1.1)
    assert K.heavy_keys(hot.limit(0), "key", 8).count() == 0
    assert K.heavy_keys(hot.where("key <> 'hot' AND key <> 'warm'"), "key", 8).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join_equals_the_plain_join(spark, hot, how):
    right = spark.createDataFrame([("hot", 1), ("warm", 2), ("k7", 3), ("k7", 4), (None, 5), ("none", 6)], "key string, v int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(K.skew_join(hot, right, "key", how).select(*hot.columns, *(["v"] if how in ("left", "inner") else []))) == rows(
        hot.join(right, "key", how).select(*hot.columns, *(["v"] if how in ("left", "inner") else [])))


def test_the_largest_task_is_near_the_median(spark, hot):
    """Rows by partition of the join, as dealt: AQE would coalesce and split."""
    keys = hot.select("key").distinct().withColumn("v", F.lit(1))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("count"), F.sum("v")).collect()]
        dealt = sizes(K.skew_join(hot, keys, "key"))
        plain = sizes(hot.join(keys, "key", "left"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(dealt) <= 2 * statistics.median(dealt) < max(plain)


def rounded(rows):
    return sorted(((r["item"], r["n_votes"], round(r["vote_mean"], 9), None if r["vote_sd"] is None else round(r["vote_sd"], 9), r["unanimous"],
                    r["vote_max"]) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_moments_equal_all_votes_at_once(spark, tmp_dir, seed):
    """Any split into batches, any folds between them, batches again."""
    rng = random.Random(seed)
    votes = [(rng.randint(0, 12), rng.choice([1, 2, 3, 4, 5, 5, 5, None])) for _ in range(300)] + [(50, 3), (51, 2), (51, 2), (52, None)]
    rng.shuffle(votes)
    table = V.VoteMoments(spark, tmp_dir)
    at, n = 0, 0
    while at < len(votes):
        part = votes[at:at + rng.randint(1, 120)]
        for _ in range(rng.randint(1, 2)):
            table.commit(f"b{n}", spark.createDataFrame(part, "item long, vote int"))
        at, n = at + len(part), n + 1
        if rng.random() < 0.4:
            table.compact()
    whole = spark.createDataFrame([v for v in votes if v[1] is not None], "item long, vote int")
    assert rounded(table.stats().collect()) == rounded(M.vote_stats(whole).collect())
    table.compact()
    table.compact()
    assert rounded(table.stats().collect()) == rounded(M.vote_stats(whole).collect())
    with pytest.raises(ValueError, match="folded"):
        table.commit("b0", whole)


def test_a_fold_that_was_cut_off_counts_nothing(spark, tmp_dir, monkeypatch):
    table, votes = V.VoteMoments(spark, tmp_dir), spark.createDataFrame([(1, 2), (1, 4)], "item long, vote int")
    table.commit("a", votes)
    with monkeypatch.context() as m:
        m.setattr(table.files, "create", lambda path, text: False)
        with pytest.raises(RuntimeError):
            table.compact()
    table.commit("b", votes)
    assert rounded(table.stats().collect()) == [(1, 4, 3.0, round((4 / 3) ** 0.5, 9), False, 4)]
    assert V.VoteMoments(spark, tmp_dir + "/none").stats().count() == 0


def test_far_means_do_not_cancel(spark, tmp_dir):
    """Large votes with a small spread, in single-vote batches."""
    table = V.VoteMoments(spark, tmp_dir)
    for n, vote in enumerate([2_000_000_001, 2_000_000_002, 2_000_000_003]):
        table.commit(str(n), spark.createDataFrame([(1, vote)], "item long, vote int"))
    assert table.stats().collect()[0]["vote_sd"] == pytest.approx(1.0, abs=1e-9)
