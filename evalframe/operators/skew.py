"""Joins whose left side has heavy keys (A8 + E4: one image of many items).

AQE splits a skewed partition only above a byte threshold and only where the
plan lets it; references are narrow, so a key of a third of all rows stays one
task until its bytes are large, while the bytes joined to it are not.  Here the
heavy keys are found first, in one pass, by a mergeable frequent-items sketch
(Misra-Gries counters, Spark's ``approx_top_k``): every key of more than a
``share`` of the rows is among its at most ``2 / share`` candidates.  Only these
are salted; the right side is repeated once for each of their salts, every
other key is joined as it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.operators.joins import unused_name

# Salts of a heavy key are so many that one salt holds this part of a partition's mean.
CHUNK = 0.125
# Keys that hold less than this share are never heavy (bounds the sketch).
LEAST_SHARE = 1 / 20_000


def heavy_keys(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """``heavy_key`` and ``salts`` of the keys that hold more than ``CHUNK`` of
    a partition's mean: a bounded number of rows, whatever the input."""
    share = max(CHUNK / partitions, LEAST_SHARE)
    most = math.ceil(2 / share)
    # the sketch's error is at most 3.5 / tracked of the rows: a quarter of the share
    tracked = min(1_000_000, 2 ** math.ceil(math.log2(14 / share)))
    found = df.where(F.col(f"`{key}`").isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {min(most, tracked)}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n"))
    chunk = F.greatest(F.lit(1.0), F.col("n") * F.lit(share))
    return (found.select(F.explode("top").alias("t"), chunk.alias("chunk")).select(
        F.col("t.item").alias("heavy_key"), F.ceil(F.col("t.count") / F.col("chunk")).cast("int").alias("salts")).where("salts > 1"))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", by: Sequence[str] | None = None,
              partitions: int | None = None) -> DataFrame:
    """``left`` and ``right`` joined on ``key`` (inner, left, left_semi,
    left_anti), with the left rows of heavy keys dealt over salts by a hash of
    their columns ``by`` (default: all).  The salt of a row depends on the row
    alone, so a task that runs again deals it alike."""
    partitions = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(left, key, partitions))  # at most 2 / share rows
    salt, salts = unused_name("_salt", [*left.columns, *right.columns]), unused_name("_salts", [*left.columns, *right.columns])

    def with_salts(df: DataFrame) -> DataFrame:
        marked = df.join(heavy.select(F.col("heavy_key").alias(f"{salt}_key"), F.col("salts").alias(salts)), F.col(f"`{key}`") == F.col(f"{salt}_key"), "left")
        return marked.drop(f"{salt}_key").withColumn(salts, F.coalesce(salts, F.lit(1)))

    dealt = with_salts(left).withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (by or left.columns)]), F.col(salts)).cast("int")).drop(salts)
    repeated = with_salts(right).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).drop(salts)
    return dealt.join(repeated, [key, salt], how).drop(salt)
