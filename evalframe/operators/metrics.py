"""Scoring aggregations (H1, H2, H8, H9) and long-form vote statistics.

Every metric is one ``groupBy(...).agg(...)``: Spark plans a partial hash
aggregate before the shuffle, so a group holding most of the rows still ships
one partial row per map task.  No row is ever collected into a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.constants import INVALID_CODE
from evalframe.functions import stats

RUN_KEYS = ("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name")


def accuracy_expr(gold: Column | str, pred: Column | str) -> Column:
    """Mean of gold == pred with double literals (H1)."""
    g = F.col(gold) if isinstance(gold, str) else gold
    p = F.col(pred) if isinstance(pred, str) else pred
    return F.avg(F.when(g == p, F.lit(1.0)).otherwise(F.lit(0.0)))


def _counted(df: DataFrame, error: str | None) -> tuple[Column, list[Column]]:
    """Which rows are scored, and the count of those that are not: a row whose
    call failed has no answer that could be wrong."""
    if error is None:
        return F.lit(True), []
    return F.col(error).isNull(), [F.count(error).alias("n_error")]


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = (),
             error: str | None = None) -> DataFrame:
    """Accuracy, row count and invalid-answer count per group (H1 / H2); with
    an ``error`` column, failed rows are counted apart as ``n_error``.

    ``by=()`` gives one row over the whole frame; ``by=RUN_KEYS`` gives the
    per-sub_subtask scores of one pass (the harness re-filtered all rows once
    per sub_subtask).
    """
    ok, failed = _counted(df, error)
    hit = F.when(ok, F.when(F.col(gold) == F.col(pred), 1.0).otherwise(0.0))
    aggs = [
        F.avg(hit).alias("accuracy"),
        F.count(F.when(ok, 1)).alias("n_rows"),
        F.sum(F.when(ok & (F.col(pred) == F.lit(INVALID_CODE)), F.lit(1)).otherwise(F.lit(0))).cast("long").alias("n_invalid"),
        *failed,
    ]
    return df.groupBy(*by).agg(*aggs)


def vote_stats(votes: DataFrame, item: str = "item", vote: str = "vote") -> DataFrame:
    """Long-form vote statistics per item (H3, H4, H5).

    ``unanimous`` is ``min == max`` rather than ``count(distinct) == 1``: the
    same answer without a distinct aggregate (no second shuffle).
    """
    v = F.col(vote).cast("double")
    return votes.groupBy(item).agg(
        F.avg(v).alias("vote_mean"),
        F.stddev_samp(v).alias("vote_sd"),
        (F.min(vote) == F.max(vote)).alias("unanimous"),
        F.count(F.lit(1)).alias("n_votes"),
        F.max(vote).cast("int").alias("vote_max"),
    )


def with_distance(df: DataFrame, gold: str = "gold", pred: str = "pred", out: str = "distribution_distance") -> DataFrame:
    """Attach the per-item distance (H7); needs ``vote_mean``, ``vote_sd``, ``unanimous``."""
    return df.withColumn(out, stats.distribution_distance(gold, pred, "vote_mean", "vote_sd", "unanimous"))


def distance_scores(df: DataFrame, gold: str = "gold", pred: str = "pred", distance: str = "distribution_distance",
                    by: Sequence[str] = (), error: str | None = None) -> DataFrame:
    """Accuracy and average distance in one aggregate (H1 + H8).

    ``avg`` skips null distances (invalid predictions); ``n_distance`` says how
    many rows the average covers.  The harness raised instead (defect R2).
    """
    ok, failed = _counted(df, error)
    kept = F.when(ok, F.col(distance))
    aggs = [F.avg(F.when(ok, F.when(F.col(gold) == F.col(pred), 1.0).otherwise(0.0))).alias("accuracy"),
            F.avg(kept).alias("average_distance"), F.count(kept).alias("n_distance"),
            F.count(F.when(ok, 1)).alias("n_rows"),
            F.sum(F.when(ok & (F.col(pred) == F.lit(INVALID_CODE)), F.lit(1)).otherwise(F.lit(0))).cast("long").alias("n_invalid")]
    return df.groupBy(*by).agg(*aggs, *failed)


def score_rows(scores: DataFrame, **tags: str | None) -> DataFrame:
    """Attach run metadata to aggregate rows (H9); existing key columns win."""
    cols = {k: F.lit(v).cast("string") for k, v in tags.items() if k not in scores.columns}
    return scores.withColumns(cols) if cols else scores
