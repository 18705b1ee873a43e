"""Vote statistics and the vote-distribution distance as native expressions.

Two equivalent forms:

* long form -- one row per vote; use the aggregate expressions in
  ``operators.metrics.vote_stats`` (partial aggregation, skew-safe);
* array form -- a per-item ``array<int>`` of votes (the item schema of the
  pair-rating task); use the higher-order functions below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.constants import RATING_MAX, RATING_MIN, SD_EPSILON

_SQRT_2PI = math.sqrt(2.0 * math.pi)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def vote_mean_array(votes: Column | str) -> Column:
    """Mean of the vote list (H3, array form); null for an empty list."""
    v = _col(votes)
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(v))


def vote_std_array(votes: Column | str) -> Column:
    """Sample standard deviation, ddof=1 (H4, array form); one vote -> null.

    Two passes like numpy: the mean is computed once and bound through a
    one-element array, then the squared deviations are summed.
    """
    v = _col(votes)
    ss = F.aggregate(
        F.array(vote_mean_array(v)), F.lit(0.0),
        lambda _acc, m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m)))
    return F.sqrt(F.try_divide(ss, (F.size(v) - 1).cast("double")))


def vote_unanimous_array(votes: Column | str) -> Column:
    """All votes equal (H5, array form)."""
    v = _col(votes)
    return F.array_min(v) == F.array_max(v)


def normal_pdf(x: Column, mu: Column, sd: Column) -> Column:
    """Normal density at ``x`` (H6)."""
    z = (x.cast("double") - mu) / sd
    return F.exp(F.lit(-0.5) * z * z) / (sd * F.lit(_SQRT_2PI))


def distribution_distance(gold: Column | str, pred: Column | str, mu: Column | str, sd: Column | str,
                          unanimous: Column | str) -> Column:
    """Distance between a predicted rating and the distribution of votes (H7).

    * null unless the prediction is a valid rating;
    * all votes equal and gold == pred -> 0;
    * all votes equal otherwise -> |1 - pdf(pred; mu, sd + eps)|;
    * else |pdf(gold; mu, sd) - pdf(pred; mu, sd)|.

    A single vote has a null sd, so its distance is null unless gold == pred.
    Densities above 1 are kept (the distance is not clipped).
    """
    gold, pred, mu, sd, unanimous = map(_col, (gold, pred, mu, sd, unanimous))
    valid = pred.between(RATING_MIN, RATING_MAX)
    return (
        F.when(~valid, F.lit(None).cast("double"))
        .when(unanimous & (gold == pred), F.lit(0.0))
        .when(unanimous, F.abs(F.lit(1.0) - normal_pdf(pred, mu, sd + F.lit(SD_EPSILON))))
        .otherwise(F.abs(normal_pdf(gold, mu, sd) - normal_pdf(pred, mu, sd)))
    )
