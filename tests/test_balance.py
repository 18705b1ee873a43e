"""Requests dealt to tasks of equal cost; calls of a bounded cost."""

from __future__ import annotations

import statistics
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalframe.operators import balance as B
from evalframe.operators.respond import PromptDigest, chunks, respond

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture()
def requests(spark):
    """A tenth of the prompts is 100 times as long, all of them at the end; a
    third of all rows are one row."""
    i = F.col("id")
    return spark.range(6_000, numPartitions=5).select(
        F.when(i % 3 == 1, F.lit(1)).otherwise(i).alias("id"), F.repeat(F.lit("x"), F.when(i >= 5_400, 2_000).otherwise(20)).alias("prompt"),
        F.when(i % 2 == 0, F.array(F.lit("a.jpg"))).alias("images")).withColumn("prompt", F.when(F.col("id") == 1, "same").otherwise(F.col("prompt")))


def loads(df, cost):
    return [r["c"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(cost).alias("c")).collect()]


@pytest.mark.parametrize("tasks", [8, 80])
def test_tasks_of_equal_cost(requests, tasks):
    cost = B.request_cost("prompt", "images", per_image=100)
    dealt = B.deal_by_cost(requests, cost, tasks)
    assert dealt.rdd.getNumPartitions() == tasks and dealt.columns == requests.columns
    got = loads(dealt, cost)
    assert len(got) == tasks and max(got) <= 1.25 * statistics.median(got)
    assert dealt.exceptAll(requests).count() == requests.exceptAll(dealt).count() == 0


def test_dealing_repeats(spark, requests):
    """Whatever the order in which a partition's rows come."""
    where = lambda df: sorted((r["p"], r["id"], r["prompt"]) for r in B.deal_by_cost(df, F.length("prompt"), 7).select(
        F.spark_partition_id().alias("p"), "id", "prompt").collect())
    assert where(requests) == where(requests.sortWithinPartitions(F.desc("prompt"), "id"))


def test_odd_costs(spark):
    empty = spark.createDataFrame([], "prompt string, images array<string>")
    assert B.deal_by_cost(empty, B.request_cost("prompt", "images"), 4).count() == 0
    rows = spark.createDataFrame([(None, None), ("", []), ("a", ["x", "y"])], "prompt string, images array<string>")
    assert [r[0] for r in rows.select(B.request_cost("prompt", "images", 10, 1)).collect()] == [1, 1, 22]
    assert B.deal_by_cost(rows, F.lit(None), 4).count() == 3
    assert B.tasks_of_bins({0: 5.0, 1: 3.0, 2: 3.0, 3: 1.0}, 2) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_calls_of_a_bounded_cost():
    costs = [5.0, 1.0, 1.0, 9.0, 30.0, 2.0, 2.0]
    assert list(chunks(list(range(7)), 10, costs, 10)) == [[0, 1, 2], [3], [4], [5, 6]]
    assert list(chunks([1, 2, 5], 2, None, None)) == [[1, 2], [5]] and list(chunks([], 3, costs, 10)) == []


class Sizes:
    """Answers with the cost of the call that a request was in."""

    def respond(self, requests):
        return [str(sum(len(r["prompt"]) for r in requests))] * len(requests)


def test_answers_are_those_of_a_plain_call(requests):
    plain = respond(requests, PromptDigest).select("id", "prompt", "raw_response", "error")
    dealt = respond(requests, PromptDigest, cost=B.request_cost("prompt"), batch_cost=10_000)
    assert dealt.columns == respond(requests, PromptDigest).columns
    assert dealt.select(*plain.columns).exceptAll(plain).count() == 0 == plain.exceptAll(dealt.select(*plain.columns)).count()
    calls = respond(requests, Sizes, cost=F.length("prompt"), batch_cost=5_000, pass_columns=["id"]).agg(F.max(F.col("raw_response").cast("int"))).first()[0]
    assert 4_000 <= calls <= 5_000
