"""Items are dealt to the responder's tasks before they get their examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalframe.operators import fewshot as FS
from evalframe.operators.respond import DigestResponder, ReplayResponder
from evalframe.plans import task_plans as PL
from evalframe.sinks import writers as W


def _sets(spark, keys):
    rows = [(k, i, f"u{k}-{i}", f"a{i} \u3042\"") for k in keys for i in range(3)]
    return FS.few_shot_sets(spark.createDataFrame(rows, "key long, ord long, user string, assistant string"), ["key"])


def _items(spark, n=4_000):
    """Half of the items share a key, some have none or one without a set."""
    i = F.col("id")
    key = F.when(i % 2 == 0, 0).when(i % 10 == 1, None).when(i % 10 == 3, 999).otherwise(i % 40)
    return spark.range(n).select("id", key.cast("long").alias("key"))


def _rows(df):
    return sorted((r["id"], -1 if r["key"] is None else r["key"], tuple(x["user"] for x in r["few_shot"])) for r in df.collect())


@pytest.mark.parametrize("most", [FS.BROADCAST_BYTES, 0])
def test_dealt_items_have_the_same_examples(spark, monkeypatch, most):
    """Whether the sets are broadcast or joined by key with heavy keys salted."""
    monkeypatch.setattr(FS, "BROADCAST_BYTES", most)
    items = _items(spark)
    twice = items.unionByName(items.where("id < 100"))
    sets = _sets(spark, range(40))
    dealt = FS.deal_with_few_shot(twice, sets, ["key"], 16)
    assert _rows(dealt) == _rows(FS.attach_few_shot(twice, sets, ["key"])) and dealt.columns == ["key", "id", "few_shot"]
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2.5 * 4_100 / 16


def test_keys_of_two_types(spark, monkeypatch):
    monkeypatch.setattr(FS, "BROADCAST_BYTES", 0)
    items = _items(spark, 200).withColumn("key", F.col("key").cast("int"))
    sets = _sets(spark, range(40))
    assert _rows(FS.deal_with_few_shot(items, sets, ["key"], 4)) == _rows(FS.attach_few_shot(items, sets, ["key"]))


def _written_plan(spark, monkeypatch, responder):
    plans = []
    real = W.write_results
    monkeypatch.setattr(W, "write_results", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a, **k))[1])
    items = _items(spark, 60).withColumns({"object": F.lit("cup"), "term": F.lit("smooth"), "naturalness": F.lit(1), "recorded_response": F.lit("1")})
    run = PL.Run("commonsense", "classification", "en", "api", "m")
    PL.eval_pair_rating(spark, items, run, responder, few_shot=_sets(spark, range(40)), few_shot_keys=["key"])
    return plans[0]


@pytest.mark.parametrize("responder", [DigestResponder, ReplayResponder])
def test_examples_are_not_shuffled_with_items(spark, monkeypatch, responder):
    """The one exchange of the items lies below the join that attaches their examples."""
    plan = _written_plan(spark, monkeypatch, responder)
    above, below = plan.split("MapInPandas", 1)[1].split("Join", 1)
    assert "Exchange" not in above and below.count("Exchange RoundRobin") == 1
