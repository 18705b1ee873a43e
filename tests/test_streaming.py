"""Streaming: incremental scoring resumes from its checkpoint; the streaming
responder writes each micro-batch idempotently."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions import parsing as P
from evalframe.operators.respond import ReplayResponder
from evalframe.plans.q_streaming import ITEM_SCHEMA, RESULT_SCHEMA, RUN
from evalframe.sinks import writers as W
from evalframe.streaming import incremental as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _results(spark, ids, parsed):
    rows = [(i, [i % 3], parsed(i), "perception", "selection", "choice3_ans1", "en", "api", "m") for i in ids]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def _scores(spark, path):
    return {r["sub_subtask"]: r for r in spark.read.json(path).collect()}


def test_score_stream_resumes_from_checkpoint(spark, tmp_dir):
    inbox, out, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "scores", "ckpt"))
    W.write_jsonl(_results(spark, range(0, 30), lambda i: str(i % 3)), os.path.join(inbox, "a"))
    q = S.score_stream(spark, inbox + "/*", RESULT_SCHEMA, lambda: P.gold_or_none("correct_ids"),
                       lambda: P.code_selection("parsed"), out, checkpoint=ckpt, fmt="json")
    q.awaitTermination()
    first = _scores(spark, out)["choice3_ans1"]
    assert first["n_rows"] == 30 and first["accuracy"] == 1.0
    # more results arrive; a new query on the same checkpoint adds them to its state
    W.write_jsonl(_results(spark, range(30, 60), lambda i: "yes"), os.path.join(inbox, "b"))
    q = S.score_stream(spark, inbox + "/*", RESULT_SCHEMA, lambda: P.gold_or_none("correct_ids"),
                       lambda: P.code_selection("parsed"), out, checkpoint=ckpt, fmt="json")
    q.awaitTermination()
    second = _scores(spark, out)["choice3_ans1"]
    assert second["n_rows"] == 60 and second["n_invalid"] == 30
    assert second["accuracy"] == pytest.approx(0.5)


def test_respond_stream_batches_are_idempotent(spark, tmp_dir):
    inbox, results, ckpt = (os.path.join(tmp_dir, x) for x in ("items", "results", "ckpt"))
    items = spark.range(40).select(
        F.col("id"), F.lit("cup").alias("object"), F.lit("choice2_ans1").alias("sub_subtask"),
        F.array(F.lit(1)).alias("correct_ids"), F.array(F.lit("0:a"), F.lit("1:b")).alias("all_ids_with_term"),
        (F.col("id") % 2).cast("string").alias("recorded_response"))
    W.write_jsonl(items.repartition(4), inbox)

    def prompt(batch):
        return batch.withColumn("zero_shot", F.lit("q"))

    q = S.respond_stream(spark, inbox, ITEM_SCHEMA, prompt, ReplayResponder, RUN, results, checkpoint=ckpt,
                         max_files_per_trigger=1)
    q.awaitTermination()
    got = spark.read.json(results)
    assert got.count() == 40 and got.select("id").distinct().count() == 40
    assert got.select("batch_id").distinct().count() >= 2


def _versioned(spark, rows):
    """(id, parsed or None for a failed call, version)."""
    schema = T.StructType([*RESULT_SCHEMA.fields, T.StructField("error", T.StringType()), T.StructField("version", T.LongType())])
    return spark.createDataFrame([(i, [i % 3], p, "perception", "selection", "choice3_ans1" if i % 2 else None, "en", "api", "m",
                                   "failed" if p is None else None, v) for i, p, v in rows], schema)


@pytest.mark.parametrize("seed", range(3))
def test_scores_follow_the_last_answers_in_any_order(spark, tmp_dir, seed):
    """Failed calls, answers, re-answers and late old rows, repeated rows, in
    shuffled files over several batches and a restart: as a batch over each
    item's last row."""
    import random

    rng = random.Random(seed)
    rows = [(i, rng.choice([None, None, "0", "1", "2", "yes"]), v) for i in range(30) for v in range(rng.randint(1, 4))]
    rows += rows[:20]
    rng.shuffle(rows)
    inbox, out, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "scores", "ckpt"))
    schema = _versioned(spark, rows).schema
    for n, part in enumerate((rows[:40], rows[40:])):
        for k in range(2):
            _versioned(spark, part[k::2]).coalesce(1).write.parquet(os.path.join(inbox, f"{n}{k}"))
        q = S.score_stream(spark, inbox + "/*", schema, lambda: P.gold_or_none("correct_ids"), lambda: P.code_selection("parsed"), out,
                           checkpoint=ckpt, max_files_per_trigger=1, item_keys=["id"], version_col="version", lanes=3)
        q.awaitTermination()
    last = {}
    for i, p, v in rows:
        hit = p is not None and p == str(i % 3)
        last[i] = max(last.get(i, ()), (p is not None, v, hit, p == "yes"))
    for odd in (0, 1):
        mine = [r for i, r in last.items() if i % 2 == odd]
        got = spark.read.json(out).where("sub_subtask IS NOT NULL" if odd else "sub_subtask IS NULL").collect()[0]
        answered = [r for r in mine if r[0]]
        assert (got["n_rows"], got["n_error"], got["n_invalid"]) == (len(answered), len(mine) - len(answered), sum(r[3] for r in answered))
        assert got["accuracy"] == pytest.approx(sum(r[2] for r in answered) / len(answered))


def test_failed_calls_are_counted_apart(spark, tmp_dir):
    inbox, out, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "scores", "ckpt"))
    rows = _versioned(spark, [(1, "1", 0), (3, None, 0)])
    rows.write.parquet(inbox)
    S.score_stream(spark, inbox, rows.schema, lambda: P.gold_or_none("correct_ids"), lambda: P.code_selection("parsed"), out,
                   checkpoint=ckpt).awaitTermination()
    got = spark.read.json(out).collect()[0]
    assert (got["accuracy"], got["n_rows"], got["n_invalid"], got["n_error"]) == (1.0, 1, 0, 1)


class Gone:
    def respond(self, requests):
        from evalframe.operators.respond import NotFoundError

        raise NotFoundError("no such model")


def test_a_missing_model_fails_the_stream(spark, tmp_dir):
    inbox, results, ckpt = (os.path.join(tmp_dir, x) for x in ("items", "results", "ckpt"))
    W.write_jsonl(spark.range(3).select("id", F.lit("cup").alias("object")), inbox)
    q = S.respond_stream(spark, inbox, ITEM_SCHEMA, lambda b: b.withColumn("zero_shot", F.lit("q")), Gone, RUN, results, checkpoint=ckpt)
    with pytest.raises(Exception, match="no such model"):
        q.awaitTermination()
