"""What all items of a run share is made once: examples, votes, messages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalframe.operators import fewshot as FS
from evalframe.operators.respond import DigestResponder, read_json, respond
from evalframe.plans import fixtures as fx
from evalframe.plans import q_evaluate as QE
from evalframe.plans import task_plans as PL
from evalframe.sinks import writers as W

SIZES = {"part": "p_partkey long, p_name string, p_type string, p_brand string", "orders": "o_orderkey long, o_orderpriority string, o_orderstatus string",
         "lineitem": "l_orderkey long, l_quantity double", "labels": "doc_id long, quality int, toxic int",
         "conversations": "conv_id long, turn long, role string, text string"}


def _tables(spark, folder):
    """Conversations of which some are longer, shared or have no id."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * (((c or 0) * 7 + t * 3) % 11 + 1) + f"{c}.{t}")
             for c in [*range(-30, 60), None] for t in range(6)]
    rows = {"part": [(i, f"n{i} m", "T A", "B") for i in range(20)], "orders": [(i, "1-URGENT", "O") for i in range(30)],
            "lineitem": [(i % 25, float(i % 9)) for i in range(120)] + [(None, 1.0)], "labels": [(i, i % 2, i % 2) for i in range(12)], "conversations": turns}
    for name, schema in SIZES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_inputs_are_computed_once(spark, tmp_path, monkeypatch):
    """Examples and votes, however many files need them; the files hold the shortest examples of their part."""
    sf, root = _tables(spark, tmp_path / "sf"), str(tmp_path / "data")
    pairs = fx.few_shot_pairs(spark, sf).collect()
    tables = []
    real = fx.table
    monkeypatch.setattr(fx, "table", lambda s, d, name: (tables.append(name), real(s, d, name))[1])
    plans = []
    write = W.write_jsonl
    monkeypatch.setattr(W, "write_jsonl", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a, **k))[1])
    QE._write_inputs(spark, sf, root)
    assert len(plans) == 40 and not any("Join" in p for p in plans)
    assert tables.count("lineitem") == 1 and "conversations" in tables
    for path, part, parts in (("perception/selection/choice4_ans1", 2, 5), ("taxonomic/multiple_choice_classification/choice3_ans1", 1, 4),
                              ("commonsense/classification", 0, 1)):
        got = [(r["user"], r["assistant"]) for r in spark.read.json(f"{root}/{path}/few_shot_ja.jsonl").collect()]
        mine = sorted((len(r["user"]) + len(r["assistant"]), r["fs_id"], r["ord"], r["user"], r["assistant"])
                      for r in pairs if r["fs_id"] - parts * int(r["fs_id"] / parts) == part)
        assert got == [r[3:] for r in mine[:QE.N_SHOTS]] and len(got) == QE.N_SHOTS


def _sets(spark):
    rows = [(0, i, f'u{i} "あ\n', f"a{i}", [f"f{i}.jpg"] if i else None) for i in range(3)]
    return FS.few_shot_sets(spark.createDataFrame(rows, "key long, ord long, user string, assistant string, images array<string>"), ["key"])


def _plan(spark, monkeypatch, run, **kw):
    plans = []
    real = W.write_results
    monkeypatch.setattr(W, "write_results", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a, **k))[1])
    items = spark.range(9).select("id", F.lit(0).cast("long").alias("key"), F.concat(F.lit("cup"), "id").alias("object"), F.lit("smooth").alias("term"),
                                  F.lit(1).alias("naturalness"), F.array(F.lit(1), F.lit(2)).alias("votes"))
    PL.eval_pair_rating(spark, items, run, DigestResponder, few_shot=_sets(spark), few_shot_keys=["key"], **kw)
    return plans[0]


@pytest.mark.parametrize("family", [None, "gpt4o", "llama3_instruct", "mllama_instruct", "molmo"])
def test_messages_of_examples_are_written_once_a_set(spark, monkeypatch, family):
    """No row turns its examples into messages or writes them as JSON."""
    above = _plan(spark, monkeypatch, PL.Run("commonsense", "classification", "en", "api", "m", family=family)).split("MapInPandas", 1)[1].split("Join", 1)[0]
    sent = [x for x in above.split("StructsToJsonEvaluator")[1:] if "few_shot" in x.split(" AS ")[0]]
    assert "StructsToJsonEvaluator" in above and not sent


def test_vote_statistics_are_computed_once_a_row(spark, monkeypatch):
    plan = _plan(spark, monkeypatch, PL.Run("commonsense", "classification", "en", "api", "m"), votes_col="votes").split("MapInPandas", 1)[0]
    assert 0 < plan.count("aggregate(votes") <= 4


@pytest.mark.parametrize("family", [None, "gpt4o", "llama3_instruct", "gemma2_instruct", "mllama_instruct", "molmo"])
@pytest.mark.parametrize("images", [None, "/img"])
def test_pieces_are_the_messages(spark, family, images):
    """What the responder gets equals the messages of examples that the caller
    attached, which are built row by row."""
    run = PL.Run("perception", "generation", "en", "api", "m", family=family, image_dir=images)
    items = spark.createDataFrame([(1, 0, "cup", ["a.jpg"]), (2, 9, None, None), (3, None, "", [])], "id long, key long, object string, image array<string>")

    def digests(it, **kw):
        out = PL.eval_generation(spark, it, run, DigestResponder, keep=("id",), with_images=True, **kw)
        return {r["id"]: r["original_response"] for r in out.collect()}
    attached = FS.attach_few_shot(items, _sets(spark), ["key"])
    got = digests(items, few_shot=_sets(spark), few_shot_keys=["key"])
    assert got == digests(attached) and len(set(got.values())) == 3


def test_requests_share_nothing_that_can_change(spark):
    class Changes:
        """Writes into the messages it was sent, then answers with them."""

        input_columns = ()

        def respond(self, requests):
            for r in requests:
                if r["messages"] is None:
                    continue
                r["messages"][0]["content"][0]["text"] += str(len(r["messages"]))
                r["messages"].append(None)
            return [json.dumps(r["messages"]) for r in requests]

    part = F.array(F.struct(F.lit("text").alias("type"), F.lit("t").alias("text")))
    df = spark.range(6).select("id", F.array(F.struct(F.lit("user").alias("role"), part.alias("content"))).alias("a"),
                               F.when(F.col("id") != 5, F.lit('[{"role": "x", "content": [1, null]}]')).alias("b"))
    out = respond(df, Changes, messages_col=["a", "b"], pass_columns=[], partitions=1, returned=["id"])
    got = {r["id"]: r for r in out.collect()}
    said = [{"role": "user", "content": [{"type": "text", "text": "t2"}]}, {"role": "x", "content": [1, None]}, None]
    assert all(json.loads(got[i]["raw_response"]) == said for i in range(5))
    assert got[5]["raw_response"] == "null"


def test_read_json():
    texts = ['{"a": [{"b": 1}, [2]]}', None, "[]", '"s"'] * 3
    got = read_json(texts)
    assert got == [json.loads(t) if t else None for t in texts] and got[0] is not got[4] and got[0]["a"][0] is not got[4]["a"][0]
    assert read_json(texts[:4]) == got[:4] and read_json([]) == []
