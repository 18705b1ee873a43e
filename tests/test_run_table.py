"""Isolated commits and resume by digest: lost writers, concurrent writers,
copies, replaced runs."""

from __future__ import annotations

import os
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalframe.operators.respond import NotFoundError
from evalframe.plans import task_plans as PL
from evalframe.plans.evaluate import evaluate
from evalframe.sinks import run_table as RT
from tests.test_evaluate import KeyedResponder, _write, data_root  # noqa: F401 - a fixture

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules["tests.test_evaluate"])

RUN = {"task": "t", "sub_task": "s", "lang": "en", "model_type": "api", "model_name": "m"}
SCHEMA = "id int, tags array<string>, note string"
# nulls, empty against null arrays, a text that reads like null, equal rows
ROWS = [(1, ["a"], "x"), (1, ["a"], "x"), (1, ["a"], None), (1, [], None), (1, None, None), (None, None, "null"), (None, None, None),
        (None, None, None), (None, None, None), (2, ["a", None], ""), (2, ["a", "null"], ""), (2, ["a,null"], "")]


def answer(rows, by):
    """Result rows as a run leaves them: answers, but errors where ``id = 2``
    and ``by`` is ``first``."""
    fails = F.lit(by == "first") & F.coalesce(F.col("id") == 2, F.lit(False))
    return rows.withColumns({"raw_response": F.when(~fails, F.lit(by)), "error": F.when(fails, F.lit("failed")), "sub_subtask": F.lit("a")})


def resume(table, items, by, **kw):
    seen = table.log()
    left = table.pending(table.copies(items, ["id", "tags", "note"]), RUN, seen)
    return table.commit(answer(left, by), RUN, seen, **kw)


def whole(table):
    return sorted((repr((r["id"], r["tags"], r["note"])), r["raw_response"], r["error"]) for r in table.current(RUN).collect())


def test_digest_knows_values_apart(spark):
    keys = spark.createDataFrame(ROWS, SCHEMA).select(RT.item_digest(["note", "id", "tags"]).alias("k"),
                                                      RT.item_digest(["tags", "note", "id"]).alias("same")).collect()
    assert [r["k"] for r in keys] == [r["same"] for r in keys] and all(len(r["k"]) == 16 for r in keys)
    assert len({bytes(r["k"]) for r in keys}) == len({repr(r) for r in ROWS})


def test_resumed_equals_fresh(spark, tmp_dir):
    items = spark.createDataFrame(ROWS, SCHEMA)
    fresh = RT.RunTable(spark, tmp_dir + "/fresh")
    resume(fresh, items, "second")
    table = RT.RunTable(spark, tmp_dir + "/resumed", buckets=3)
    resume(table, items.limit(0), "first")
    resume(table, spark.createDataFrame(ROWS[::2], SCHEMA), "first")
    resume(table, items, "first")  # what fails, fails again
    assert table.current(RUN).where("error IS NOT NULL").count() == 3
    resume(table, items, "second")
    assert [r[:1] for r in whole(table)] == [r[:1] for r in whole(fresh)] and all(r[2] is None for r in whole(table))
    assert table.current(RUN).where("raw_response = 'second'").count() == 3  # only those that failed
    assert RT.RunTable(spark, tmp_dir + "/resumed").buckets == 3
    assert table.pending(table.copies(items, ["id", "tags", "note"]), RUN, table.log()).count() == 0


def test_the_ledger_is_not_shuffled(spark, tmp_dir):
    table = RT.RunTable(spark, tmp_dir, buckets=8)
    items = spark.createDataFrame(ROWS, SCHEMA)
    resume(table, items, "second")
    keyed = table.copies(items, ["id", "tags", "note"])
    plan = table.pending(keyed, RUN, table.log())._jdf.queryExecution().executedPlan().toString()
    ledger = plan[plan.index("Bucketed: true") - 200:]
    assert "SelectedBucketsCount: 8 out of 8" in plan
    # exchanges: the count of copies, then the items by key and copy
    assert plan.count("Exchange hashpartitioning(item_key") == 2 and "Exchange" not in ledger


def test_killed_writers_leave_nothing_that_is_read(spark, tmp_dir):
    table, items = RT.RunTable(spark, tmp_dir), spark.createDataFrame(ROWS, SCHEMA)

    def killed(_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        resume(table, items, "second", staged=killed)
    assert table.log() == [] and len(os.listdir(tmp_dir + "/rows")) == 1
    resume(table, items, "second")
    assert len(whole(table)) == len(ROWS)


@pytest.mark.parametrize("tries", [1, 2])
def test_concurrent_resumed_runs_repeat_nothing(spark, tmp_dir, tries):
    """Writers that computed the same pending rows: the later one leaves out
    what the earlier one answered, also if it is overtaken again."""
    table, items = RT.RunTable(spark, tmp_dir), spark.createDataFrame(ROWS, SCHEMA)
    resume(table, spark.createDataFrame(ROWS[:3], SCHEMA), "first")
    overtaken = iter([ROWS[2:6], ROWS[4:9]][:tries])

    def other(_):
        rows = next(overtaken, None)
        if rows is not None:
            resume(RT.RunTable(spark, tmp_dir), spark.createDataFrame(rows, SCHEMA), "other")

    resume(table, items, "second", staged=other)
    rows = whole(table)
    assert len(rows) == len(ROWS) and len(table.log()) == 2 + tries
    assert sorted(r[0] for r in rows) == sorted(repr(r) for r in ROWS)


def test_threads_that_commit_at_once(spark, tmp_dir):
    table, items = RT.RunTable(spark, tmp_dir), spark.createDataFrame(ROWS, SCHEMA)
    together, failures = threading.Barrier(3), []

    def write(by):
        try:
            first = [True]

            def wait(_):
                if first.pop() if first else False:
                    together.wait(60)
            resume(RT.RunTable(spark, tmp_dir), items, by, staged=wait)
        except BaseException as e:  # noqa: BLE001 - shown below
            failures.append(e)

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and len(table.log()) == 3
    assert sorted(r[0] for r in whole(table)) == sorted(repr(r) for r in ROWS)


def test_runs_begun_anew_replace_their_scope(spark, tmp_dir):
    table = RT.RunTable(spark, tmp_dir)

    def commit(sub, by, run=RUN, **kw):
        rows = table.copies(spark.createDataFrame([(i,) for i in range(3)], "id int").withColumn("sub_subtask", F.lit(sub)), ["id", "sub_subtask"])
        done = rows.withColumns({"raw_response": F.lit(by), "error": F.lit(None).cast("string")})
        return table.commit(done, run, table.log(), **kw)

    commit("a", "1", replaces=True)
    commit("b", "2")
    commit("a", "3", replaces=True, sub_subtasks=["a"])
    commit("b", "other", run=RUN | {"lang": "ja"}, replaces=True)
    counted = lambda: {(r["sub_subtask"], r["raw_response"]): r["count"] for r in table.current(RUN).groupBy("sub_subtask", "raw_response").count().collect()}
    assert counted() == {("a", "3"): 3, ("b", "2"): 3}
    both = spark.createDataFrame([(i, s) for i in range(4) for s in "ab"], "id int, sub_subtask string")
    assert table.pending(table.copies(both, ["id", "sub_subtask"]), RUN, table.log()).count() == 2
    commit("b", "5", replaces=True)
    assert counted() == {("b", "5"): 3}


class Missing:
    def respond(self, requests):
        raise NotFoundError("no such model")


class Yes:
    input_columns = ()
    wants_messages = False

    def respond(self, requests):
        return ["yes"] * len(requests)


@pytest.mark.parametrize("isolated", [False, True])
def test_a_missing_model_fails_resumed_runs(spark, tmp_dir, isolated):
    items = spark.createDataFrame([(1, "soft", 1), (2, "hard", 0)], "id long, term string, label int")
    run = PL.Run("taxonomic", "yes_no_classification", "ja", "api", "m")
    root = RT.RunTable(spark, tmp_dir + "/t") if isolated else tmp_dir + "/r"
    ask = lambda responder, resume, df=items: PL.eval_yes_no(spark, df, run, responder, results_root=root, resume=resume).collect()[0]
    for resumed in (True, False, True):
        with pytest.raises(RuntimeError, match="no such model"):
            ask(Missing, resumed)
    score = ask(Yes, True)  # earlier failures are no reason to fail, nor counted
    assert (score["n_rows"], score["n_error"], score["accuracy"]) == (2, 0, 0.5)
    assert ask(Missing, True)["n_rows"] == 2  # nothing was left to ask


def test_evaluate_isolated(spark, data_root, tmp_dir):  # noqa: F811
    """Two evaluations of one model at once, resumed, in parallel combinations."""
    out = os.path.join(tmp_dir, "out")
    gen = os.path.join(data_root, "commonsense", "generation")
    _write(os.path.join(gen, "ja.jsonl"), [{"image_id": "1", "object": "cup", "terms": ["smooth"]}])
    _write(os.path.join(gen, "few_shot_ja.jsonl"), [{"user": "u", "assistant": "a"}])
    args = (spark, ["commonsense"], ["classification", "generation"], "ja", "api", "gpt-4m", KeyedResponder, out)
    kw = dict(data_root=data_root, resume=True, isolated=True, max_parallel=2)
    outs, threads = [], []
    for _ in range(2):
        threads.append(threading.Thread(target=lambda: outs.append(evaluate(*args, **kw).collect())))
        threads[-1].start()
    for t in threads:
        t.join()
    again = evaluate(*args, **kw, export_jsonl=True).collect()
    assert len(outs) == 2 and [r["n_rows"] for r in again] == [3]
    table = RT.RunTable(spark, out + "/results")
    run = dict(zip(RT.RUN_COLUMNS, ("commonsense", "classification", "ja", "api", "gpt-4m")))
    assert table.current(run).count() == 3 and table.current(run | {"sub_task": "generation"}).count() == 1
    exported = spark.read.json(os.path.join(out, "jsonl", "task=commonsense"))
    assert exported.count() == 4 and not {"item_key", "call"} & set(exported.columns)
