"""Retries as state with timers (F2): schedules, recovery, dead letters."""

from __future__ import annotations

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalframe.operators.respond import NotFoundError, RetryableError, ask
from evalframe.streaming import retries as R

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Rule:
    """Busy until attempt ``row["busy"] + 1``; ``row["bad"]`` fails for good."""

    def respond(self, requests):
        def one(r):
            if r["row"].get("bad"):
                return NotFoundError("no such model") if r["row"]["bad"] == "gone" else ValueError("bad")
            return RetryableError("busy") if r["attempt"] <= r["row"].get("busy", 0) else f"answer {r['row'].get('id')}"
        return [one(r) for r in requests]


def plain(rows: list[dict], most: int) -> dict[str, tuple]:
    """(answered, attempts, waited, error) by the rule, one request at a time."""
    out = {}
    for r in rows:
        if r.get("bad"):
            out[str(r["id"])] = (None, 1, 0.0, "not_found: no such model" if r["bad"] == "gone" else "failed: ValueError: bad")
            continue
        tries = min(r.get("busy", 0) + 1, most)
        waited = sum(10.0 * 2 ** i for i in range(tries - 1))
        failed = r.get("busy", 0) >= most
        out[str(r["id"])] = (None if failed else f"answer {r['id']}", tries, waited, "exhausted: RetryableError: busy" if failed else None)
    return out


ROWS = [{"id": i, "busy": i % 7} for i in range(40)] + [{"id": 100, "bad": "gone"}, {"id": 101, "bad": "yes"}]


def requests(spark, rows, path):
    df = spark.createDataFrame([(str(r["id"]), json.dumps(r)) for r in rows], "request string, payload string")
    df.repartition(3).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def tables(spark, root):
    read = lambda kind: spark.read.parquet(f"{root}/{R.TABLES[kind][0]}").collect()
    return read(R.ATTEMPT), read(R.ANSWER), read(R.DEAD)


def outcome(answered, dead):
    out = {r["request"]: (r["raw_response"], r["attempts"], r["waited_s"], None) for r in answered}
    assert not out.keys() & {r["request"] for r in dead}
    return out | {r["request"]: (None, r["attempts"], r["waited_s"], r["error"]) for r in dead}


def test_attempts_waits_and_dead_letters(spark, tmp_dir):
    stream = requests(spark, ROWS, tmp_dir + "/in")
    R.run_until_settled(lambda told: R.retry_stream(stream, Rule, tmp_dir + "/out", tmp_dir + "/ck", second=0.01, lanes=3, batch_size=7,
                                                    max_attempts=4, on_batch=told), len(ROWS), patience=120)
    attempts, answered, dead = tables(spark, tmp_dir + "/out")
    want = plain(ROWS, 4)
    assert outcome(answered, dead) == want and len(answered) + len(dead) == len(ROWS)
    tried: dict[str, list] = {}
    for a in sorted(attempts, key=lambda a: a["attempt"]):
        tried.setdefault(a["request"], []).append(a)
    for request, found in tried.items():
        assert [a["attempt"] for a in found] == list(range(1, want[request][1] + 1))
        assert [a["wait_s"] for a in found] == [0.0, 10.0, 20.0, 40.0][:len(found)]
        # a timer never fires early: a second is 10 ms here
        assert all(b["at_ms"] - a["at_ms"] >= 10 * b["wait_s"] for a, b in zip(found, found[1:]))
    assert {json.loads(r["payload"])["id"] for r in dead} == {int(k) for k, v in want.items() if v[3]}


def test_a_query_goes_on_from_its_checkpoint(spark, tmp_dir):
    """Stopped while requests are pending, then while a batch was not
    committed: attempts are counted on, no row is doubled, new requests join."""
    stream, done = requests(spark, ROWS, tmp_dir + "/in"), {"n": 0}
    settle = lambda counts: done.__setitem__("n", done["n"] + counts.get(R.ANSWER, 0) + counts.get(R.DEAD, 0))

    def start(told):
        return R.retry_stream(stream, Rule, tmp_dir + "/out", tmp_dir + "/ck", second=0.05, lanes=4, on_batch=told)

    first = start(lambda batch, counts: settle(counts))
    until = time.monotonic() + 60
    while done["n"] == 0 and time.monotonic() < until:
        time.sleep(0.05)
    first.stop()
    assert 0 < done["n"] < len(ROWS)  # those that answer at once, and the bad ones

    def fails_once(batch, counts):  # written, not committed
        if counts:
            raise RuntimeError("lost")

    second = start(fails_once)
    with pytest.raises(Exception, match="lost"):
        second.awaitTermination(60)
    more = [{"id": 200 + i, "busy": i} for i in range(3)]
    requests(spark, more, tmp_dir + "/in")
    settled = len({r["request"] for r in spark.read.parquet(tmp_dir + "/out/answers").collect()}
                  | {r["request"] for r in spark.read.parquet(tmp_dir + "/out/dead_letters").collect()})
    replayed = {"n": 0}

    def go_on(told):
        def counted(batch, counts):  # the batch that runs again was counted above
            replayed["n"] += 1
            told(batch, {} if replayed["n"] == 1 else counts)
        return start(counted)

    R.run_until_settled(go_on, len(ROWS) + len(more), settled, patience=120)
    attempts, answered, dead = tables(spark, tmp_dir + "/out")
    assert outcome(answered, dead) == plain(ROWS + more, 5) and len(answered) + len(dead) == len(ROWS) + len(more)
    assert len(attempts) == len({(a["request"], a["attempt"]) for a in attempts})


def test_odd_requests(spark, tmp_dir):
    """Null keys are not requests; a null payload is an empty row; the same
    pending key again is the same request; attempts by request."""
    rows = [("a", json.dumps({"id": "a", "busy": 9}), 2), ("a", json.dumps({"id": "a", "busy": 9}), 2), (None, "{}", 5), ("b", None, 5),
            ("c", json.dumps({"id": "c", "busy": 1}), 1)]
    spark.createDataFrame(rows, "key string, body string, n int").coalesce(1).write.parquet(tmp_dir + "/in")
    stream = spark.readStream.schema("key string, body string, n int").parquet(tmp_dir + "/in")
    R.run_until_settled(lambda told: R.retry_stream(stream, Rule, tmp_dir + "/out", tmp_dir + "/ck", "key", "body", "n", second=0.001, on_batch=told),
                        3, patience=120)
    _, answered, dead = tables(spark, tmp_dir + "/out")
    assert [(r["request"], r["raw_response"]) for r in answered] == [("b", "answer None")]
    assert sorted((r["request"], r["attempts"], r["waited_s"]) for r in dead) == [("a", 2, 10.0), ("c", 1, 0.0)]
    assert R.written(spark, tmp_dir + "/out", R.DEAD) and not os.path.exists(tmp_dir + "/out/nothing")


def test_single_failures_of_a_call_are_repeated_alone():
    """Without Spark: of a list of requests only those that failed for now are
    sent again."""
    calls, waits = [], []

    class Client(Rule):
        def respond(self, requests):
            calls.append([r["row"]["id"] for r in requests])
            return super().respond(requests)

    rows = [{"id": 1}, {"id": 2, "busy": 2}, {"id": 3, "bad": "yes"}, {"id": 4, "busy": 1}, {"id": 5, "busy": 9}]
    got = ask(Client(), [{"row": r} for r in rows], 4, 10.0, 2.0, waits.append, (RetryableError,))
    assert calls == [[1, 2, 3, 4, 5], [2, 4, 5], [2, 5], [5]] and waits == [10.0, 20.0, 40.0]
    want = plain(rows, 4)
    assert [(g[0], g[1], g[3], g[2]) for g in got] == [want[str(r["id"])][:3] + (want[str(r["id"])][3],) for r in rows]
