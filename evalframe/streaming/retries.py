"""Retries with durable timers (F2).

``respond`` waits inside a task: a task slot sleeps through every back-off, and
a lost executor forgets how often its requests were tried.  Here the waiting is
state.  ``retry_stream`` reads requests as a stream and keeps each one that
failed, with its attempts, its waits, its last error and the time it is due, in
a keyed state with a processing-time timer; when the timer fires the request is
sent again.  No task sleeps, requests that are not due hold no slot, and a
query that is started again from its checkpoint goes on with the attempts it
had made.

Requests are dealt to ``lanes`` by a hash of their key, so that a lane's
requests that are due together are sent in one call.  A lane's state is a map
in the RocksDB state store, not one value: an entry holds the requests of one
call that failed for now and are due together, as JSON of bounded size, so a
call costs a few accesses to the store and not some for each request.

Three tables come out, each partitioned by micro-batch and overwritten by it,
so a batch that runs again replaces its own rows:

* ``attempts``: every attempt: request, number, wait before it, time, error;
* ``answers``: request, response, attempts, waited_s;
* ``dead_letters``: requests given up: payload, last error, attempts, waited_s.

A request is known by its key; requests of equal key that are pending are one.
A null payload is sent as an empty row.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructType

from evalframe.constants import RETRY_ATTEMPTS, RETRY_FACTOR, RETRY_FIRST_WAIT
from evalframe.operators.respond import RETRYABLE, ask, responder_key, worker_responder
from evalframe.sinks import writers as W

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUTPUT = ("kind string, request string, payload string, attempt int, wait_s double, at_ms long, raw_response string, "
          "error string, attempts int, waited_s double")
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
# Characters of the requests of one entry of the state (a longer request goes alone).
ENTRY_CHARS = 1 << 20
ATTEMPT, ANSWER, DEAD = "attempt", "answer", "dead"
TABLES = {ATTEMPT: ("attempts", ["request", "attempt", "wait_s", "at_ms", "error"]),
          ANSWER: ("answers", ["request", "raw_response", "attempts", "waited_s"]),
          DEAD: ("dead_letters", ["request", "payload", "error", "attempts", "waited_s"])}


def table_schema(kind: str) -> StructType:
    return StructType([f for f in StructType.fromDDL(OUTPUT) if f.name in TABLES[kind][1]]).add("batch_id", LongType())


def written(spark: SparkSession, root: str, kind: str) -> bool:
    """Has any batch had rows of this kind?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{TABLES[kind][0]}")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


class RetryProcessor(StatefulProcessor):
    """The pending requests of a lane and the timer of the earliest one due."""

    def __init__(self, make_responder: Callable[[], Any], first_wait: float, factor: float, second: float, batch_size: int,
                 retryable: tuple[type, ...]):
        self.make_responder, self.key = make_responder, responder_key(make_responder)
        self.first_wait, self.factor, self.second = first_wait, factor, second
        self.batch_size, self.retryable = batch_size, retryable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # by the name of its first request: when they are due, and [name, payload, attempts, most, waited] of each
        self.pending = handle.getMapState("pending_calls", "first string", "due long, requests string")
        self.responder = worker_responder(self.key, self.make_responder)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        entries = [v for _, v in self.pending.iterator()]
        held, dues = {r[0] for _, requests in entries for r in json.loads(requests)}, {due for due, _ in entries}
        fresh: dict[str, tuple] = {}
        for pdf in rows:
            for request, payload, most in zip(pdf["request"], pdf["payload"], pdf["most"]):
                if request not in held:
                    fresh[request] = (None if pd.isna(payload) else payload, 0, int(most), 0.0)
            if len(fresh) >= self.batch_size:
                yield self._send(fresh, now, held, dues)
                fresh = {}
        if fresh:
            yield self._send(fresh, now, held, dues)
        self._wake_at_earliest(now, dues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due, dues, firsts = {}, set(), []
        for (first,), (at, requests) in self.pending.iterator():
            if at <= now:
                firsts.append((first,))
                due.update((r[0], tuple(r[1:])) for r in json.loads(requests))
            else:
                dues.add(at)
        for first in firsts:
            self.pending.removeKey(first)
        names = list(due)
        for at in range(0, len(names), self.batch_size):
            yield self._send({n: due[n] for n in names[at:at + self.batch_size]}, now, set(), dues)
        self._wake_at_earliest(now, dues)

    def _wake_at_earliest(self, now: int, dues: set[int]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if dues:
            self.handle.registerTimer(max(min(dues), now + 1))

    def _keep(self, again: dict[int, list[tuple]]) -> None:
        """Pending requests by the time they are due, in entries of bounded size."""
        for due, requests in again.items():
            entry, size = [], 0
            for r in requests:
                more = len(r[0]) + len(r[1] or "")
                if entry and size + more > ENTRY_CHARS:
                    self.pending.updateValue((entry[0][0],), (due, json.dumps(entry)))
                    entry, size = [], 0
                entry.append(r)
                size += more
            self.pending.updateValue((entry[0][0],), (due, json.dumps(entry)))

    def _send(self, requests: dict[str, tuple], now: int, held: set[str], dues: set[int]) -> pd.DataFrame:
        """One attempt of each request; what failed for now stays pending, and
        is added to ``held`` and ``dues``."""
        rows = [json.loads(p) if p else {} for p, *_ in requests.values()]
        sent = [{**{k: r.get(k) for k in ("prompt", "images", "messages", "gen_params")}, "row": r, "attempt": tried + 1}
                for r, (_, tried, _, _) in zip(rows, requests.values())]
        got = ask(self.responder, sent, 1, 0.0, 1.0, lambda s: None, self.retryable)
        out, again = [], {}
        for (request, (payload, tried, most, waited)), (answer, _, error, _) in zip(requests.items(), got):
            attempt = tried + 1
            wait = self.first_wait * self.factor ** (tried - 1) if tried else 0.0
            out.append((ATTEMPT, request, None, attempt, wait, now, None, error, attempt, waited))
            if error is None or attempt >= most or not error.startswith("exhausted"):
                kind = ANSWER if error is None else DEAD
                out.append((kind, request, payload, attempt, wait, now, answer, error, attempt, waited))
                continue
            wait = self.first_wait * self.factor ** tried
            again.setdefault(now + int(1000 * wait * self.second), []).append((request, payload, attempt, most, waited + wait))
            held.add(request)
        self._keep(again)
        dues.update(again)
        return pd.DataFrame(out, columns=_COLUMNS).astype({"attempt": "int32", "attempts": "int32"})

    def close(self) -> None:
        pass


def retry_stream(requests: DataFrame, make_responder: Callable[[], Any], root: str, checkpoint: str, key_col: str = "request",
                 payload_col: str = "payload", most_col: str | None = None, max_attempts: int = RETRY_ATTEMPTS,
                 first_wait: float = RETRY_FIRST_WAIT, factor: float = RETRY_FACTOR, second: float = 1.0, lanes: int | None = None,
                 batch_size: int = 1_000, retryable: tuple[type, ...] = RETRYABLE, on_batch: Callable[[int, dict[str, int]], None] | None = None,
                 trigger: str = "0 seconds") -> StreamingQuery:
    """Start answering a stream of requests, with their retries.

    ``requests`` has a key and a payload (a JSON object: ``prompt``,
    ``messages``, ``images``, ``gen_params`` and whatever the responder reads
    as ``row``; ``attempt`` is the number of the attempt); ``most_col`` gives attempts by request, else ``max_attempts``
    holds for all.  The waits are those of ``respond``; ``second`` is the length of a
    second of them.  ``on_batch`` is told, after a batch is written, how many
    rows of each kind it had.
    """
    spark = requests.sparkSession
    lanes = lanes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(key_col).cast("string")
    dealt = requests.where(key.isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(lanes)).alias("lane"), key.alias("request"), F.col(payload_col).cast("string").alias("payload"),
        (F.col(most_col).cast("int") if most_col else F.lit(max_attempts)).alias("most"))
    # a query that starts again runs no batch, so fires no timer, before a source has news: a clock always has
    clock = spark.readStream.format("rate").load().where("value < 0")
    dealt = dealt.unionByName(clock.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dealt.schema.fields]))
    processor = RetryProcessor(make_responder, first_wait, factor, second, batch_size, retryable)
    outcome = dealt.groupBy("lane").transformWithStateInPandas(processor, OUTPUT, "Append", "ProcessingTime")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).persist()
        counts = {r["kind"]: r["n"] for r in batch.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        for kind, (name, columns) in TABLES.items():
            if counts.get(kind):
                (batch.where(F.col("kind") == kind).select(*columns, "batch_id").write.mode("overwrite").option(*W.DYNAMIC)
                 .partitionBy("batch_id").parquet(f"{root.rstrip('/')}/{name}"))
        batch.unpersist()
        if on_batch is not None:
            on_batch(batch_id, counts)

    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:  # a query keeps the settings it was started with
        return (outcome.writeStream.foreachBatch(per_batch).outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(processingTime=trigger).start())
    finally:
        if before is None:
            spark.conf.unset(ROCKSDB[0])
        else:
            spark.conf.set(ROCKSDB[0], before)


def run_until_settled(start: Callable[[Callable[[int, dict[str, int]], None]], StreamingQuery], n_requests: int, settled: int = 0,
                      patience: float = 3_600.0) -> None:
    """Runs a ``retry_stream`` until ``n_requests`` are answered or given up
    (``settled`` of them before).  ``start`` gets the ``on_batch`` to pass on."""
    done = {"n": settled}

    def on_batch(_: int, counts: dict[str, int]) -> None:
        done["n"] += counts.get(ANSWER, 0) + counts.get(DEAD, 0)

    query = start(on_batch)
    until = time.monotonic() + patience
    try:
        while done["n"] < n_requests:
            if query.exception() is not None or not query.isActive:
                raise RuntimeError(f"the retry stream ended: {query.exception()}")
            if time.monotonic() > until:
                raise TimeoutError(f"{n_requests - done['n']} requests are pending")
            time.sleep(0.05)
    finally:
        query.stop()
