"""The model call as a Spark job (F1) with retries (F2).

``respond`` runs a pluggable responder over partitions with ``mapInPandas``:
the responder is built once per task (model weights / client set up once),
rows arrive in Arrow batches, and each batch is answered as a list.  A failed
row becomes an error row (``error`` set, ``raw_response`` null); it never fails
the job, so a lost executor only re-runs its own partition.

A responder is any object with

    respond(requests: list[dict]) -> list[str]

(or, in the place of an answer, the exception by which that request failed),
where each request has ``prompt`` (text or rendered chat string), ``messages``
(optional), ``images`` (optional), ``gen_params`` (optional, normalised for
the backend), ``row`` (the input row as a dict) and ``attempt`` (from 1).
Raise ``NotFoundError`` if the model does not exist, and one of ``retryable``
(connection, timeout, ``RetryableError``) for a failure that may pass.  A
factory that closes over its configuration can carry a ``responder_id``, by
which workers may reuse what it built.  Optional class attributes: ``input_columns``
(row columns it reads; default all) and ``wants_messages`` (default True).
Pipelines send only those columns to Python, so wide or nested item columns
stay in the JVM.
"""

from __future__ import annotations

import gc
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.constants import RETRY_ATTEMPTS, RETRY_FACTOR, RETRY_FIRST_WAIT
from evalframe.operators.balance import deal_by_cost
from evalframe.operators.joins import unused_name


class NotFoundError(Exception):
    """Permanent failure: the model or resource does not exist."""


class RetryableError(Exception):
    """A failure that may pass: rate limits, overload, a status to be retried."""


RETRYABLE = (RetryableError, ConnectionError, TimeoutError)


class ReplayResponder:
    """Answers with a recorded response column (re-scoring past runs, tests)."""

    input_columns = ("recorded_response",)
    wants_messages = False
    reuse_across_tasks = True

    def __init__(self, column: str = "recorded_response"):
        self.column = column

    def respond(self, requests: list[dict]) -> list[str]:
        return [r["row"][self.column] for r in requests]


class DigestResponder:
    """Answers with the MD5 of what it was sent, written as
    ``role[type=value,...]|...``: shows that a request holds what it should."""

    input_columns = ()
    wants_messages = True
    reuse_across_tasks = True

    def respond(self, requests: list[dict]) -> list[str]:
        return [hashlib.md5(self.written(r["messages"]).encode()).hexdigest() for r in requests]

    @staticmethod
    def written(messages: Any) -> str:
        out = []
        for m in messages:
            content = m["content"]
            if content is None or isinstance(content, str):
                parts = f"text={content or ''}"
            else:
                parts = ",".join([f"{p['type']}={p['text'] if p['text'] is not None else p['image']}" for p in content])
            out.append(f"{m['role']}[{parts}]")
        return "|".join(out)


class PromptDigest:
    """Answers with the MD5 of the prompt."""

    input_columns = ()
    wants_messages = False

    def respond(self, requests: list[dict]) -> list[str]:
        return [hashlib.md5((r["prompt"] or "").encode()).hexdigest() for r in requests]


class EchoChoiceResponder:
    """Deterministic stand-in model: answers with the first option id found
    in the prompt's ``Options:`` line, else ``yes``."""

    input_columns = ()
    wants_messages = False

    def respond(self, requests: list[dict]) -> list[str]:
        out = []
        for r in requests:
            p = r.get("prompt") or ""
            i = p.find("Options: ")
            out.append(p[i + 9:i + 10] if i >= 0 else "yes")
        return out


class DownResponder:
    """A client whose every call fails for now."""

    input_columns = ()
    wants_messages = False

    def respond(self, requests: list[dict]) -> list[str]:
        raise ConnectionError("down")


class BusyResponder:
    """A client that answers with the recorded response, but not before
    attempt ``id % 7 + 1``, and takes no request of an ``id`` divisible by 11."""

    input_columns = ("id", "recorded_response")
    wants_messages = False

    def respond(self, requests: list[dict]) -> list:
        def one(r: dict):
            if r["row"]["id"] % 11 == 0:
                return ValueError("bad item")
            return ConnectionError("busy") if r["attempt"] <= r["row"]["id"] % 7 else r["row"]["recorded_response"]
        return [one(r) for r in requests]


_WORKER_RESPONDERS: dict[str, Any] = {}


def worker_responder(key: str, make_responder: Callable[[], Any]) -> Any:
    """One responder per Python worker process and key."""
    if key not in _WORKER_RESPONDERS:
        _WORKER_RESPONDERS[key] = make_responder()
    return _WORKER_RESPONDERS[key]


def responder_key(make_responder: Callable[[], Any]) -> str:
    """What a worker's responder may be reused for: the ``responder_id`` that
    comes with the factory, the class itself, or else this call alone (two
    closures of one function may build different clients)."""
    given = getattr(make_responder, "responder_id", None)
    if given is not None:
        return f"id:{given}"
    if isinstance(make_responder, type):
        return f"class:{make_responder.__module__}.{make_responder.__qualname__}"
    return f"call:{uuid.uuid4().hex}"


def retry_waits(attempts: int, first_wait: float = RETRY_FIRST_WAIT, factor: float = RETRY_FACTOR) -> list[float]:
    """Waits between ``attempts`` consecutive failed attempts (none after the last)."""
    return [first_wait * factor ** i for i in range(max(attempts - 1, 0))]


def ask(responder: Any, reqs: list[dict], max_attempts: int, first_wait: float, factor: float,
            sleep: Callable[[float], None], retryable: tuple) -> list[tuple[str | None, int, str | None, float]]:
    """(answer, attempts, error, waited) of each request.

    An exception in the place of an answer is the failure of that request
    alone.  After a retryable failure of a call its whole list is sent again,
    after one of single requests those, with growing waits; when attempts run
    out they failed (an outage is waited for once, not once a row).  A call
    that fails otherwise is not repeated: the list is halved until the requests
    that cause it stand alone.
    """
    out: list = [None] * len(reqs)
    todo, waited = list(range(len(reqs))), 0.0
    for i in range(max_attempts):
        try:
            got = responder.respond([{"attempt": i + 1, **reqs[j]} for j in todo])
            if len(got) != len(todo):
                raise ValueError(f"{len(got)} answers to {len(todo)} requests")
        except (NotFoundError, *retryable) as e:
            got = [e] * len(todo)
        except Exception as e:  # noqa: BLE001 - becomes an error row
            if len(todo) == 1:
                got = [e]
            else:
                half = len(todo) // 2
                rest = [r for part in (todo[:half], todo[half:])
                        for r in ask(responder, [reqs[j] for j in part], max_attempts - i, first_wait * factor ** i, factor, sleep, retryable)]
                for j, (answer, attempts, error, more) in zip(todo, rest):
                    out[j] = (answer, i + attempts, error, waited + more)
                return out
        again = []
        for j, a in zip(todo, got):
            if not isinstance(a, BaseException):
                out[j] = (a, i + 1, None, waited)
            elif isinstance(a, NotFoundError):
                out[j] = (None, i + 1, f"not_found: {a}", waited)
            elif not isinstance(a, retryable):
                out[j] = (None, i + 1, f"failed: {type(a).__name__}: {a}", waited)
            elif i == max_attempts - 1:
                out[j] = (None, i + 1, f"exhausted: {type(a).__name__}: {a}", waited)
            else:
                again.append(j)
        if not again:
            break
        todo, w = again, first_wait * factor ** i
        sleep(w)
        waited += w
    return out


def chunks(rows: list[int], most: int, costs: list[float] | None, budget: float | None) -> Iterator[list[int]]:
    """Rows in calls of at most ``most``, and of at most ``budget`` in all."""
    held: list[int] = []
    total = 0.0
    for j in rows:
        more = costs[j] if costs is not None and budget is not None else 0.0
        if held and (len(held) >= most or (budget is not None and total + more > budget)):
            yield held
            held, total = [], 0.0
        held.append(j)
        total += more
    if held:
        yield held


def _as_json(t: T.DataType) -> bool:
    """Does JSON hold values of this type exactly?"""
    if isinstance(t, T.ArrayType):
        return _as_json(t.elementType)
    if isinstance(t, T.StructType):
        return all(_as_json(f.dataType) for f in t.fields)
    return isinstance(t, (T.StringType, T.BooleanType, T.IntegerType, T.LongType))


def copier(value: Any) -> Callable[[], Any]:
    """Makes copies of what JSON holds; they share its texts alone."""
    if isinstance(value, list):
        parts = [copier(x) for x in value]
        return lambda: [p() for p in parts]
    if not isinstance(value, dict):
        return lambda: value
    nested = [(k, copier(x)) for k, x in value.items() if isinstance(x, (list, dict))]
    if not nested:
        return value.copy

    def copy() -> dict:
        out = value.copy()
        for k, made in nested:
            out[k] = made()
        return out
    return copy


def read_json(texts: list[str | None]) -> list:
    """What the texts hold, made anew for each of them.  Texts that most rows
    share are parsed once and then copied, which is faster."""
    distinct = set(texts)
    if 2 * len(distinct) > len(texts):
        return [None if t is None else json.loads(t) for t in texts]
    copies = {t: copier(None if t is None else json.loads(t)) for t in distinct}
    return [copies[t]() for t in texts]


@contextmanager
def uncollected() -> Iterator[None]:
    """No garbage collection meanwhile, nor later of what is made here: a batch
    of requests is many small objects in no cycle, over which the collector
    would walk again and again.  ``gc.unfreeze`` ends that."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
        gc.freeze()
    finally:
        if on:
            gc.enable()


def respond(df: DataFrame, make_responder: Callable[[], Any], prompt_col: str = "prompt",
            images_col: str | None = None, messages_col: str | Sequence[str] | None = None, pass_columns: Sequence[str] | None = None,
            out_col: str = "raw_response", max_attempts: int = RETRY_ATTEMPTS, first_wait: float = RETRY_FIRST_WAIT,
            factor: float = RETRY_FACTOR, sleep: Callable[[float], None] = time.sleep, batch: bool = True,
            partitions: int | None = None, skip_col: str | None = None,
            batch_size: int | None = None, params_col: str | None = None,
            gen_params: dict[str, Any] | None = None, retryable: Sequence[type] = RETRYABLE,
            cost: Column | None = None, batch_cost: float | None = None, returned: Sequence[str] | None = None) -> DataFrame:
    """One response per row (F1), with ``attempts``, ``waited_s`` and ``error``.

    ``batch=True`` sends a whole Arrow batch to the responder, ``batch=False``
    each row alone; a failure of a class in ``retryable`` repeats the call
    with growing waits, any other is narrowed down to the rows that cause it
    (F2, ``ask``).  Columns in ``pass_columns`` (default: all) are visible to the
    responder as ``request["row"]``.

    Model calls dominate the cost of this stage, and their cost is per row,
    not per byte, so its input (already narrowed to the columns the responder
    reads) is spread round-robin over ``partitions`` tasks -- by default
    ``spark.sql.shuffle.partitions``, the knob a cluster sizes to its data
    (``session.CLUSTER_CONF``).  Round-robin gives every task an even share
    whatever the input layout or key skew; AQE does not merge them.  Pass
    ``partitions`` sized to the item count (e.g. items / 1000) so a retried
    task redoes few calls, or ``partitions=0`` to keep the input partitioning.  A responder class with
    ``reuse_across_tasks = True`` is built once per Python worker process
    (workers are reused across tasks), so model weights load once per worker
    rather than once per task.
    With a ``cost`` of a row (``balance.request_cost``) the tasks get equal
    cost instead of equal numbers of rows, and ``batch_cost`` bounds what one
    call is sent (a costlier request goes alone).
    Rows where ``skip_col`` is true are not sent (error ``placeholder_mismatch``,
    0 attempts).  ``batch_size`` caps the requests per responder call (e.g. a
    GPU batch); by default one call gets a whole Arrow batch
    (``spark.sql.execution.arrow.maxRecordsPerBatch``).  Generation
    parameters reach the responder as ``request["gen_params"]``: the run's
    ``gen_params`` dict (a fresh copy per request), or per row from
    ``params_col`` (a ``map<string,string>``) when they vary by row.
    ``returned`` are the columns of ``df`` that come back (default: all).
    Messages that do not come back cross into Python as JSON, which is read far
    faster than nested Arrow values are turned into dicts and back.
    ``messages_col`` may be several columns, none of which comes back or is
    passed, whose messages follow one another; strings among them are JSON
    already.  So what all rows share is written once, where it is still small,
    and parsed once a batch.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cost_col = unused_name("_cost", df.columns) if batch_cost is not None and cost is not None else None
    if cost_col:
        df = df.withColumn(cost_col, cost.cast("double"))
    if partitions:
        df = df.repartition(partitions) if cost is None else deal_by_cost(df, F.col(cost_col) if cost_col else cost, partitions)
    reuse, key = bool(getattr(make_responder, "reuse_across_tasks", False)), responder_key(make_responder)
    back = [f.name for f in df.schema.fields if f.name != cost_col and (returned is None or f.name in returned)]
    out_schema = T.StructType([f for f in df.schema.fields if f.name in back] + [
        T.StructField(out_col, T.StringType(), True),
        T.StructField("attempts", T.IntegerType(), False),
        T.StructField("waited_s", T.DoubleType(), False),
        T.StructField("error", T.StringType(), True),
    ])
    visible = list(pass_columns) if pass_columns is not None else [c for c in df.columns if c != cost_col]
    pieces = [messages_col] if isinstance(messages_col, str) else list(messages_col or ())
    whole = pieces[0] if isinstance(messages_col, str) else None
    if whole and (whole in [*back, *visible] or not _as_json(df.schema[whole].dataType)):
        pieces = []
    for c in pieces:
        if c == whole or not isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.to_json(c, {"ignoreNullFields": "false"}))

    def requests(pdf: pd.DataFrame) -> list[dict]:
        n = len(pdf)
        rows = [dict(zip(visible, r)) for r in zip(*[pdf[c].tolist() for c in visible])] if visible else [{}] * n
        prompts = pdf[prompt_col].tolist() if prompt_col in pdf else [None] * n
        images = ([None if x is None else list(x) for x in pdf[images_col].tolist()]
                  if images_col else [None] * n)
        if pieces:
            msgs = [None if None in m else list(chain.from_iterable(m)) for m in zip(*[read_json(pdf[c].tolist()) for c in pieces])]
        else:
            msgs = pdf[whole].tolist() if whole else [None] * n
        if params_col:
            gps = [dict(x) if x is not None else None for x in pdf[params_col].tolist()]
        else:
            gps = [dict(gen_params) if gen_params is not None else None for _ in range(n)]
        return [{"prompt": p, "images": im, "messages": m, "row": r, "gen_params": g}
                for p, im, m, r, g in zip(prompts, images, msgs, rows, gps)]

    def answered(responder: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        with uncollected():
            all_reqs = requests(pdf)
        skip = pdf[skip_col].fillna(False).astype(bool).tolist() if skip_col else [False] * n
        live = [j for j in range(n) if not skip[j]]
        answers: list = [None] * n
        attempts = [0] * n
        waited = [0.0] * n
        errors: list = ["placeholder_mismatch" if s else None for s in skip]
        step = (batch_size or max(len(live), 1)) if batch else 1
        for chunk in chunks(live, step, pdf[cost_col].tolist() if cost_col else None, batch_cost):
            got = ask(responder, [all_reqs[j] for j in chunk], max_attempts, first_wait, factor, sleep, tuple(retryable))
            for j, found in zip(chunk, got):
                answers[j], attempts[j], errors[j], waited[j] = found
        return pdf[back].assign(**{out_col: pd.Series(answers, index=pdf.index, dtype=object),
                                   "attempts": pd.Series(attempts, index=pdf.index, dtype="int32"),
                                   "waited_s": pd.Series(waited, index=pdf.index, dtype="float64"),
                                   "error": pd.Series(errors, index=pdf.index, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = worker_responder(key, make_responder) if reuse else make_responder()
        for pdf in batches:
            try:
                out = answered(responder, pdf)
            finally:
                gc.unfreeze()
            yield out

    return df.mapInPandas(run, out_schema)
