"""Structured Streaming forms of the evaluation.

* ``respond_stream`` -- items arriving as files are prompted, answered and
  persisted micro-batch by micro-batch.  Each batch is written under its own
  ``batch_id`` partition with dynamic overwrite, so a batch replayed after a
  failure replaces its own output instead of duplicating it (the harness lost
  every unsaved row on a crash).
* ``score_stream`` -- scores over a result table that keeps growing, the full
  score table rewritten after every micro-batch; an item that is answered after
  an error, or answered again, moves from its old count to its new one.

Checkpoints live under the session's shared checkpoint directory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalframe.functions import parsing as P
from evalframe.functions import prompts as C
from evalframe.operators import metrics as M
from evalframe.operators.respond import respond
from evalframe.session import scratch_dir
from evalframe.sinks import writers as W
from evalframe.sinks.run_table import item_digest
from evalframe.streaming.retries import ROCKSDB


def respond_stream(spark: SparkSession, items_dir: str, item_schema: T.StructType,
                   prompt: Callable[[DataFrame], DataFrame], make_responder: Callable[[], Any], run: dict[str, str],
                   results_root: str, checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                   available_now: bool = True):
    """Start the streaming responder; returns the ``StreamingQuery``.

    ``prompt`` maps an item batch to one with a ``zero_shot`` column (and any
    other columns to persist).  ``run`` holds task, sub_task, lang,
    model_type, model_name.
    """
    reader = spark.readStream.schema(item_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    items = reader.json(items_dir)
    ckpt = checkpoint or scratch_dir(spark, "respond-stream-ckpt")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        prompted = prompt(batch)
        answered = respond(prompted, make_responder, prompt_col="zero_shot")
        parsed = answered.withColumn("parsed", P.extract_choice("raw_response"))
        tagged = C.tag_run(parsed, **run).withColumn("batch_id", F.lit(batch_id).cast("long"))
        cols = [c for c in W.RESULT_PARTITIONS if c in tagged.columns] + ["batch_id"]
        (tagged.write.mode("overwrite").option(*W.DYNAMIC).partitionBy(*cols).option("ignoreNullFields", "false").json(results_root))
        if not batch.isEmpty():
            written = spark.read.schema("error string, batch_id long").json(results_root).where(F.col("batch_id") == batch_id)
            gone = written.where(F.col("error").startswith("not_found")).first()
            if gone is not None:  # as in a batch run: nobody answers
                raise RuntimeError(gone["error"])

    w = items.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


DELTAS = ("n_correct", "n_rows", "n_invalid", "n_error")


class LastAnswers(StatefulProcessor):
    """What each item of a lane counts as, by its last row; a change gives the
    old row's counts back and adds the new one's.

    An answer counts before any error, a later ``version`` before an earlier
    one, so the state does not depend on the order in which rows arrive.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "item string", "answered boolean, version long, hit boolean, invalid boolean")

    @staticmethod
    def counts(row: tuple | None) -> tuple[int, ...]:
        """(n_correct, n_rows, n_invalid, n_error) of an item's row."""
        if row is None:
            return (0, 0, 0, 0)
        answered, _, hit, invalid = row
        return (int(hit), 1, int(invalid), 0) if answered else (0, 0, 0, 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        runs: dict[str, tuple] = {}
        for pdf in rows:
            tags = pdf[list(M.RUN_KEYS)].astype(object).where(pdf[list(M.RUN_KEYS)].notna(), None)
            for item, row, run in zip(pdf["item"], zip(pdf["answered"], pdf["version"], pdf["hit"], pdf["invalid"]),
                                      tags.itertuples(index=False, name=None)):
                row = (bool(row[0]), int(row[1]), bool(row[2]), bool(row[3]))
                if item not in best or row > best[item]:
                    best[item], runs[item] = row, run
        change: dict[tuple, list[int]] = {}
        for item, row in best.items():
            old = tuple(self.last.getValue((item,))) if self.last.containsKey((item,)) else None
            if old is not None and row <= old:
                continue
            self.last.updateValue((item,), row)
            sums = change.setdefault(runs[item], [0, 0, 0, 0])
            for i, (before, after) in enumerate(zip(self.counts(old), self.counts(row))):
                sums[i] += after - before
        moved = [(*run, *sums) for run, sums in change.items() if any(sums)]
        if moved:
            yield pd.DataFrame(moved, columns=[*M.RUN_KEYS, *DELTAS])

    def close(self) -> None:
        pass


def _start(spark: SparkSession, stream: DataFrame, mode: str, per_batch: Callable[[DataFrame, int], None], ckpt: str, available_now: bool,
           rocksdb: bool = False):
    before = spark.conf.get(ROCKSDB[0], None)
    if rocksdb:  # a query keeps the settings it was started with
        spark.conf.set(*ROCKSDB)
    try:
        w = stream.writeStream.outputMode(mode).foreachBatch(per_batch).option("checkpointLocation", ckpt)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    finally:
        if rocksdb:
            spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)


def score_stream(spark: SparkSession, results_dir: str, result_schema: T.StructType, gold: Callable[[], Any],
                 pred: Callable[[], Any], scores_root: str, checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None, available_now: bool = True, fmt: str = "parquet",
                 item_keys: Sequence[str] | None = None, version_col: str | None = None, lanes: int | None = None):
    """Start incremental scoring; returns the ``StreamingQuery``.

    ``gold`` / ``pred`` build the gold and predicted code columns from a
    result row (e.g. ``lambda: P.gold_or_none("correct_ids")``); ``fmt`` is
    the format of the result files (``evaluate`` writes Parquet).  Rows with
    an ``error`` are counted apart as ``n_error``, as in the batch plans.

    Without ``item_keys`` every row counts: one aggregate, partial and final
    per micro-batch and merged into the state store.  With them (the columns
    that make an item within its run) an item counts once, by its last row
    (``version_col``, e.g. a commit or batch number, orders rows): state per
    item turns a change into signed deltas of its run's totals, saved under the
    batch's number, so a batch that runs again replaces its own.  After each
    batch the complete score table is rewritten.
    """
    reader = spark.readStream.schema(result_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    results = reader.format(fmt).load(results_dir)
    ok = F.col("error").isNull() if "error" in results.columns else F.lit(True)
    hit = F.coalesce(gold() == pred(), F.lit(False))
    rows = results.select(*M.RUN_KEYS, ok.alias("answered"), hit.alias("hit"), F.coalesce(P.is_invalid(pred()), F.lit(False)).alias("invalid"),
                          *([item_digest([*item_keys, *M.RUN_KEYS]).alias("digest")] if item_keys else []),
                          (F.col(version_col).cast("long") if version_col else F.lit(0).cast("long")).alias("version"))
    ckpt = checkpoint or scratch_dir(spark, "score-stream-ckpt")
    root = scores_root.rstrip("/")

    def write_scores(sums: DataFrame) -> None:
        out = sums.where("n_rows > 0 OR n_error > 0").select(
            *M.RUN_KEYS, (F.col("n_correct") / F.when(F.col("n_rows") > 0, F.col("n_rows"))).alias("accuracy"), "n_rows", "n_invalid", "n_error")
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(root)

    if item_keys is None:
        n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
        answered = F.col("answered")
        sums = rows.groupBy(*M.RUN_KEYS).agg(n(answered & F.col("hit")).alias("n_correct"), n(answered).alias("n_rows"),
                                             n(answered & F.col("invalid")).alias("n_invalid"), n(~answered).alias("n_error"))
        return _start(spark, sums, "complete", lambda batch, _: write_scores(batch), ckpt, available_now)

    lanes = lanes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("item", F.hex("digest")).withColumn("lane", F.pmod(F.xxhash64("item"), F.lit(lanes))).drop("digest")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in M.RUN_KEYS), *(T.StructField(c, T.LongType()) for c in DELTAS)])
    deltas = dealt.groupBy("lane").transformWithStateInPandas(LastAnswers(), schema, "Update", "None")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        summed = batch.groupBy(*M.RUN_KEYS).agg(*[F.sum(c).alias(c) for c in DELTAS]).withColumn("batch_id", F.lit(batch_id).cast("long"))
        summed.write.mode("overwrite").option(*W.DYNAMIC).partitionBy("batch_id").parquet(f"{root}_deltas")
        back = spark.read.schema(schema).parquet(f"{root}_deltas")
        write_scores(back.groupBy(*M.RUN_KEYS).agg(*[F.sum(c).alias(c) for c in DELTAS]))

    return _start(spark, deltas, "update", per_batch, ckpt, available_now, rocksdb=True)
