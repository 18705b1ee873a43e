"""Result and score writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.sources.readers import read_dataset

RESULT_PARTITIONS = ("task", "sub_task", "sub_subtask", "lang", "model_type", "model_name")
# An overwrite replaces the partitions it writes and leaves other runs' alone.
DYNAMIC = ("partitionOverwriteMode", "dynamic")
SCORE_PARTITIONS = ("task", "sub_task", "lang", "model_type", "model_name")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """JSON Lines, UTF-8 unescaped, null fields written as ``null`` (B1)."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_results(df: DataFrame, root: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Result rows partitioned by run (B2).  Partitions are overwritten
    dynamically (set on the writer, whatever the session has): a re-run
    replaces only its own (task, ..., model) partitions.

    No shuffle by the partition columns: one run is one partition value, so
    clustering on it would funnel the whole run through a single task.  Each
    task writes one file per run it holds instead."""
    cols = [c for c in RESULT_PARTITIONS if c in df.columns]
    w = df.write.mode(mode).option(*DYNAMIC).partitionBy(*cols)
    if fmt == "json":
        w.option("ignoreNullFields", "false").json(root)
    else:
        w.format(fmt).save(root)


def write_scores(df: DataFrame, root: str) -> None:
    """Score rows partitioned without ``sub_subtask`` (kept as a column)."""
    cols = [c for c in SCORE_PARTITIONS if c in df.columns]
    df.write.mode("overwrite").option(*DYNAMIC).partitionBy(*cols).option("ignoreNullFields", "false").json(root)


def read_results(spark: SparkSession, root: str, schema: T.StructType | None = None, fmt: str = "json") -> DataFrame:
    """Read a partitioned result table back; partition values stay strings
    (also when a partition column holds only nulls and would read as VOID)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.format(fmt).load(root)
    cols = {c: F.col(c).cast("string") for c in RESULT_PARTITIONS if c in df.columns}
    return df.withColumns(cols) if schema is None and cols else df


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV / TSV with a header; quotes doubled, whitespace kept (Spark trims
    it on write by default)."""
    (df.write.mode(mode).option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


def convert_to_jsonl(spark: SparkSession, src: str, schema: T.StructType | str, dest: str, **kw) -> None:
    """JSON / CSV / TSV -> JSON Lines directory (B4); ``kw`` go to the reader."""
    write_jsonl(read_dataset(spark, src, schema, **kw), dest)


def export_jsonl(results: DataFrame, path: str, family: str) -> None:
    """Result rows as JSON Lines with the task family's answer-column names
    (C12: selection ``original_response`` / ``response``, classification
    ``original_model_inference`` / ``model_inference``, generation
    ``original_response`` only), partitioned by run like the result table."""
    from evalframe.functions.prompts import answer_columns

    out = answer_columns(results, family)
    cols = [c for c in RESULT_PARTITIONS if c in out.columns]
    out.write.mode("overwrite").option(*DYNAMIC).partitionBy(*cols).option("ignoreNullFields", "false").json(path)
