"""Item and few-shot readers.

Readers take an explicit schema: inferring would turn ids such as ``007``
into integers and costs an extra pass over the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.sources import ranges as RG

# Text that pandas' CSV reader turns into a missing value by default.
PANDAS_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """JSON Lines, one record per line (A1).  A malformed line fails the read
    (``FAILFAST``); blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _split(spark: SparkSession, paths: list[str], kind: str, header: bool = False) -> DataFrame:
    """Records of files that are cut into ranges for at least as many tasks as
    there are shuffle partitions."""
    files = RG.files_below(spark, paths)
    total = files.agg(F.sum("length")).first()[0] or 0
    return RG.split_records(files, kind, paths[0], RG.size_for(total, int(spark.conf.get("spark.sql.shuffle.partitions"))), header)


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, split: bool = True) -> DataFrame:
    """JSON documents that each hold an array of records (A2).  One document is
    read by many tasks (``sources.ranges``); ``split=False``, globs and
    compressed files: each file is read whole by one task."""
    paths = _paths(path)
    if not split or not RG.can_split(spark, paths):
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    schema = _schema(schema)
    return _split(spark, paths, "json").select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _na_to_null(df: DataFrame, na_values: Sequence[str] | None) -> DataFrame:
    if not na_values:
        return df
    cols = {f.name: F.when(F.col(f.name).isin(list(na_values)), F.lit(None)).otherwise(F.col(f.name))
            for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(cols) if cols else df


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, sep: str = ",",
                   na_values: Sequence[str] | None = PANDAS_NA_VALUES, multi_line: bool = False, split: bool = True) -> DataFrame:
    """CSV / TSV with a header row (A3, A4).

    Files are split among tasks, with ``multi_line=True`` (quoted fields may
    span lines) at the records that the quotes before them tell
    (``sources.ranges``); then ``split=False``, globs and compressed files are
    read by one task a file.  Quotes are escaped by doubling.  ``na_values``
    reproduces pandas' missing-value spellings on string columns; pass
    ``None`` to keep them as text.
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    paths = _paths(path)
    if not multi_line or not split or not RG.can_split(spark, paths):
        df = spark.read.schema(schema).option("header", "true").option("multiLine", str(multi_line).lower()).options(**options).csv(path)
        return _na_to_null(df, na_values)
    schema = _schema(schema)
    body = _split(spark, paths, "csv", header=True)
    return _na_to_null(body.select(F.from_csv("record", F.lit(schema.toDDL()), options).alias("r")).select("r.*"), na_values)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str, **kw) -> DataFrame:
    """Dispatch on the file suffix (A5); an unknown suffix is an error at plan
    time.  Nothing is written next to the input."""
    low = path.lower().rstrip("/")
    if low.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if low.endswith(".json"):
        return read_json_array(spark, path, schema, **{k: v for k, v in kw.items() if k == "split"})
    if low.endswith(".csv"):
        return read_delimited(spark, path, schema, ",", **kw)
    if low.endswith(".tsv"):
        return read_delimited(spark, path, schema, "\t", **kw)
    raise ValueError(f"unsupported dataset format: {path}")


FEW_SHOT_FILE_SCHEMA = T.StructType([
    T.StructField("user", T.StringType(), True),
    T.StructField("assistant", T.StringType(), True),
    T.StructField("images", T.ArrayType(T.StringType()), True),
])


def read_few_shot(spark: SparkSession, path: str) -> DataFrame:
    """Few-shot examples with their file order as ``ord``.

    The place of an example is its ``file``, then the ``block`` of the file
    that a task read, then ``ord`` within it: tasks need not get the files of
    a directory in their order.  JSON Lines are read as text and parsed with
    ``from_json``.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
             F.monotonically_increasing_id().alias("ord")]
    if not path.lower().endswith(".jsonl"):
        return read_dataset(spark, path, FEW_SHOT_FILE_SCHEMA, split=False).select(*place, "user", "assistant", "images")
    lines = spark.read.text(path, wholetext=False).where(F.trim("value") != "").select(*place, "value")
    parsed = lines.select("file", "block", "ord", F.from_json("value", FEW_SHOT_FILE_SCHEMA, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("file", "block", "ord", "r.user", "r.assistant", "r.images")
