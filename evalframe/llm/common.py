"""Shared helpers: reading tables, scratch tables, batching texts, row order.

Scratch tables live under ``spark.checkpoint.dir`` (``session.scratch_dir``),
so every executor sees them and a lost executor re-runs only its own tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from evalframe.operators.joins import unused_name  # noqa: F401 - used by the operators
from evalframe.session import apply_required_conf, scratch_dir

# Rows of one Arrow batch handed to a Python task.  Texts are long, so the
# default of 10,000 rows would hold tens of megabytes per batch.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Session options every operator of this subpackage relies on."""
    apply_required_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts the lineage, so
    what comes after never recomputes it.  ``compression``: of the files, the
    session's by default."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def text_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Column values as Python strings, nulls as empty strings."""
    return [x or "" for x in column.to_pylist()]


def hashed_sample(df: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """The ``n`` rows of the smallest hashes of ``keys``, of ``total`` rows.

    Rows of hashes that could not be among them are filtered out first, about
    twice as many as wanted stay: else every task would send its ``n`` smallest
    to the driver.
    """
    h = F.xxhash64(*keys).bitwiseAND(F.lit(0x7FFFFFFF))
    share = min(1.0, (2 * n + 100) / max(1, total))
    if share < 1:
        df = df.where(h < F.lit(int(share * (1 << 31))))
    return df.orderBy(h, *keys).limit(n)


def hashed_sample_by(df: DataFrame, group: str, totals: dict, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows of the smallest hashes of ``keys`` in each group, of
    ``totals[group]`` rows, in one pass; about ``2 n`` rows of a group are ranked."""
    if not totals:
        return df.limit(0)
    h = F.xxhash64(*keys).bitwiseAND(F.lit(0x7FFFFFFF))
    bound = F.create_map(*[F.lit(x) for g, total in totals.items() for x in (g, int(min(1.0, (2 * n + 100) / max(1, total)) * (1 << 31)))])
    rank, names = unused_name("_rank", df.columns), df.columns
    ordered = Window.partitionBy(group).orderBy(h, *keys)
    return df.where(h < bound[F.col(group)]).withColumn(rank, F.row_number().over(ordered)).where(F.col(rank) <= n).select(*names)


# Code points of the pieces that stand for a long text.
PIECE = 500


def spread(text: str, most: int) -> str:
    """The text, or about ``most`` code points of it: whole words of pieces
    spread over the whole text, those of the smallest hashes of their number."""
    if len(text) <= most:
        return text
    numbers = sorted(range(-(-len(text) // PIECE)), key=lambda i: zlib.crc32(i.to_bytes(8, "little")))[:max(1, most // PIECE)]
    pieces = [text[i * PIECE:(i + 1) * PIECE] for i in sorted(numbers)]
    inner = [p.split(None, 1)[-1].rsplit(None, 1)[0] if len(p.split(None, 2)) > 2 else p for p in pieces]
    return "\n".join(inner)


def with_spread_text(df: DataFrame, most: int) -> DataFrame:
    """``df`` with ``text`` shortened by ``spread`` where it is longer."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([None if t is None else spread(t, most) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1:]], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


_TYPES = {"long": LongType(), "double": DoubleType(), "string": StringType()}


def schema_with(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` and further columns (name to type)."""
    return StructType([*df.schema.fields, *(StructField(n, _TYPES[t]) for n, t in columns.items())])


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` increasing values that cut the rows of ``column``
    into about equal ranges (nulls are ignored)."""
    if parts <= 1:
        return []
    probabilities = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(column, probabilities, max(10_000, 10 * parts)).alias("q")).first()
    return sorted(set(row["q"] or []))


def shard_count(spark: SparkSession, size: float, per_shard: float, most: int = 20_000) -> int:
    """Shards of about ``per_shard`` units, at least four for each shuffle
    partition so that their hash deals them evenly, at most ``most``."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(min(most, max(4 * partitions, math.ceil(size / per_shard))))
