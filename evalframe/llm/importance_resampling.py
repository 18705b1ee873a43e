"""Resampling towards a target distribution, with segment deduplication.

A text's features are its words and its pairs of neighbouring words, hashed
into buckets.  A bucket's gain says how much likelier it is in the target texts
than in the corpus; a document's weight is the mean gain of its features, and
documents are drawn without replacement by adding Gumbel noise to the weights.

Texts are cut at line breaks.  Lines repeat across documents, so the work is
done for distinct lines:

1. One pass writes each document as the keys of its lines, with the pairs of
   words that cross a line break, and each line's words with the number of its
   occurrences, summed within the task.
2. Equal lines are merged by a grouped sum.  The features of a distinct line
   are computed once; times its occurrences they give the corpus counts, to
   which the pairs across lines are added.
3. The gain of a distinct line is computed once and joined back to the lines
   of the documents.  Lines that hold a ``HOT``-th of all or more are at most
   ``HOT`` lines and are broadcast, so no key of the shuffled join is larger.

A line is known by the 128-bit BLAKE2 digest of its words.  The table of gains
has ``BUCKETS`` numbers.  Ranks need no global sort: there are at most some
100,000 distinct scores (weights and noise are whole thousandths of a bounded
logarithm), so the rows before a score are known from counts by score.

Defined results: a null or empty text, or one without a word, has no features
and the weight 0; every row is a document, repeated rows share their score and
take ranks next to each other in any order; ties go to the smaller doc_id,
null first; texts and lines of any length are read whole, one text at a time;
an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from evalframe.llm.common import saved
from evalframe.llm.word_cache import no_cycle_collection

BUCKETS = 10_000
# Lines with at least this fraction of all lines' occurrences are broadcast: at most HOT of them.
HOT = 10_000
# Distinct lines, and their bytes, that a task counts before it passes them on.
COUNTED_LINES, COUNTED_BYTES = 100_000, 32 << 20

# In UTF-8 every byte of a character beyond ASCII is 0x80 or more.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_SEGMENTS = ("row long, doc_id long, n_words long, n_features long, crossing array<int>, "
             "lines array<struct<line: binary, times: long>>, words binary, times long")
_LINES = "line binary, times long, buckets array<int>"
_COUNTS = "bucket int, n long"


def line_key(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def line_buckets(words: list[bytes]) -> list[int]:
    """Buckets of the words and of the pairs of neighbouring words."""
    single = [zlib.crc32(w) for w in words]
    pairs = [zlib.crc32(b" " + w, c) for c, w in zip(single, words[1:])]
    return [c % BUCKETS for c in single + pairs]


class _Line:
    """What a document needs to know of a line: its key, its number of words,
    and its ends for the pairs across lines."""

    __slots__ = ("words", "key", "n", "first", "last")

    def __init__(self, line: bytes):
        words = _WORD.findall(line)
        self.n, self.words = len(words), b" ".join(words)
        if words:
            self.key, self.first, self.last = line_key(self.words), b" " + words[0], zlib.crc32(words[-1])


def segments(texts: DataFrame, name: str) -> DataFrame:
    """A saved table with a row for each row of ``texts`` (``row`` is not null)
    and rows of distinct lines of a part of the texts (``words``, ``times``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
                            ("crossing", pa.list_(pa.int32())), ("lines", pa.list_(pa.struct([("line", pa.binary()), ("times", pa.int64())]))),
                            ("words", pa.binary()), ("times", pa.int64())])
        row = TaskContext.get().partitionId() << 40
        known: dict[bytes, _Line] = {}
        counted: Counter[bytes] = Counter()
        held = 0

        def flush() -> pa.RecordBatch:
            n = len(counted)
            nulls = [pa.nulls(n, f.type) for f in schema][:6]
            out = pa.RecordBatch.from_arrays([*nulls, pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], schema=schema)
            counted.clear()
            known.clear()
            return out

        with no_cycle_collection():
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                for i, text in enumerate(b.column(1)):
                    raw = text.as_py()
                    found, previous, crossing, n_words, n_features = Counter(), None, [], 0, 0
                    for part in raw.lower().split(b"\n") if raw else ():
                        line = known.get(part)
                        if line is None:
                            line = known[part] = _Line(part)
                            held += 2 * len(part) + 200
                        if line.n:
                            found[line.key] += 1
                            counted[line.words] += 1
                            n_words += line.n
                            n_features += 2 * line.n - 1
                            if previous is not None:
                                crossing.append(zlib.crc32(line.first, previous.last) % BUCKETS)
                                n_features += 1
                            previous = line
                    rows.append({"row": row, "doc_id": ids[i], "n_words": n_words, "n_features": n_features, "crossing": crossing,
                                 "lines": [{"line": k, "times": n} for k, n in found.items()], "words": None, "times": None})
                    row += 1
                    if len(counted) >= COUNTED_LINES or held >= COUNTED_BYTES:
                        yield flush()
                        held = 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
            yield flush()

    source = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return saved(source.mapInArrow(run, _SEGMENTS), name, "zstd")


def distinct_lines(parts: DataFrame, name: str) -> DataFrame:
    """``line``, ``times``, ``buckets``: each distinct line once, with its
    occurrences in all texts and the buckets of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([line_key(w) for w in words], pa.binary()), b.column(1).cast(pa.int64()),
                 pa.array([line_buckets(w.split(b" ")) for w in words], pa.list_(pa.int32()))], names=["line", "times", "buckets"])

    merged = parts.where("words is not null").groupBy("words").agg(F.sum("times").alias("times"))
    return saved(merged.mapInArrow(run, _LINES), name)


def _bucket_counts(rows: DataFrame) -> DataFrame:
    """Sums of ``times`` by bucket over ``buckets``, one row a bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            lists = b.column(1)
            if len(flat := lists.flatten().to_numpy(zero_copy_only=False)):
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                times = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
                np.add.at(total, flat, times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return rows.mapInArrow(run, _COUNTS)


def feature_counts(parts: DataFrame, lines: DataFrame) -> np.ndarray:
    """Features of all texts by bucket: those of distinct lines times their
    occurrences, and the pairs across lines."""
    inside = _bucket_counts(lines.select("times", "buckets"))
    across = _bucket_counts(parts.where("row is not null").select(F.lit(1).cast("long").alias("times"), F.col("crossing").alias("buckets")))
    total = np.zeros(BUCKETS, np.int64)
    for r in inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floored thousandths of the log ratio of its smoothed
    share in the target to that in the corpus."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _with_gain(rows: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and ``gain``, the summed gains of the row's ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            ends = np.cumsum(np.append(0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            sums = np.append(0, np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=[*keep, "gain"])

    source = rows.select(*keep, "buckets")
    return source.mapInArrow(run, StructType([source.schema[c] for c in keep]).add("gain", LongType()))


def weights(parts: DataFrame, lines: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` of every document."""
    documents = parts.where("row is not null")
    n_lines = lines.agg(F.sum("times").alias("n")).first()["n"] or 0
    by_line = _with_gain(lines, gain, ["line", "times"])
    is_hot = F.col("times") * HOT >= n_lines
    hot = by_line.where(is_hot).select("line", F.col("gain").alias("hot_gain"))
    cold = by_line.where(~is_hot).select("line", "gain")
    used = documents.select("row", F.explode("lines").alias("l")).select("row", "l.line", F.col("l.times").alias("k")).join(F.broadcast(hot), "line", "left")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_words", "n_features")]
    inside = [used.where("hot_gain is not null").select("row", *nothing, (F.col("k") * F.col("hot_gain")).alias("gain")),
              used.where("hot_gain is null").join(cold, "line").select("row", *nothing, (F.col("k") * F.col("gain")).alias("gain"))]
    across = _with_gain(documents.withColumn("buckets", F.col("crossing")), gain, ["row", "doc_id", "n_words", "n_features"])
    summed = across.unionByName(inside[0]).unionByName(inside[1]).groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")], F.sum("gain").alias("gain"))
    return summed.select("doc_id", "n_words", "n_features", F.expr(
        "case when n_features = 0 then 0 else (gain - pmod(gain, n_features)) div n_features end").cast("long").alias("weight"))


def with_score(weighted: DataFrame, salt: str) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise, whole thousandths, from a
    hash of ``salt`` and the id (nothing for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long"))


def with_rank(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank`` of the ``percent`` of the documents of ``least_words``
    words that have the highest scores; null for all others.  ``rows`` is read
    three times and should be a saved table."""
    able = F.col("n_words") >= least_words
    by_score = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # all scores in one task: at most some 100,000 rows
    before = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    scores = by_score.select("score", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                             F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long").alias("drawn")).where("before < drawn")
    tied = Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"))
    placed = rows.join(F.broadcast(scores.withColumnRenamed("score", "_score")), able & (F.col("score") == F.col("_score")), "left")
    undrawn = placed.where("before is null").select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    ranked = placed.where("before is not null").withColumn("rank", F.col("before") + F.row_number().over(tied))
    return undrawn.unionByName(ranked.select(*rows.columns, F.expr("case when rank <= drawn then rank end").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, salt: str = "7") -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` of every row
    of ``docs`` (``doc_id``, ``text``), towards the texts of ``target``."""
    parts = segments(docs, "segments")
    lines = distinct_lines(parts, "lines")
    target_parts = segments(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target-segments")
    gain = gains(feature_counts(parts, lines), feature_counts(target_parts, distinct_lines(target_parts, "target-lines")))
    scored = saved(with_score(weights(parts, lines, gain), salt), "scored")
    return with_rank(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
