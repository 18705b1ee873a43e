"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised by a codebook
of its own, so ``k`` centroids a half make ``k * k`` cells.  For a query the
pairs of centroids are visited in the order of their summed distances with a
heap, until the cells visited hold the share of the entries that the index was
calibrated to; the entries of these cells are reranked by their cosine in
double precision.

Codebooks, and the share, come from a bounded sample: ``SAMPLE`` vectors of
the smallest hashes.  The share is the least at which ``TRIALS`` sample
queries find ``TARGET`` of their true neighbours in the sample, so data with
clusters are searched in few cells and data without structure in many.  Every
valid vector is an entry.

Equal vectors count as one entry with its ``k + 1`` smallest ids (they tie, so
no other can be among the results of any query), and equal queries are
searched once: a vector that a third of the rows share costs one search.
Entries are dealt into regions of neighbouring cells of about ``REGION``
entries, a larger cell into several, and a query visits a region only if a
cell of its list lies there.  The queries of a region are dealt into blocks of
about ``BLOCK``, each with the region's entries, so both sides of a group are
bounded.  Results per group are the best few, merged by query.

Defined results: null and zero vectors, vectors with null or non-finite
components, of another dimension than most, or with a null id take no part;
rows that repeat id and vector are one candidate; with fewer candidates all
are returned; an empty table gives no rows; columns other than ``vec_id`` and
``embedding`` are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import hashed_sample, saved

SAMPLE, TRIALS, TARGET = 20_000, 200, 0.97
REGION = 4_096
# Queries of a region that are searched in one group, about.
BLOCK = 4_096
# Cosines of a block this close to the last one kept are ranked by the exact
# score, which does not depend on the block.
ROUNDING = 1e-9


# -------------------------------------------------------------------- index

def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """k-means; a centroid that loses its members stays where it is."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.stack([np.bincount(a, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _distances(x, c).argmin(1) if len(x) else np.zeros(0, dtype=np.int64)


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells (``i * len(second) + j``) in the order of ``first[i] +
    second[j]``, until they hold ``wanted`` entries; empty ones are skipped."""
    k = len(second)
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    f, s = first[a].tolist(), second[b].tolist()
    a, b, sizes = a.tolist(), b.tolist(), counts
    heap, out, total = [(f[0] + s[0], 0, 0)], [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        n = sizes[cell]
        if n:
            out.append(cell)
            total += n
        if j + 1 < k:
            heapq.heappush(heap, (f[i] + s[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(f):  # each pair is pushed once: by the pair before it in its row
            heapq.heappush(heap, (f[i + 1] + s[0], i + 1, 0))
    return out


@dataclass(frozen=True)
class MultiIndex:
    half: int
    first: np.ndarray
    second: np.ndarray
    share: float

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return _nearest(unit[:, : self.half], self.first) * len(self.second) + _nearest(unit[:, self.half:], self.second)


def build(sample: np.ndarray, centroids: int, k: int, seed: int = 0) -> MultiIndex:
    """``sample``: unit vectors."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    first, second = _codebook(sample[:, :half], centroids, rng), _codebook(sample[:, half:], centroids, rng)
    index = MultiIndex(half, first, second, 1.0)
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(first) * len(second)).tolist()
    needed = []
    for i in rng.choice(len(sample), min(TRIALS, len(sample)), replace=False):
        near = sample @ sample[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(near) - 1))[:k]
        order = visited(_distances(sample[i:i + 1, :half], first)[0], _distances(sample[i:i + 1, half:], second)[0], counts, np.inf)
        at = dict(zip(order, np.cumsum([counts[c] for c in order])))
        needed += [at[c] / len(sample) for c in cells[best]]
    share = float(np.quantile(needed, TARGET)) if needed else 1.0
    return MultiIndex(half, first, second, min(1.0, share + 1 / len(sample)))


# ------------------------------------------------------------------- search

def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _mixed(key: int) -> int:
    """A hash of an id: ids may have a common divisor."""
    return zlib.crc32(key.to_bytes(8, "little", signed=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise, each row on its own: equal vectors give equal scores."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; ``is_query``: a
    condition on ``vec_id``; candidates are all rows but the query's own."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("vec", lambda c: c != 0))
    dims = v.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out)
    dim = dims["d"]
    # an entry per distinct vector: its key is its smallest id
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    ids = v.where(F.size("vec") == dim).distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    entries = saved(ids.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                    .select(F.col("ids")[0].alias("key"), "ids", "vec"), "entries")
    n = entries.count()
    sample = hashed_sample(entries, SAMPLE, n, "key").select("vec").toArrow()  # bounded
    centroids = int(min(1024, max(8, 2 ** round(np.log2(max(1, n) ** 0.5 / 4)))))
    index = build(_unit(_matrix(sample.column("vec"), dim)), centroids, k)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(_unit(_matrix(b.column(2), dim))) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int64())], names=["key", "ids", "vec", "cell"])

    placed = saved(entries.mapInArrow(celled, "key long, ids array<long>, vec array<double>, cell long"), "placed-entries")
    # at most centroids ** 2 rows
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counts.get(c, 0) for c in range(len(index.first) * len(index.second))]
    # regions: cells in order, about REGION entries each; a larger cell is split
    regions, region, room = [], 0, REGION
    for size in sizes:
        if size > room and room < REGION:
            region, room = region + 1, REGION
        parts = max(1, -(-size // REGION))
        regions.append((region, parts))
        if parts > 1:
            region, room = region + parts, REGION
        else:
            room -= size
    shared = spark.sparkContext.broadcast((index, sizes, regions))
    wanted = index.share * n

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries, once for each block of their region's queries."""
        _, _, regions = shared.value
        for b in batches:
            at = np.array([regions[c][0] + key % regions[c][1] for c, key in zip(b.column(3).to_pylist(), b.column(0).to_pylist())], dtype=np.int64)
            blocks = np.array([shared_blocks.value.get(r, 0) for r in at.tolist()], dtype=np.int64)
            for block in range(int(blocks.max(initial=0))):
                take = np.flatnonzero(blocks > block)
                yield pa.RecordBatch.from_arrays([pa.array(at[take]), pa.array(np.full(len(take), block)), *(c.take(pa.array(take)) for c in b.columns)],
                                                 names=["region", "block", *b.schema.names])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sizes, regions = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(_matrix(b.column(1), dim))
            first, second = _distances(unit[:, : index.half], index.first), _distances(unit[:, index.half:], index.second)
            rows, at, cells = [], [], []
            for i in range(b.num_rows):
                by_region: dict[int, list[int]] = {}
                for c in visited(first[i], second[i], sizes, wanted):
                    begin, parts = regions[c]
                    for r in range(begin, begin + parts):
                        by_region.setdefault(r, []).append(c)
                rows += [i] * len(by_region)
                at += by_region
                cells += by_region.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), b.column(0).take(take), b.column(1).take(take),
                                              pa.array(cells, pa.list_(pa.int64()))], names=["region", "qkey", "qvec", "cells"])

    def ranked(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """The best entries of one region for each query that visits it."""
        if not len(e) or not len(q):
            return pd.DataFrame({"qkey": [], "key": [], "ids": [], "score": []})
        x, cell = np.stack(e["vec"].to_list()), e["cell"].to_numpy()
        unit = _unit(x)
        names, inverse = np.unique(cell, return_inverse=True)
        parts = []
        for i in range(0, len(q), 256):
            block = q.iloc[i:i + 256]
            y = np.stack(block["qvec"].to_list())
            near = _unit(y) @ unit.T
            open_ = np.stack([np.isin(names, c) for c in block["cells"]])[:, inverse]
            near[~open_] = -np.inf
            m = min(k + 1, len(x))
            least = np.partition(near, len(x) - m, axis=1)[:, len(x) - m]
            # all that rounding may have put below the last one kept; of equal scores the smallest keys stay
            row, col = np.nonzero((near >= least[:, None] - ROUNDING) & np.isfinite(near))
            score, key = cosine(y[row], x[col]), e["key"].to_numpy()[col]
            order = np.lexsort((key, -score, row))
            row, col, score, key = row[order], col[order], score[order], key[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place <= k
            parts.append(pd.DataFrame({"qkey": block["qkey"].to_numpy()[row[first]], "key": key[first],
                                       "ids": e["ids"].to_numpy()[col[first]], "score": score[first]}))
        return pd.concat(parts)

    queries = v.where((F.size("vec") == dim) & is_query).distinct()
    query_keys = saved(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("_vec"))
                       .join(entries.select("key", "vec"), F.col("_vec") == F.col("vec")).select("query_id", "key", "vec"), "queries")
    distinct = query_keys.select(F.col("key").alias("qkey"), F.col("vec").alias("qvec")).dropDuplicates(["qkey"])
    # a row per region
    visits = distinct.mapInArrow(asked, "region long, qkey long, qvec array<double>, cells array<long>")
    blocks = {r["region"]: -(-r["n"] // BLOCK) for r in visits.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared_blocks = spark.sparkContext.broadcast(blocks)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in asked(batches):
            block = [_mixed(key) % shared_blocks.value[r] for r, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block, pa.int64()), *b.columns[1:]], names=["region", "block", *b.schema.names[1:]])

    left = placed.mapInArrow(dealt, "region long, block long, key long, ids array<long>, vec array<double>, cell long")
    right = distinct.mapInArrow(blocked, "region long, block long, qkey long, qvec array<double>, cells array<long>")
    found = left.groupBy("region", "block").cogroup(right.groupBy("region", "block")).applyInPandas(
        ranked, "qkey long, key long, ids array<long>, score double")
    # k + 1 results of every distinct query vector, so that its own rows can be left out
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    top = (found.select("qkey", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(best))
           .where(F.col("r") <= k + 1).drop("r"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (query_keys.select("query_id", "key").join(top, F.col("key") == F.col("qkey")).where("id != query_id")
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
