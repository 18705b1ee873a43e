"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link if they differ in at most ``radius`` bits.  Each bit position
is given a random vector of ``radius + 1`` bits; for every non-zero vector
``v`` of that length, table ``v`` keeps the positions whose vector has an odd
product with ``v``.  The vectors of the at most ``radius`` positions in which
two linked fingerprints differ cannot span the whole space, so some ``v`` is
orthogonal to all of them, and in that table the two agree on every kept bit:
no linked pair is missed, whatever the random vectors are.

Only distinct fingerprints enter the tables (2^(radius+1) - 1 rows each), so
exact copies never meet.  A bucket of up to ``BUCKET`` members is compared in
blocks inside one task and sends on a spanning set of its links, never the
pairs.  The members of a larger bucket are dealt by a second family of
covering masks, built from other vectors, which again misses no linked pair;
what is still too large is cut into chunks, and every pair of chunks is
compared in a task of its own.  Components come from star rounds over the
links, each written to a scratch table; no link or component list reaches
the driver.

Defined results: a text of any length is hashed whole, one at a time; a null or
empty text, or one of white space only, has
fingerprint zero and is linked like any other; repeated rows give one row
each; ``component_id`` is the smallest non-null doc_id of the component (null
if it has none); an empty table gives no rows; columns other than ``doc_id``
and ``text`` are not read by :func:`components`, and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import saved, schema_with, text_list, unused_name
from evalframe.llm.fraction_sketch import shingle_hashes
from evalframe.llm.word_cache import no_cycle_collection
from evalframe.operators.skew import skew_join

# Members of a bucket that one task compares, and rows of one comparison block.
BUCKET, BLOCK = 4096, 512


# ------------------------------------------------------------- fingerprints

def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash of the text's word shingles, as a signed integer."""
    values = shingle_hashes(text, shingle)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 16):
        part = values[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, column: str, shingle: int = 4) -> DataFrame:
    """All rows and columns of ``docs`` and the fingerprint of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycle_collection():
            for b in batches:
                texts = text_list(b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t, shingle) for t in texts], pa.int64())],
                                                 names=[*b.schema.names, column])

    at = docs.columns.index("text")
    return docs.mapInArrow(run, schema_with(docs, **{column: "long"}))


# -------------------------------------------------------------------- masks

def covering_masks(radius: int, family: int) -> list[int]:
    """The masks of one family, as signed 64-bit integers."""
    vectors = np.random.default_rng([radius, family]).integers(1, 1 << (radius + 1), 64)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        odd = np.array([bin(int(x) & v).count("1") & 1 for x in vectors], dtype=np.uint8)
        masks.append(int(np.packbits(odd, bitorder="little").view("<i8")[0]))
    return masks


def _tables(rows: DataFrame, masks: list[int], table: str, key: str) -> DataFrame:
    """One row for each mask: ``table`` (number of the mask), ``key``."""
    entries = F.array(*[F.struct(F.lit(i).alias(table), F.col("fp").bitwiseAND(F.lit(m)).alias(key)) for i, m in enumerate(masks)])
    return rows.select("*", F.explode(entries).alias("_e")).select(*rows.columns, f"_e.{table}", f"_e.{key}")


# -------------------------------------------------------------------- links

def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _star_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member (ascending) and the smallest member of its component among
    them: breadth first, a block of the frontier against all not yet reached."""
    values = fps.astype(np.uint64)
    root = np.arange(len(fps))
    rest = np.arange(len(fps))
    while len(rest):
        first, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            for i in range(0, len(frontier), BLOCK):
                open_ = np.flatnonzero(~hit)
                if not len(open_):
                    break
                hit[open_] = _near(values[frontier[i:i + BLOCK]], values[rest[open_]], radius).any(axis=0)
            frontier, rest = rest[hit], rest[~hit]
            root[frontier] = first
    return fps, fps[root]


def links(fingerprints: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """``fingerprints``: distinct ``fp``.  Links ``(a, b)`` whose components
    are those of all pairs within ``radius``; ``a`` > ``b``."""

    def in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _star_links(np.sort(pdf["fp"].to_numpy()), radius)
        return pd.DataFrame({"a": a, "b": b})[a != b]

    out = "a long, b long"
    rows = _tables(fingerprints.select("fp"), covering_masks(radius, 0), "t0", "k0")
    sizes = saved(rows.groupBy("t0", "k0").agg(F.count(F.lit(1)).alias("n"), F.max("fp").alias("a"), F.min("fp").alias("b"))
                  .where("n > 1"), "bucket-sizes")
    pairs = sizes.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    small, large = (sizes.where(c).select("t0", "k0") for c in (F.col("n").between(3, bucket), F.col("n") > bucket))
    found = rows.join(small, ["t0", "k0"]).groupBy("t0", "k0").applyInPandas(in_bucket, out)
    # fingerprints of a large bucket, dealt anew by another family
    keys = ["t0", "k0", "t1", "k1"]
    second = _tables(rows.join(large, ["t0", "k0"]), covering_masks(radius, 1), "t1", "k1")
    sizes = saved(second.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes-2")
    second = second.join(sizes, keys)
    found2 = second.where(F.col("n") <= bucket).groupBy(*keys).applyInPandas(in_bucket, out)
    # what is still large: chunks of half a bucket, and every pair of chunks
    chunks = F.ceil(F.col("n") / F.lit(max(1, bucket // 2))).cast("int")
    chunked = (second.where(F.col("n") > bucket).withColumn("c", F.pmod(F.xxhash64("fp"), F.lit(1 << 31)).cast("int") % chunks)
               .select(*keys, "fp", "c", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"))
               .select(*keys, "fp", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j")))
    found3 = chunked.groupBy(*keys, "i", "j").applyInPandas(in_bucket, out)
    return pairs.unionByName(found).unionByName(found2).unionByName(found3)


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; ``root`` is the
    smallest node of the component.

    Rounds of large-star and small-star: each node's larger neighbours, then
    its smaller ones, are linked to the smallest of them, until no link
    changes; the rounds grow with the logarithm of a component's size.  Each
    round is a scratch table, so nothing is computed twice.
    """
    edges = saved(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").where("a != b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = (both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = (large.join(least, F.col("a") == F.col("u"))
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a != b").distinct())
        edges = saved(small, "links")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select("b").distinct().selectExpr("b as node", "b as root"))
        before = state


def roots(distinct: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """``distinct``: one row for each ``fp``, saved.  ``(fp, root)`` for each;
    the root is the smallest fingerprint of the component."""
    found = connected(links(distinct, radius, bucket)).select(F.col("node").alias("_fp"), "root")
    return (distinct.select("fp").join(found, F.col("fp") == F.col("_fp"), "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def components(docs: DataFrame, radius: int = 4, shingle: int = 4, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 lower-case
    hexadecimal digits), ``component_id``."""
    rows = saved(with_fingerprint(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "doc-fingerprints")
    # one row per distinct fingerprint from here, back to documents at the end
    groups = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    rooted = saved(groups.join(roots(groups, radius, bucket), "fp"), "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a root of very many fingerprints, a fingerprint of very many documents: salted
    by_fp = skew_join(rooted.select("fp", "root"), least, "root", "inner").select("fp", "component_id")
    return (skew_join(rows, by_fp, "fp", "inner")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id (a
    null one only if all are null); of several rows with it, the smallest."""
    fp = unused_name("_fp", docs.columns)
    marked = saved(with_fingerprint(docs, fp, shingle), "fingerprinted")
    ids = saved(marked.groupBy(F.col(fp).alias("fp"), "doc_id").agg(F.count(F.lit(1)).alias("n")), "fingerprint-ids")
    groups = saved(ids.select("fp").distinct(), "fingerprint-groups")
    best = (ids.join(roots(groups, radius, bucket), "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"), F.col("n"))).alias("k")))
    keep = best.select(F.col("k.fp").alias("_keep_fp"), F.col("k.doc_id").alias("_keep_id"), F.col("k.n").alias("_keep_n"))
    kept = marked.join(keep, (F.col(fp) == F.col("_keep_fp")) & F.col("doc_id").eqNullSafe(F.col("_keep_id")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # rows that share fingerprint and doc_id: one of them, chosen by all its columns
    one = kept.where("_keep_n > 1").groupBy("_keep_fp", "_keep_id").agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
    return kept.where("_keep_n = 1").select(*columns).unionByName(one.select(*columns))
