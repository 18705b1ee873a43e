"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the document's, sketches of parts merge by union, and the
share of one sketch found in another estimates the containment of a short
document in a very long one.  The least hash is kept as well (it also merges:
the least of a union is the least of the parts), so no document with a word
has an empty sketch.

``edited`` pairs each document with the next one in descending doc_id without
a global sort: shards are ranges of doc_id, dealt out by one shuffle of
compressed texts and streamed in order.  The bounds of the shards are doc_ids
of the table, so the first document of the next shard is known beforehand and
is also sent to the shard before it.

Defined results: a text of any length is sketched whole, one at a time; a null
or empty text has an empty sketch; empty sketches are
alike (1) only among themselves (else 0); a null doc_id sorts after all
others; rows that share a doc_id stay separate, in the order of their
compressed texts; a single document is its own next; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import range_bounds, shard_count, text_list
from evalframe.llm.word_cache import no_cycle_collection

SEED, SHINGLE = 42, 5
# The fraction of the hash range that is kept is one in so many.
SCALE = 8
# Documents of a shard, about.
SHARD_DOCS = 500
_LEAST_ID = -(1 << 63)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words (ASCII white space between,
    A-Z lower-cased), repeats included; of a shorter text, of all its words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[shingle - 1:].tolist()
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends)], dtype=np.uint64)


def sketch(text: str, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes below ``2**64 / scale``, and the least hash."""
    hashes = np.unique(shingle_hashes(text))
    return hashes[: max(1, int(np.searchsorted(hashes, np.uint64((1 << 64) // scale))))]


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both documents together."""
    both = np.union1d(a, b)
    return both[: max(1, int(np.searchsorted(both, np.uint64((1 << 64) // scale))))]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller in the larger."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def written(s: np.ndarray) -> str:
    """A sketch as text: 16 hexadecimal digits for each hash, ascending."""
    return s.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """``doc_id``, ``n_chars``, ``fingerprint``, ``edited_sha256``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.  The edited text
    has its last third replaced by the beginning of the next document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    cuts = range_bounds(docs, "doc_id", shard_count(spark, docs.count(), SHARD_DOCS))
    last = docs.agg(F.max("doc_id").alias("m")).first()["m"]
    bounds = np.array(cuts, dtype=np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            ids = b.column(0).fill_null(_LEAST_ID).to_numpy(zero_copy_only=False)
            shards = np.searchsorted(bounds, ids, side="left")
            bodies = np.array([pack(t.encode()) for t in text_list(b.column(1))] + [None], dtype=object)[:-1]
            first = np.flatnonzero((shards < len(bounds)) & (ids == np.append(bounds, 0)[shards]))
            wrap = np.flatnonzero(ids == (_LEAST_ID if last is None else last))
            rows = np.concatenate([np.arange(len(ids)), first, wrap])
            guest = np.concatenate([np.zeros(len(ids), int), np.ones(len(first), int), np.full(len(wrap), 1)])
            to = np.concatenate([shards, shards[first] + 1, np.zeros(len(wrap), int)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(guest, pa.int32()), b.column(0).take(pa.array(rows)),
                 pa.array(bodies[rows].tolist(), pa.binary())], ["shard", "guest", "doc_id", "body"])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        shard, held = None, None  # the document whose next one is awaited

        def finished(text: str, own: np.ndarray, next_text: str, next_sketch: np.ndarray) -> list:
            n = len(text)
            edited = text[: n - n // 3] + next_text[: n // 3]
            changed = sketch(edited, scale)
            return [n, written(own), hashlib.sha256(edited.encode()).hexdigest(), written(changed),
                    likeness(own, changed), likeness(own, next_sketch)]

        with no_cycle_collection():
            for b in batches:
                rows = []
                for s, guest, doc_id, body in zip(*(c.to_pylist() for c in b.columns)):
                    if s != shard:
                        shard, held = s, None
                    if guest and held is None:  # a further guest, or a shard of its own
                        continue
                    text = unpack(body).decode()
                    own = sketch(text, scale)
                    if held is not None:
                        rows.append([held[0], *finished(held[1], held[2], text, own)])
                    held = None if guest else (doc_id, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    out = ("doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, "
           "near_edited double, near_next double")
    names = [f.split()[0] for f in out.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in out.split(", ")]
    return (docs.mapInArrow(dealt, "shard int, guest int, doc_id long, body binary").repartition("shard")
            .sortWithinPartitions("shard", "guest", F.desc_nulls_last("doc_id"), "body").mapInArrow(streamed, out))
