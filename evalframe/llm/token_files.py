"""Token-id files: every document's ids compressed on its own against one
shared Zstandard dictionary, with an offset index for access to single
documents.

Format (version 1).  A table folder holds three Parquet tables, written by
Spark's committed writer, so any file system of the cluster can hold them:

* ``dictionary``: one row ``(dictionary_hash, dictionary, width, tokenizer)``.
  The dictionary is trained on serialized id arrays; ``dictionary_hash`` is
  its SHA-256 (an empty dictionary if there was too little to train on);
  ``width`` is the bytes of one id (2 if all ids of the vocabulary fit).
* ``blocks``: rows ``(shard, block, dictionary_hash, first_doc_id,
  last_doc_id, n_docs, before, n_tokens, doc_ids, counts, ends, payload)`` in
  ascending doc_id order within a shard; ``before``: ids of the shard's earlier
  blocks.  ``payload`` is the documents' frames one after
  another; ``doc_ids`` (int64), ``counts`` (tokens, int64) and ``ends`` (end
  of each frame in ``payload``, int64) are little-endian arrays: the offset
  index.  ``ids_of`` reads one document by decompressing its frame alone.
* ``shards``: rows ``(shard, start, n_tokens)``: ids before each shard.  Shards
  are consecutive ranges of doc_id.

Defined results: a text of any length is one frame, encoded whole; a null text is an empty text and has the end id only; a null
doc_id sorts before all others; repeated doc_ids stay separate documents, in
the order of their compressed bytes; an empty table gives empty tables;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.common import hashed_sample, range_bounds, shard_count, text_list
from evalframe.llm.word_cache import library_encoder, no_cycle_collection

# Documents and bytes of serialized ids that the dictionary is trained on, and its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 4 << 20, 64 << 10
LEVEL = 3
# A block closes at so many documents or compressed bytes.
BLOCK_DOCS, BLOCK_BYTES = 2_048, 4 << 20
# Documents of a shard, about.
SHARD_DOCS = 500
_LEAST_ID = -(1 << 63)

_ENCODED = "shard int, doc_id long, n_tokens long, frame binary"
_BLOCKS = ("shard int, block int, dictionary_hash string, first_doc_id long, last_doc_id long, n_docs long, "
           "before long, n_tokens long, doc_ids binary, counts binary, ends binary, payload binary")


def greatest_id(path: str) -> int:
    """The greatest id of a tokenizer's vocabulary, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


def width_of(greatest: int) -> int:
    return 2 if greatest < 1 << 16 else 4


@dataclass(frozen=True)
class Tokens:
    """How texts become ids: a file of the ``tokenizers`` library, its kind
    (``word_cache.library_encoder``), the id that ends a document and the
    bytes that hold one id (by default as many as its vocabulary needs)."""

    path: str
    kind: str = "byte"
    end_id: int = 0
    width: int = 0

    def __post_init__(self):
        if not self.width:
            object.__setattr__(self, "width", width_of(max(self.end_id, greatest_id(self.path))))

    def serialized(self, text: str) -> bytes:
        ids = np.frombuffer(library_encoder(self.path, self.kind).ids(text), dtype="<u4")
        return np.append(ids, self.end_id).astype(f"<u{self.width}").tobytes()


def train_dictionary(docs: DataFrame, tokens: Tokens, total: int) -> bytes:
    """A dictionary from a bounded sample: of ``SAMPLE_DOCS`` texts of the
    smallest hashes, each a window of its share of ``SAMPLE_BYTES`` that
    begins, in longer ones, where a hash says."""
    share = SAMPLE_BYTES // SAMPLE_DOCS
    text = F.coalesce("text", F.lit(""))
    begin = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.lit(1), F.length(text) - share + 1)) + 1
    rows = hashed_sample(docs.select("doc_id", F.substring(text, begin.cast("int"), F.lit(share)).alias("text")),
                         SAMPLE_DOCS, total, "doc_id").select("text").collect()
    parts = [tokens.serialized(r["text"])[:share] for r in rows]
    size = min(DICTIONARY_BYTES, sum(map(len, parts)) // 8)
    if size < 1024 or len(parts) < 16:
        return b""
    return zstandard.train_dictionary(size, parts, k=64, d=8).as_bytes()


def _zstd_dict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, path: str, tokens: Tokens) -> None:
    """Encode every text of ``docs`` (``doc_id``, ``text``), end each with the
    end id and write the tables described above under ``path``.

    One shuffle, of compressed frames, deals shards (ranges of doc_id) out;
    a task streams its shards in order and holds one block at a time.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total = docs.count()
    bounds = np.array(range_bounds(docs, "doc_id", shard_count(spark, total, SHARD_DOCS)), dtype=np.int64)
    dictionary = train_dictionary(docs, tokens, total)
    digest = hashlib.sha256(dictionary).hexdigest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycle_collection():
            shared = _zstd_dict(dictionary)
            if shared is not None:
                shared.precompute_compress(level=LEVEL)
            compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
            for b in batches:
                ids = b.column(0).fill_null(_LEAST_ID).to_numpy(zero_copy_only=False)
                raw = [tokens.serialized(t) for t in text_list(b.column(1))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.searchsorted(bounds, ids, side="left"), pa.int32()), b.column(0),
                    pa.array([len(r) // tokens.width for r in raw], pa.int64()),
                    pa.array([compress(r) for r in raw], pa.binary())], ["shard", "doc_id", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, held, held_bytes = None, 0, 0, [], 0

        def closed() -> pa.RecordBatch:
            ids = [r[0] for r in held]
            counts = [r[1] for r in held]
            row = [shard, block, digest, ids[0], ids[-1], len(held), before, sum(counts),
                   np.array([_LEAST_ID if i is None else i for i in ids], "<i8").tobytes(),
                   np.array(counts, "<i8").tobytes(), np.cumsum([len(r[2]) for r in held]).astype("<i8").tobytes(),
                   b"".join(r[2] for r in held)]
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(schema.names, row)}, schema=schema)

        for b in batches:
            for s, i, n, frame in zip(*(c.to_pylist() for c in b.columns)):
                if held and (s != shard or len(held) >= BLOCK_DOCS or held_bytes >= BLOCK_BYTES):
                    yield closed()
                    block, before, held, held_bytes = block + 1, before + sum(r[1] for r in held), [], 0
                if s != shard:
                    shard, block, before = s, 0, 0
                held.append((i, n, frame))
                held_bytes += len(frame)
        if held:
            yield closed()

    schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]])
                        for f in _BLOCKS.split(", ")])
    (docs.mapInArrow(encoded, _ENCODED).repartition("shard").sortWithinPartitions("shard", "doc_id", "frame")
     .mapInArrow(blocks, _BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks"))
    # at most shard_count rows, a bound that does not grow with the documents
    totals = (spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
              .orderBy("shard").collect())
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).astype(int).tolist()
    spark.createDataFrame([(r["shard"], starts[i], r["n"]) for i, r in enumerate(totals)],
                          "shard int, start long, n_tokens long").write.mode("overwrite").parquet(f"{path}/shards")
    spark.createDataFrame([(digest, bytearray(dictionary), tokens.width, tokens.path)],
                          "dictionary_hash string, dictionary binary, width int, tokenizer string"
                          ).write.mode("overwrite").parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary = row["dictionary_hash"], bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary under {path} does not match its hash")
    return digest, dictionary, row["width"]


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_zstd_dict(dictionary))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and, on request, ``ids``."""
    digest, dictionary, width = _dictionary(spark, path)
    starts = {r["shard"]: r["start"] for r in spark.read.parquet(f"{path}/shards").collect()}  # bounded as above
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _decompressor(dictionary)
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                counts = np.frombuffer(row["counts"], "<i8")
                ends = np.frombuffer(row["ends"], "<i8").tolist()
                ids = [np.frombuffer(frames.decompress(row["payload"][i:j]), f"<u{width}").astype("<u4")
                       for i, j in zip([0, *ends[:-1]], ends)]
                first = starts[row["shard"]] + row["before"]
                columns = [pa.array(doc_ids, mask=doc_ids == _LEAST_ID), pa.array(first + np.cumsum(counts) - counts),
                           pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in out.split(", ")])

    return (spark.read.parquet(f"{path}/blocks").select("shard", "dictionary_hash", "before", "doc_ids", "counts", "ends", "payload")
            .mapInArrow(sized, out))


def ids_of(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (a list for each row with that doc_id): Parquet
    statistics leave the blocks that can hold it, the offset index its frame."""
    _, dictionary, width = _dictionary(spark, path)
    frames, out = _decompressor(dictionary), []
    for row in spark.read.parquet(f"{path}/blocks").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).collect():
        ends = np.frombuffer(row["ends"], "<i8")
        for i in np.flatnonzero(np.frombuffer(row["doc_ids"], "<i8") == doc_id):
            frame = bytes(row["payload"][ends[i - 1] if i else 0:ends[i]])
            out.append(np.frombuffer(frames.decompress(frame), f"<u{width}").tolist())
    return out
