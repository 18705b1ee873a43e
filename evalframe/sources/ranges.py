"""Reading one large document by many tasks (A2, A3, A4).

A CSV file whose quoted fields span lines, or a JSON document that is one array,
cannot be cut at a line break: what a byte means depends on all bytes before
it.  Two passes over byte ranges settle that:

1. Every range is summed up on its own, for each state in which it may be
   entered.  CSV has two (outside quotes, inside), and a range swaps them if it
   holds an odd number of quotes; a doubled quote is two.  JSON has three
   (outside a string, inside, after its backslash) and a depth, to which a
   range adds.  Summaries compose, so the states in which the ranges are
   entered are a prefix composition over a file's summaries: some bytes a range.
2. Every range is read again from its known state.  It gives the records that
   begin in it, whole, also where they end in a later one.

Records are parsed by Spark (``from_csv``, ``from_json``).  A file is never in
one task, unless it is no longer than a range; a task holds a range and what
is left of its last record.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.sources import asset_listing as AL

# Bytes of a range, and of a single read.
RANGE, BLOCK = 32 << 20, 4 << 20
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"


def _blocks(f: BinaryIO, begin: int, end: int) -> Iterator[bytes]:
    f.seek(begin)
    while begin < end and (data := f.read(min(BLOCK, end - begin))):
        begin += len(data)
        yield data


# ----------------------------------------------------------------------- CSV

class Csv:
    """States: 0 outside quotes, 1 inside."""

    n_states = 2

    @staticmethod
    def effects(blocks: Iterator[bytes]) -> list[tuple[int, int]]:
        odd = sum(b.count(b'"') for b in blocks) & 1
        return [(odd, 0), (1 - odd, 0)]

    @staticmethod
    def base(first: bytes) -> int:
        return 0

    @staticmethod
    def records(f: BinaryIO, begin: int, end: int, state: int, depth: int, base: int) -> Iterator[tuple[int, bytes]]:
        f.seek(max(0, begin - 1))
        at = begin
        if begin and (f.read(1) != b"\n" or state):  # in a record: its end first
            while line := f.readline():
                at += len(line)
                state ^= line.count(b'"') & 1
                if not state:
                    break
        state, held, start = 0, [], at
        while (held or at < end) and (line := f.readline()):
            at += len(line)
            held.append(line)
            state ^= line.count(b'"') & 1
            if not state:
                record = b"".join(held).rstrip(b"\r\n")
                if record:
                    yield start, record
                held, start = [], at
        if held:
            yield start, b"".join(held)


# ---------------------------------------------------------------------- JSON

_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL)
_TO_QUOTE = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|["\[\]{},]', re.DOTALL)
_SLASHES = re.compile(rb"\\*\Z")
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2


def _in_string(data: bytes, begin: int) -> int:
    """The state at the end of data that is in a string from ``begin`` on."""
    return ESCAPED if len(_SLASHES.search(data, begin).group()) & 1 else INSIDE


def _leave_string(data: bytes, state: int) -> int | None:
    """Where the string ends that is open at the beginning; None: not here."""
    m = _TO_QUOTE.match(data, 1 if state == ESCAPED else 0)
    return m.end() if m else None


class Json:
    """States: outside a string, inside, after a backslash; and a depth.
    Records are the objects of the outer array, or of the document itself."""

    n_states = 3

    @staticmethod
    def effect(data: bytes, state: int) -> tuple[int, int]:
        if not data:
            return state, 0
        begin = 0
        if state != OUTSIDE:
            found = _leave_string(data, state)
            if found is None:
                return _in_string(data, 1 if state == ESCAPED else 0), 0
            begin = found
        rest = _STRING.sub(b"", data[begin:])
        quote = rest.find(b'"')
        state = OUTSIDE
        if quote >= 0:  # a string that is open at the end: nothing behind its quote counts
            rest, state = rest[:quote], _in_string(data, begin)
        return state, sum(map(rest.count, (b"[", b"{"))) - sum(map(rest.count, (b"]", b"}")))

    @classmethod
    def effects(cls, blocks: Iterator[bytes]) -> list[tuple[int, int]]:
        out = [(s, 0) for s in range(cls.n_states)]
        for data in blocks:
            step = [cls.effect(data, s) for s in range(cls.n_states)]
            out = [(step[s][0], d + step[s][1]) for s, d in out]
        return out

    @staticmethod
    def base(first: bytes) -> int:
        """Depth of the records: 1 in an array."""
        return 1 if first.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"[" else 0

    @staticmethod
    def records(f: BinaryIO, begin: int, end: int, state: int, depth: int, base: int) -> Iterator[tuple[int, bytes]]:
        data, offset, start, at = b"", begin, None, 0  # ``data`` is of the file from ``offset``
        f.seek(begin)
        while True:
            more = f.read(BLOCK)
            data, at, done = data + more, at, not more
            if state != OUTSIDE and data:
                found = _leave_string(data, state)
                if found is None:
                    if done:
                        raise ValueError("a string of the document is never closed")
                    # only the end of a string that began before is wanted here
                    state, offset, data = _in_string(data, 1 if state == ESCAPED else 0), offset + len(data), b""
                    continue
                state, at = OUTSIDE, found
            last = at
            for m in _TOKEN.finditer(data, at):
                token = m.group()
                if token == b'"':  # open at the end of what was read
                    break
                if depth <= base and data[last:m.start()].strip(b" \t\r\n\xef\xbb\xbf") or depth == base and token[:1] == b'"':
                    raise ValueError("the document holds values that are no records")
                last = m.end()
                if token in (b"{", b"["):
                    if token == b"{" and depth == base:
                        if offset + m.start() >= end:
                            return
                        start = m.start()
                    elif depth == base and base:
                        raise ValueError("the document holds values that are no records")
                    depth += 1
                elif token in (b"}", b"]"):
                    depth -= 1
                    if depth == base and start is not None:
                        yield offset + start, data[start:m.end()]
                        start = None
                at = m.end()
            if start is None and offset + at >= end and depth <= base:
                return
            if done:
                if start is not None:
                    raise ValueError("the document ends within a record")
                return
            keep = at if start is None else start
            if start is None and depth > base:  # in a record that began before: a string may be open
                keep = at
            data, offset, at = data[keep:], offset + keep, at - keep
            start = None if start is None else 0


FORMATS: dict[str, type] = {"csv": Csv, "json": Json}

# -------------------------------------------------------------------- passes

_RANGE = "path string, number long, begin long, end long"


def files_below(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of paths or below them; names that begin with ``_`` or ``.`` are no data."""
    out = None
    for path in paths:
        plain = AL.plain_path(path)
        found = AL.list_assets(spark, plain).select("path", "length").where(~F.col("path").rlike(r"/[_.][^/]*$"))
        out = found if out is None else out.unionByName(found)
    return out


def split_records(files: DataFrame, kind: str, root: str, size: int | None = None, header: bool = False) -> DataFrame:
    """``path``, ``position``, ``record`` (text) of all records of ``files``
    (``path``, ``length``), with ``header`` less the first of each file;
    ``root``: any path of their store."""
    fmt, size = FORMATS[kind], size or RANGE
    ranges = files.where("length > 0").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))))
    ranges = ranges.select("path", "number", (F.col("number") * size).alias("begin"), F.least("length", (F.col("number") + 1) * size).alias("end"))
    n = ranges.count()
    tasks = max(1, min(n, 20_000))

    def over(run: Callable[[AL.LocalStore | AL.ArrowStore, dict], Iterator[dict]], schema: pa.Schema):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = AL.store_of(root)
            for b in batches:
                for row in b.to_pylist():
                    held, total = [], 0
                    for out in run(store, row):
                        held.append(out)
                        total += len(out.get("record") or b"")
                        if total >= BLOCK:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, total = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
        return each

    def summed(store: AL.LocalStore | AL.ArrowStore, row: dict) -> Iterator[dict]:
        with store.open(row["path"]) as f:
            effects = fmt.effects(_blocks(f, row["begin"], row["end"]))
            base = 0
            if row["begin"] == 0:
                f.seek(0)
                base = fmt.base(f.read(BLOCK))
        yield {**row, "states": [s for s, _ in effects], "depths": [d for _, d in effects], "base": base}

    def entered(rows: pa.Table) -> pa.Table:
        """The state in which each range of a file is entered."""
        out, state, depth, base = [], 0, 0, 0
        for row in sorted(rows.to_pylist(), key=lambda r: r["number"]):
            base = row["base"] if row["number"] == 0 else base
            out.append({k: row[k] for k in ("path", "number", "begin", "end")} | {"state": state, "depth": depth, "base": base})
            depth += row["depths"][state]
            state = row["states"][state]
        return pa.Table.from_pylist(out, schema=known)

    def read(store: AL.LocalStore | AL.ArrowStore, row: dict) -> Iterator[dict]:
        with store.open(row["path"]) as f:
            records = fmt.records(f, row["begin"], row["end"], row["state"], row["depth"], row["base"])
            if header and row["begin"] == 0:
                next(records, None)
            for position, record in records:
                yield {"path": row["path"], "position": position, "record": record}

    span = [("path", pa.string()), ("number", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]
    sums = pa.schema([*span, ("states", pa.list_(pa.int32())), ("depths", pa.list_(pa.int64())), ("base", pa.int32())])
    known = pa.schema([*span, ("state", pa.int32()), ("depth", pa.int64()), ("base", pa.int32())])
    found = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record", pa.binary())])
    first = ranges.repartition(tasks).mapInArrow(over(summed, sums), _RANGE + ", states array<int>, depths array<long>, base int")
    states = first.groupBy("path").applyInArrow(entered, _RANGE + ", state int, depth long, base int")
    rows = states.repartition(tasks).mapInArrow(over(read, found), "path string, position long, record binary")
    return rows.select("path", "position", F.col("record").cast("string").alias("record"))


def can_split(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Not for glob patterns and compressed files: Spark reads these."""
    if any(c in p for p in paths for c in "*?[{"):
        return False
    return files_below(spark, paths).where(F.col("path").rlike(COMPRESSED)).limit(1).count() == 0


def size_for(total: int, tasks: int) -> int:
    """Bytes of a range so that ``tasks`` have work, at most ``RANGE``."""
    return int(min(RANGE, max(64 << 10, math.ceil(total / max(1, tasks)))))
