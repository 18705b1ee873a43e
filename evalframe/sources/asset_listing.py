"""Listing of an asset store as a partitioned data source.

``binaryFile`` lists every file into the driver's file index before a plan
starts.  Here a partition is a path prefix, and its files are listed by the
task that reads it:

    spark.read.format("asset_listing").load("s3://bucket/images")

gives ``path``, ``name``, ``length``, ``modified``, and with the option
``content`` also the bytes, read by the task that lists them.  Planning looks for
directories only: from the root it goes down, level by level, until there are
``prefixes`` of them (default 256), and deals them to at most four times as
many partitions.  A partition lists directories with all below them (``deep``)
or, of directories that planning opened, the files right in them.  Planning
looks at the first ``PROBE`` entries of a directory at most; a larger one is
left whole to a task, so what it holds is bounded and no file is kept.

Filters on ``path`` -- equality, ``IN`` lists, ``LIKE 'prefix%'`` -- and on
``name`` are pushed down: directories that cannot hold a match are neither
opened nor listed.  (Spark also applies all filters itself.)

Paths without a scheme and ``file:`` are read from the executors' file system,
which must be shared; other schemes through ``pyarrow.fs`` (S3, GCS, HDFS).
"""

from __future__ import annotations

import fnmatch
import io
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

FORMAT = "asset_listing"
SCHEMA = "path string, name string, length long, modified timestamp"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
# Prefixes that planning looks for; entries of a directory it looks at.
PREFIXES, PROBE = 256, 10_000
# Rows of a batch, and bytes of contents after which one is passed on.
BATCH_ROWS, CONTENT_BYTES = 8_192, 8 << 20


@dataclass(frozen=True)
class Entry:
    path: str
    is_dir: bool
    length: int = 0
    modified: float = 0.0


class LocalStore:
    """Entries of a directory of the shared file system, as they are read."""

    @staticmethod
    def entries(directory: str) -> Iterator[Entry]:
        with os.scandir(directory) as found:
            for e in found:
                if e.is_dir():
                    yield Entry(e.path, True)
                else:
                    s = e.stat()
                    yield Entry(e.path, False, s.st_size, s.st_mtime)

    @staticmethod
    def is_file(path: str) -> bool:
        return os.path.isfile(path)

    @staticmethod
    def entry(path: str) -> Entry:
        s = os.stat(path)
        return Entry(path, False, s.st_size, s.st_mtime)

    @staticmethod
    def read(path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    @staticmethod
    def open(path: str) -> BinaryIO:
        return open(path, "rb")

    @staticmethod
    def write(path: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{uuid.uuid4().hex}.part", "wb") as f:
            f.write(content)
        os.replace(part, path)


class ArrowStore:
    """Entries of a directory of a store that ``pyarrow.fs`` knows."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, inside = fs.FileSystem.from_uri(root)
        self.prefix = root.rstrip("/").removesuffix(inside.strip("/"))

    def entries(self, directory: str) -> Iterator[Entry]:
        from pyarrow import fs

        for e in self.fs.get_file_info(fs.FileSelector(directory.removeprefix(self.prefix), allow_not_found=True)):
            is_dir = e.type == fs.FileType.Directory
            yield Entry(self.prefix + e.path.lstrip("/"), is_dir, 0 if is_dir else e.size, 0.0 if is_dir or e.mtime is None else e.mtime.timestamp())

    def is_file(self, path: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(path.removeprefix(self.prefix)).type == fs.FileType.File

    def entry(self, path: str) -> Entry:
        e = self.fs.get_file_info(path.removeprefix(self.prefix))
        return Entry(path, False, e.size, 0.0 if e.mtime is None else e.mtime.timestamp())

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path.removeprefix(self.prefix)) as f:
            return f.read()

    def open(self, path: str) -> BinaryIO:
        return io.BufferedReader(self.fs.open_input_file(path.removeprefix(self.prefix)))

    def write(self, path: str, content: bytes) -> None:
        inside = path.removeprefix(self.prefix)
        self.fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(part := f"{inside}.{uuid.uuid4().hex}.part") as f:
            f.write(content)
        self.fs.move(part, inside)


def store_of(root: str) -> LocalStore | ArrowStore:
    return LocalStore() if urlsplit(root).scheme in ("", "file") else ArrowStore(root)


def plain_path(root: str) -> str:
    """``file:`` paths as the executors' file system names them."""
    parts = urlsplit(root)
    return (parts.path if parts.scheme == "file" else root).rstrip("/") or "/"


@dataclass(frozen=True)
class Wanted:
    """What pushed filters leave: paths equal to or starting with one of
    ``paths`` (of all ``prefixes``), names among ``names``; ``None``: any."""

    paths: frozenset[str] | None = None
    prefixes: tuple[str, ...] = ()
    names: frozenset[str] | None = None

    def file(self, path: str) -> bool:
        return ((self.paths is None or path in self.paths) and all(path.startswith(p) for p in self.prefixes)
                and (self.names is None or path.rsplit("/", 1)[-1] in self.names))

    def below(self, directory: str) -> bool:
        """May a file below the directory match?"""
        inside = directory.rstrip("/") + "/"
        if not all(p.startswith(inside) or inside.startswith(p) for p in self.prefixes):
            return False
        return self.paths is None or any(p.startswith(inside) for p in self.paths)


@dataclass
class Prefixes(InputPartition):
    directories: list[str]
    deep: bool


class AssetListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def with_content(self) -> bool:
        return self.options.get("content", "false").lower() == "true"

    def schema(self) -> str:
        return SCHEMA + ", content binary" if self.with_content() else SCHEMA

    def reader(self, schema: StructType) -> AssetReader:
        return AssetReader(plain_path(self.options["path"]), int(self.options.get("prefixes", PREFIXES)), self.options.get("glob"), self.with_content())


class AssetReader(DataSourceReader):
    def __init__(self, root: str, prefixes: int, glob: str | None, content: bool = False):
        self.root, self.prefixes, self.glob, self.content, self.wanted = root, prefixes, glob, content, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        paths, prefixes, names = None, [], None
        for f in filters:
            column = getattr(f, "attribute", ())
            if isinstance(f, EqualTo | EqualNullSafe | In) and column in (("path",), ("name",)):
                values = frozenset(f.value if isinstance(f, In) else [f.value])
                if column == ("path",):
                    paths = values if paths is None else paths & values
                else:
                    names = values if names is None else names & values
            elif isinstance(f, StringStartsWith) and column == ("path",):
                prefixes.append(f.value)
            yield f  # Spark checks every filter again
        self.wanted = Wanted(paths, tuple(prefixes), names)

    def partitions(self) -> Sequence[InputPartition]:
        """Directories only: level by level, until there are enough."""
        store, level, shallow = store_of(self.root), [self.root], []
        if store.is_file(self.root):
            return [Prefixes([self.root], False)]
        leaves: list[str] = []
        while level and len(level) + len(leaves) < self.prefixes:
            below: list[str] = []
            for directory in level:
                seen, subdirectories = 0, []
                for entry in islice(store.entries(directory), PROBE + 1):
                    seen += 1
                    if entry.is_dir and self.wanted.below(entry.path):
                        subdirectories.append(entry.path)
                if seen > PROBE:  # too large to be looked at here: its task lists it
                    leaves.append(directory)
                else:
                    shallow.append(directory)
                    below += subdirectories
            level = below
        dealt = lambda ds: [ds[i::2 * self.prefixes] for i in range(min(len(ds), 2 * self.prefixes))]
        return [Prefixes(ds, deep) for deep, found in ((False, shallow), (True, leaves + level)) for ds in dealt(found)]

    def _files(self, store: LocalStore | ArrowStore, part: Prefixes) -> Iterator[Entry]:
        waiting = list(part.directories)
        while waiting:
            directory = waiting.pop()
            for entry in [store.entry(directory)] if directory == self.root and store.is_file(directory) else store.entries(directory):
                if entry.is_dir:
                    if part.deep and self.wanted.below(entry.path):
                        waiting.append(entry.path)
                elif self.wanted.file(entry.path) and (self.glob is None or fnmatch.fnmatchcase(entry.path.rsplit("/", 1)[-1], self.glob)):
                    yield entry

    def read(self, partition: Prefixes) -> Iterator[pa.RecordBatch]:
        store = store_of(self.root)
        some: list[Entry] = []
        contents: list[bytes | None] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([e.path for e in some]), pa.array([e.path.rsplit("/", 1)[-1] for e in some]),
                       pa.array([e.length for e in some], pa.int64()),
                       pa.array([int(e.modified * 1e6) for e in some], pa.timestamp("us", "UTC"))]
            if not self.content:
                return pa.RecordBatch.from_arrays(columns, schema=_ARROW)
            return pa.RecordBatch.from_arrays([*columns, pa.array(contents, pa.binary())], schema=_ARROW.append(pa.field("content", pa.binary())))

        held = 0
        for entry in self._files(store, partition):
            some.append(entry)
            if self.content:
                contents.append(content_of(store, entry.path))
                held += len(contents[-1] or b"")
            if len(some) >= BATCH_ROWS or held >= CONTENT_BYTES:
                yield batch()
                some, contents, held = [], [], 0
        if some:
            yield batch()


def content_of(store: LocalStore | ArrowStore, path: str | None) -> bytes | None:
    """The bytes of a file; null for one that is not there (any more)."""
    try:
        return None if path is None else store.read(path)
    except FileNotFoundError:
        return None


def list_assets(spark: SparkSession, root: str, glob: str | None = None, prefixes: int = PREFIXES, content: bool = False) -> DataFrame:
    """The files below ``root``, listed (and with ``content`` read) in tasks."""
    spark.dataSource.register(AssetListing)
    reader = spark.read.format(FORMAT).option("prefixes", str(prefixes)).option("content", str(content).lower())
    if glob:
        reader = reader.option("glob", glob)
    return reader.load(root)


def write_files(files: DataFrame, root: str) -> None:
    """Writes each ``content`` to its ``path`` below ``root``, in the tasks
    that hold the rows.  A file appears whole or not at all, so a task that
    runs twice does no harm; of rows of one path, one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store.write(path, content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    source = files.select("path", "content").where("path is not null and content is not null")
    source.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` (any columns with ``path``) and ``content``, read in the tasks
    that hold the paths, some ``CONTENT_BYTES`` at a time.  A path that is null
    or not there any more has no content."""
    at, schema = files.columns.index("path"), StructType([*files.schema.fields]).add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(root)
        for b in batches:
            start, held, size = 0, [], 0
            for i, path in enumerate(b.column(at).to_pylist()):
                held.append(content_of(store, path))
                size += len(held[-1] or b"")
                if size >= CONTENT_BYTES or i == b.num_rows - 1:
                    part = b.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
                    start, held, size = i + 1, [], 0

    return files.mapInArrow(run, schema)
