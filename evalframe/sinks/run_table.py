"""Result rows of runs in isolated commits, resumable by content digest.

A commit is staged and then published:

* its rows are written to ``rows/commit=<id>``, and the keys of its answered
  rows to the ledger ``keys/commit=<id>``, bucketed by key; nobody reads either
  yet, and what a killed writer leaves there is never read;
* one file, ``log/<version>.json``, names the commit and its run.  It is created
  only if that version does not exist, so of two writers one gets the version
  and the other looks at what was published in between.  A resumed run then
  leaves out the rows whose keys others have answered, and tries the next
  version.

Readers follow the log.  A run that starts anew replaces earlier commits of the
run, or of the sub_subtasks it ran; a resumed run adds to them.

An item is known by the MD5 of its canonical JSON, 128 bits whatever its width,
and the number of its copy: rows that are equal in all columns are asked once
each.  Resuming is an anti join on (digest, copy) with the ledger, which is
bucketed by both: the items are shuffled, the ledger is not, and copies of one
item lie in many buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.sinks.small_files import SmallFiles
from evalframe.sinks.writers import DYNAMIC

KEYS = ("item_key", "item_copy")
RUN_COLUMNS = ("task", "sub_task", "lang", "model_type", "model_name")


def item_digest(columns: Sequence[str]) -> Column:
    """128 bits of the canonical JSON of the columns: names in order, nulls
    written, so that null, an empty string and an empty array differ."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(set(columns))])
    return F.unhex(F.md5(F.to_json(row, {"ignoreNullFields": "false"})))


@dataclass(frozen=True)
class Commit:
    id: str
    run: dict[str, str]
    replaces: bool
    sub_subtasks: list[str] | None = None
    version: int = -1

    def same_run(self, run: dict[str, str]) -> bool:
        return self.run == run


class RunTable:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """``buckets``: of a new ledger, by default as many as shuffle
        partitions; an existing table keeps its own."""
        self.spark, self.root, self.files = spark, root.removeprefix("file:").rstrip("/"), SmallFiles(spark)
        wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.files.create(f"{self.root}/layout.json", json.dumps({"buckets": wanted}))
        self.buckets = json.loads(self.files.read(f"{self.root}/layout.json"))["buckets"]

    def log(self) -> list[Commit]:
        """What was published, in order: one small file a commit."""
        directory = f"{self.root}/log"
        return [Commit(**json.loads(self.files.read(f"{directory}/{n}")), version=int(n.split(".")[0])) for n in self.files.names(directory)]

    # ----------------------------------------------------------------- ledger

    def _ledger(self) -> str:
        """The ledger's table in this session's catalog."""
        name = "run_keys_" + uuid.uuid5(uuid.NAMESPACE_URL, self.root).hex
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (item_key BINARY, item_copy BIGINT, commit STRING) USING parquet "
                       f"OPTIONS ({DYNAMIC[0]} '{DYNAMIC[1]}') "
                       f"PARTITIONED BY (commit) CLUSTERED BY (item_key, item_copy) INTO {self.buckets} BUCKETS LOCATION '{self.root}/keys'")
        return name

    def answered(self, commits: Sequence[Commit]) -> DataFrame:
        """(item_key, item_copy) of the rows that these commits answered."""
        name = self._ledger()
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).where(F.col("commit").isin([c.id for c in commits])).select(*KEYS)

    # -------------------------------------------------------------- live rows

    def live(self, run: dict[str, str], log: Sequence[Commit] | None = None) -> list[tuple[Commit, set[str] | None]]:
        """Commits of a run that count, and the sub_subtasks of each that later
        ones replaced."""
        mine = [c for c in (self.log() if log is None else log) if c.same_run(run)]
        out: list[tuple[Commit, set[str]]] = []
        replaced: set[str] = set()
        for c in reversed(mine):
            out.append((c, set(replaced)))
            if c.replaces:
                if c.sub_subtasks is None:
                    break
                replaced |= set(c.sub_subtasks)
        return out[::-1]

    def rows(self, run: dict[str, str], schema: T.StructType | None = None, log: Sequence[Commit] | None = None) -> DataFrame:
        """All live rows of a run, with the ``commit`` that wrote them."""
        live = self.live(run, log)
        if schema is None:  # that of the last commit
            if not live:
                raise FileNotFoundError(f"{self.root} has no commit of {run}")
            schema = self.spark.read.parquet(f"{self.root}/rows/commit={live[-1][0].id}").schema
        full = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        if not live:
            return self.spark.createDataFrame([], full)
        base = f"{self.root}/rows"
        df = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/commit={c.id}" for c, _ in live])
        for c, gone in live:
            if gone:
                df = df.where(~((F.col("commit") == c.id) & F.coalesce(F.col("sub_subtask").isin(sorted(gone)), F.lit(False))))
        return df

    def current(self, run: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
        """One row for each item copy: its answer, or its last error if it was
        never answered."""
        log = self.log()
        rows = self.rows(run, schema, log)
        failed = rows.where("error IS NOT NULL")
        answers = rows.where("error IS NULL")
        version = F.create_map(*[F.lit(x) for c, _ in self.live(run, log) for x in (c.id, c.version)]) if log else F.create_map()
        last = (failed.join(answers.select(*KEYS), list(KEYS), "left_anti")
                .groupBy(*KEYS).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in failed.columns]), version[F.col("commit")]).alias("r")))
        return answers.unionByName(last.select("r.*")).drop("commit")

    # ----------------------------------------------------------------- resume

    @staticmethod
    def copies(items: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``items`` with ``item_key`` and ``item_copy``: rows that are equal in
        ``columns`` are numbered from 1.  Their number is a partial count, so
        no group of copies is gathered."""
        rest = [F.col(f"`{c}`") for c in items.columns]
        one = items.withColumn("item_key", item_digest(columns)).groupBy("item_key").agg(
            F.count(F.lit(1)).alias("n"), F.first(F.struct(*rest)).alias("row"))
        return one.select("item_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("item_copy"), "row.*")

    def pending(self, keyed: DataFrame, run: dict[str, str], log: Sequence[Commit]) -> DataFrame:
        """The item copies that no live commit has answered."""
        live = self.live(run, log)
        if not live:
            return keyed
        done = self.answered([c for c, gone in live if not gone])
        for c, gone in live:
            if gone:
                done = done.unionByName(self._answered_of(c, gone))
        return keyed.join(done, list(KEYS), "left_anti")

    def _answered_of(self, commit: Commit, gone: set[str]) -> DataFrame:
        """Answered keys of a commit less those of replaced sub_subtasks."""
        rows = self.spark.read.parquet(f"{self.root}/rows/commit={commit.id}")
        return rows.where(F.col("error").isNull() & ~F.coalesce(F.col("sub_subtask").isin(sorted(gone)), F.lit(False))).select(*KEYS)

    # ----------------------------------------------------------------- commit

    def _stage(self, rows: DataFrame) -> str:
        commit = uuid.uuid4().hex
        path = f"{self.root}/rows/commit={commit}"
        rows.write.parquet(path)
        back = self.spark.read.schema(rows.schema).parquet(path)
        keys = back.where("error IS NULL").select(*KEYS, F.lit(commit).alias("commit"))
        # a file a bucket: the shuffle deals keys as the buckets do; a dynamic
        # overwrite (of a partition that is new) stages each writer's files apart
        keys.repartition(self.buckets, *KEYS).write.insertInto(self._ledger(), overwrite=True)
        return commit

    def commit(self, rows: DataFrame, run: dict[str, str], seen: Sequence[Commit], replaces: bool = False,
               sub_subtasks: Sequence[str] | None = None, staged: Callable[[str], None] | None = None) -> str:
        """Publishes ``rows`` (with the key columns and ``error``), which were
        computed when ``seen`` was the log; gives the commit's id.  A commit
        that adds leaves out keys that were answered since.  ``staged`` is
        called before each try."""
        commit, known = self._stage(rows), len(seen)
        while True:
            if staged is not None:
                staged(commit)
            log = self.log()
            others = [c for c in log[known:] if c.same_run(run)]
            known = len(log)
            if others and not replaces:
                if any(c.replaces for c in others):  # the run was begun anew: only what is live now counts
                    others = [c for c, _ in self.live(run, log)]
                mine = self.spark.read.schema(rows.schema).parquet(f"{self.root}/rows/commit={commit}")
                commit = self._stage(mine.join(self.answered(others), list(KEYS), "left_anti"))
                continue
            entry = asdict(Commit(commit, run, replaces, None if sub_subtasks is None else list(sub_subtasks)))
            entry.pop("version")
            if self.files.create(f"{self.root}/log/{known:012d}.json", json.dumps(entry)):
                return commit
