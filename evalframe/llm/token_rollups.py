"""Delta-maintained token totals.

Totals by source, language and tokenizer version are never recounted.  Each
change of a document is a signed row (an insert adds its tokens and one
document, a delete takes them away, a revision adds the difference of counts),
a batch of changes is summed to one delta row per group, and the totals are
the sum of all deltas.

A batch is committed under its id: its deltas are written to a folder of that
id, as a whole or not at all (Spark's committed writer; a batch counts only
with its ``_SUCCESS`` marker).  Committing a batch again replaces what it wrote
before with the same rows, so a replayed batch changes nothing.  ``compact``
folds batches into one base; a folded batch that is replayed is ignored.

Sums have partial aggregation before the shuffle, so a source that holds a
third of the rows costs each task one row.

Defined results: a null count is 0; null sources and languages are groups of
their own; rows that are repeated count each; a group whose documents and
tokens are both 0 has no row; an empty batch commits no rows; columns other
than those named below are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def deltas(changes: DataFrame) -> DataFrame:
    """``changes``: ``change``, ``source``, ``lang``, ``tokenizer``,
    ``n_tokens`` and ``old_tokens`` (of a revision).  One signed row a group."""
    change = F.col("change")
    tokens, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("n_tokens", "old_tokens"))
    sign = F.when(change == INSERT, 1).when(change == DELETE, -1).when(change == REVISE, 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(change, F.lit("null")))).cast("int"))
    signed = changes.select(*KEYS, sign.cast("long").alias("d"), F.when(change == REVISE, tokens - old).otherwise(sign * tokens).alias("t"))
    return signed.groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))


class Rollups:
    """The totals kept under ``path`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, kind: str) -> list[int]:
        """Ids of the complete folders of a kind."""
        top = self._path(f"{self.path}/{kind}")
        found = self._fs.listStatus(top) if self._fs.exists(top) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n) for n in names if self._fs.exists(self._path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _base(self) -> int | None:
        """The base with most batches folded in."""
        return max(self._listed("base"), default=None)

    def _folded(self) -> set[int]:
        base = self._base()
        return set() if base is None else {r[0] for r in self.spark.read.schema("batch long").parquet(f"{self.path}/folded/{base}").collect()}

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch; ``False`` if it has been folded into the base."""
        if batch in self._folded():
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch/{batch}")
        return True

    def totals(self) -> DataFrame:
        base, folded = self._base(), self._folded()
        parts = [f"{self.path}/batch/{b}" for b in self._listed("batch") if b not in folded]
        parts += [f"{self.path}/base/{base}"] * (base is not None)
        rows = self.spark.read.schema(_DELTAS).parquet(*parts) if parts else self.spark.createDataFrame([], _DELTAS)
        return (rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))

    def compact(self) -> None:
        """Folds all complete batches into a new base.  The list of folded
        batches is written first: a base counts only once it is complete."""
        folded = self._folded() | set(self._listed("batch"))
        base = (self._base() or 0) + 1
        self.spark.createDataFrame([(b,) for b in sorted(folded)], "batch long").write.mode("overwrite").parquet(f"{self.path}/folded/{base}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base/{base}")
