"""Votes that come late (H3-H8): mergeable moments of each item's votes.

The vote statistics need every vote of an item again whenever one more comes.
Here a batch of votes becomes one row an item -- count, mean, sum of squared
deviations, least and greatest vote -- saved under the batch's id, and the rows
of an item are merged when they are read (the pairwise update of means and
squared deviations, which does not cancel like sums of squares).  Statistics
are then those of ``metrics.vote_stats``, and distances follow, without reading
any vote twice.

A batch that is committed again replaces its own rows.  ``compact`` folds all
batches into one; a fold counts, in place of its batches, once the file is
there that names them, so a fold that was cut off changes nothing.  Committing
a folded batch again is refused, as it would count twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.sinks.small_files import SmallFiles
from evalframe.sinks.writers import DYNAMIC

MOMENTS = "item {}, n long, mean double, m2 double, least int, most int"
FOLD = "fold-"


def moments(votes: DataFrame, item: str = "item", vote: str = "vote") -> DataFrame:
    """One row an item of the (non-null) votes: a partial aggregate."""
    v = F.col(vote).cast("double")
    return votes.where(F.col(vote).isNotNull()).groupBy(F.col(item).alias("item")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("m2"),
        F.min(vote).cast("int").alias("least"), F.max(vote).cast("int").alias("most"))


def _merged(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    delta = b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"),
                    (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"))


def merge(rows: DataFrame) -> DataFrame:
    """Rows of equal item as one.  A group is an item's rows, one a batch; they
    are merged in the order of their batches, so results repeat exactly."""
    parts = F.array_sort(F.collect_list(F.struct("batch", "n", "mean", "m2")))
    grouped = rows.groupBy("item").agg(parts.alias("parts"), F.min("least").alias("least"), F.max("most").alias("most"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    folded = grouped.withColumn("m", F.aggregate("parts", zero, _merged))
    return folded.select("item", "m.n", "m.mean", "m.m2", "least", "most")


def stats(rows: DataFrame) -> DataFrame:
    """The columns of ``metrics.vote_stats`` from merged moments."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("n") - 1)))
    # of equal votes the deviation is zero, whatever the rounding of the mean
    sd = F.when((F.col("n") > 1) & (F.col("least") == F.col("most")), F.lit(0.0)).otherwise(sd)
    return rows.select("item", F.col("mean").alias("vote_mean"), sd.alias("vote_sd"), (F.col("least") == F.col("most")).alias("unanimous"),
                       F.col("n").alias("n_votes"), F.col("most").alias("vote_max"))


class VoteMoments:
    """Moments of the votes of all batches below ``root``."""

    def __init__(self, spark: SparkSession, root: str, item_type: str = "long"):
        self.spark, self.root, self.files = spark, root.removeprefix("file:").rstrip("/"), SmallFiles(spark)
        self.schema = MOMENTS.format(item_type) + ", batch string"

    def _saved(self) -> DataFrame:
        path = f"{self.root}/moments"
        return self.spark.read.schema(self.schema).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], self.schema)

    def _last_fold(self) -> tuple[int, str | None, set[str]]:
        """Number and name of the last fold, and the batches it holds."""
        names = self.files.names(f"{self.root}/folds")
        if not names:
            return 0, None, set()
        fold = json.loads(self.files.read(f"{self.root}/folds/{names[-1]}"))
        return len(names), fold["name"], set(fold["batches"])

    def commit(self, batch: str, votes: DataFrame) -> None:
        if batch.startswith(FOLD) or batch in self._last_fold()[2]:
            raise ValueError(f"batch {batch} was folded")
        rows = moments(votes).withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option(*DYNAMIC).partitionBy("batch").parquet(f"{self.root}/moments")

    def _live(self) -> DataFrame:
        _, fold, held = self._last_fold()
        own = ~F.col("batch").startswith(FOLD)
        if held:
            own = (own & ~F.col("batch").isin(sorted(held))) | (F.col("batch") == fold)
        return self._saved().where(own)

    def merged(self) -> DataFrame:
        return merge(self._live())

    def stats(self) -> DataFrame:
        return stats(self.merged())

    def compact(self) -> None:
        number, _, held = self._last_fold()
        live = self._live()
        batches = {r["batch"] for r in live.select("batch").distinct().collect()}  # one row a batch
        batches = held | {b for b in batches if not b.startswith(FOLD)}
        name = FOLD + uuid.uuid4().hex
        rows = merge(live.where(F.col("batch").startswith(FOLD) | F.col("batch").isin(sorted(batches)))).withColumn("batch", F.lit(name))
        rows.write.mode("overwrite").option(*DYNAMIC).partitionBy("batch").parquet(f"{self.root}/moments")
        if not self.files.create(f"{self.root}/folds/{number:012d}.json", json.dumps({"name": name, "batches": sorted(batches)})):
            raise RuntimeError("another fold was published first")
