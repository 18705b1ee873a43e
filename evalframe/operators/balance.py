"""Dealing requests to tasks of equal cost (F1).

A model call costs by the length of its prompt and the number of its images,
so equal numbers of rows are not equal work: a task that happens to get the
long prompts is the one the others wait for.  ``deal_by_cost`` adds up cost by
bins of a hash (one small aggregate), gives the bins to tasks, the costliest
first to the task that has least, and sends each row to the task of its bin.

Rows of equal content fall into different bins: a bin is a hash of the row and
of its place among its partition's rows ordered by that hash, so it depends on
what a partition holds, not on the order in which it came, and a stage that
runs again deals alike.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators.joins import unused_name

# Bins for each task: a task's cost is off by about one bin.
BINS = 64


def request_cost(prompt_col: str = "prompt", images_col: str | None = None, per_image: int = 1_000, fixed: int = 50) -> Column:
    """Characters of the prompt, and so many for each image and each call."""
    cost = F.coalesce(F.length(prompt_col), F.lit(0)) + F.lit(fixed)
    return cost + F.coalesce(F.size(images_col), F.lit(0)) * per_image if images_col else cost


def tasks_of_bins(costs: dict[int, float], tasks: int) -> dict[int, int]:
    """Bin -> task: the costliest bin first, to the task that has least."""
    loads = [(0.0, t) for t in range(tasks)]
    out = {}
    for b in sorted(costs, key=lambda b: (-costs[b], b)):
        load, task = heapq.heappop(loads)
        out[b] = task
        heapq.heappush(loads, (load + costs[b], task))
    return out


def deal_by_cost(df: DataFrame, cost: Column, tasks: int) -> DataFrame:
    """``df`` in ``tasks`` partitions of about equal cost; no column is added.
    The costs of at most ``BINS * tasks`` bins go to the driver."""
    content, place, name = (unused_name(n, df.columns) for n in ("_content", "_place", "_bin"))
    hashed = df.withColumn(content, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).sortWithinPartitions(content)
    binned = hashed.withColumn(place, F.monotonically_increasing_id()).withColumn(
        name, F.pmod(F.xxhash64(content, place), F.lit(BINS * tasks)).cast("int"))
    costs = {r[0]: float(r[1] or 0) for r in binned.groupBy(name).agg(F.sum(cost.cast("double"))).collect()}
    task_of = tasks_of_bins(costs, tasks)
    lookup = F.array(*[F.lit(task_of.get(b, b % tasks)) for b in range(BINS * tasks)]) if BINS * tasks <= 4_096 else None
    if lookup is not None:
        task = F.get(lookup, F.col(name))
    else:  # a literal of all bins would make a large plan
        table = df.sparkSession.createDataFrame(sorted(task_of.items()), f"{name}_key int, {name}_task int")
        binned = binned.join(F.broadcast(table), F.col(name) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
        task = F.coalesce(F.col(f"{name}_task"), F.col(name) % tasks)
    return binned.repartitionById(tasks, task.cast("int")).select(*[F.col(f"`{c}`") for c in df.columns])
