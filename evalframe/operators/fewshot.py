"""Few-shot examples (A6) and their attachment to items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.operators.joins import unused_name
from evalframe.operators.skew import heavy_keys
from evalframe.session import scratch_dir

# Sets of so many bytes in all, written as JSON, are broadcast to dealt items.
BROADCAST_BYTES = 16 << 20

# Messages of a set as JSON text.
MESSAGES_JSON = "_few_shot_messages_json"

FEW_SHOT_TYPE = "array<struct<ord:bigint,user:string,assistant:string,images:array<string>>>"


def few_shot_sets(examples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the examples in file order.

    ``examples`` has ``ord`` (position), ``user``, ``assistant`` and optional
    ``images``; ``file`` and ``block`` (as ``read_few_shot`` gives them) come
    before ``ord``.  ``collect_list`` order is not defined, so the place leads
    the struct and the array is sorted by it.  A few-shot set is a short list
    of prompt examples; each group is one such list.
    """
    if "images" not in examples.columns:
        examples = examples.withColumn("images", F.lit(None).cast("array<string>"))
    place = [c for c in ("file", "block") if c in examples.columns]
    fields = [F.col("ord").cast("bigint").alias("ord"), F.col("user").cast("string").alias("user"),
              F.col("assistant").cast("string").alias("assistant"), F.col("images")]
    sets = examples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*place, *fields))).alias("few_shot"))
    if place:
        sets = sets.withColumn("few_shot", F.transform("few_shot", lambda x: F.struct(
            *[x[c].alias(c) for c in ("ord", "user", "assistant", "images")])))
    return sets


def with_messages(sets: DataFrame, typed: bool) -> DataFrame:
    """Build each set's few-shot messages once, on the (small) set frame, so
    the per-item work after the join is a concatenation (invariant hoisting:
    the harness rebuilt them for every item)."""
    from evalframe.functions.chat import few_shot_messages

    return sets.withColumn("few_shot_messages", few_shot_messages("few_shot", typed))


def with_messages_json(sets: DataFrame, typed: bool) -> DataFrame:
    """``with_messages`` as JSON text: no row builds or writes the messages
    that it shares with all others of its set."""
    from evalframe.functions.chat import few_shot_messages

    return sets.withColumn(MESSAGES_JSON, F.to_json(few_shot_messages("few_shot", typed), {"ignoreNullFields": "false"}))


def attach_few_shot(items: DataFrame, sets: DataFrame, keys: Sequence[str], salts: int = 1) -> DataFrame:
    """Attach each item's few-shot list (J3); items without one get ``[]``.

    A plain left join whatever the sizes: AQE broadcasts the set side if its
    measured size allows, else both sides are shuffled on the keys.  With few
    keys shared by all items, ``salts`` deals the items of a key over that
    many partitions (each set is repeated that often, so use it only where the
    sets are few).
    """
    on = list(keys)
    if salts > 1:
        salt = unused_name("_salt", [*items.columns, *sets.columns])
        items = items.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        sets = sets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = items.join(sets, [*on, salt], "left").drop(salt)
    else:
        joined = items.join(sets, on, "left")
    return _filled(joined, sets)


def deal_with_few_shot(items: DataFrame, sets: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """``attach_few_shot`` in ``tasks`` partitions of about equal numbers of
    items.

    The items are dealt before they have their examples, which are far wider
    and never shuffled once an item.  Sets that are measured small are
    broadcast to items dealt round-robin.  Larger ones are joined by key: the
    shuffle that deals the items is the join's, and the items of a key that is
    heavy (``skew.heavy_keys``) or null are dealt over salts, the set of a
    heavy key repeated for each of them.
    """
    spark, on = items.sparkSession, list(keys)
    path = scratch_dir(spark, "few-shot-sets")
    sets.write.mode("overwrite").parquet(path)   # measured and joined from one computation
    sets = spark.read.schema(sets.schema).parquet(path)
    size = sets.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sets.columns])))).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        return _filled(items.repartition(tasks).join(F.broadcast(sets), on, "left"), sets)
    types = {df: [df.schema[c].dataType.simpleString() for c in on] for df in (items, sets)}
    if types[items] != types[sets] or {"float", "double"} & set(types[items]):   # equal keys may have unequal hashes
        return attach_few_shot(items, sets, on).repartition(tasks)
    key, salt, salts = (unused_name(n, [*items.columns, *sets.columns]) for n in ("_key", "_salt", "_salts"))
    # the hash stands for the keys: a light key that shares one with a heavy key is salted as well, on both sides
    hashed = F.when(F.greatest(*[F.col(f"`{c}`").isNull().cast("int") for c in on], F.lit(0)) == 0, F.xxhash64(*[F.col(f"`{c}`") for c in on]))
    # read once: both sides must have the same salts of a key (at most 2 / share rows)
    heavy = F.broadcast(spark.createDataFrame(heavy_keys(items.select(hashed.alias(key)), key, tasks).collect(), f"{key} long, {salts} int"))
    whole = [F.col(f"`{f.name}`") for f in items.schema.fields if "map<" not in f.dataType.simpleString()]
    unmatched = F.when(F.col(key).isNull(), F.lit(8 * tasks)).otherwise(F.coalesce(F.col(salts), F.lit(1)))
    # a row's salt depends on the row alone: a task that runs again deals it alike
    dealt = items.withColumn(key, hashed).join(heavy, key, "left").withColumn(salt, F.pmod(F.xxhash64(*whole), unmatched).cast("int")).drop(key, salts)
    repeated = sets.withColumn(key, hashed).join(heavy, key, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(key, salts)
    return _filled(dealt.repartition(tasks, *[F.col(f"`{c}`") for c in (*on, salt)]).join(repeated, [*on, salt], "left").drop(salt), sets)


def _filled(joined: DataFrame, sets: DataFrame) -> DataFrame:
    """Empty lists for items without a set."""
    filled = {"few_shot": F.coalesce(F.col("few_shot"), F.array().cast(FEW_SHOT_TYPE))}
    if "few_shot_messages" in sets.columns:
        msg_type = sets.schema["few_shot_messages"].dataType.simpleString()
        filled["few_shot_messages"] = F.coalesce(F.col("few_shot_messages"), F.array().cast(msg_type))
    if MESSAGES_JSON in sets.columns:
        filled[MESSAGES_JSON] = F.coalesce(F.col(MESSAGES_JSON), F.lit("[]"))
    return joined.withColumns(filled)
