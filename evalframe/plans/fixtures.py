"""Evaluation inputs derived from the driver's tables.

The evaluated harness reads its benchmark from external files that are not
available here, so every plan reads the driver tables and derives items,
recorded responses, votes, few-shot pairs and conversations from them with
plain column expressions.  Each derivation has a DuckDB twin in
``plans.oracles`` so the two engines can be compared on the same rows.

All derivations are map-side projections except ``messages`` (one group per
conversation: a chat prompt is one value per conversation) and
``few_shot_pairs`` (an equi-join on the next turn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.constants import RANDOM_SUB_SUBTASK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# free-text responses
# ---------------------------------------------------------------------------

def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn and every document as a response text."""
    conv = table(spark, sf_dir, "conversations").select(
        F.lit("conv").alias("src"), F.col("conv_id").alias("k1"), F.col("turn").alias("k2"), "text")
    docs = table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), "text")
    return conv.unionByName(docs)


# ---------------------------------------------------------------------------
# choice items (selection / multiple choice) from `part`
# ---------------------------------------------------------------------------

def _choice_k(m: Column) -> Column:
    return F.when(m == 4, F.lit(3)).otherwise(m + 2)


def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One choice item per part: sub_subtask, k choices, gold id, choice list."""
    p = table(spark, sf_dir, "part")
    id_ = F.col("p_partkey")
    m = (id_ % 5).cast("int")
    k = _choice_k(m)
    is_random = m == 4
    gold = F.when(is_random & (id_ % 3 == 0), F.lit(-1)).otherwise(((id_ % 7) % k).cast("int"))
    words = F.split(F.concat_ws(" ", F.lower("p_type"), "p_name", F.lower("p_brand")), " ")
    items = p.select(
        id_.alias("id"),
        F.col("p_name").alias("object"),
        F.when(is_random, F.lit(RANDOM_SUB_SUBTASK))
         .otherwise(F.concat(F.lit("choice"), (m + 2).cast("string"), F.lit("_ans1"))).alias("sub_subtask"),
        k.alias("k"),
        gold.alias("gold_id"),
        words.alias("_words"),
    )
    return items.select(
        "id", "object", "sub_subtask", "k",
        F.when(F.col("gold_id") == -1, F.array().cast("array<int>"))
         .otherwise(F.array(F.col("gold_id"))).alias("correct_ids"),
        F.transform(
            F.sequence(F.lit(0), F.col("k") - 1),
            lambda i: F.concat(i.cast("string"), F.lit(":"), F.coalesce(F.get(F.col("_words"), i), F.lit("none"))),
        ).alias("all_ids_with_term"),
    )


def choice_response_text(id_: Column, k: Column) -> Column:
    """Recorded model answer for a choice item, in a dozen surface forms."""
    c = F.when(id_ % 4 == 0, (id_ % 3) % k).otherwise((id_ % 7) % k).cast("string")
    r = id_ % 12
    return (
        F.when(r == 0, F.concat(F.lit("("), c, F.lit(") because")))
        .when(r == 1, F.concat(c, F.lit(".")))
        .when(r == 2, F.concat(F.lit("\n "), c))
        .when(r == 3, F.concat(F.lit("\u3000"), c))
        .when(r == 4, F.concat(F.lit("Answer: "), c))
        .when(r == 5, F.lit("yes"))
        .when(r == 6, F.concat(F.lit("I think "), c))
        .when(r == 7, F.lit("-1"))
        .otherwise(c)
    )


def choice_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = choice_items(spark, sf_dir)
    return items.withColumn("recorded_response", choice_response_text(F.col("id"), F.col("k")))


# ---------------------------------------------------------------------------
# pair rating with human votes, from `lineitem` (votes) and `orders` (items)
# ---------------------------------------------------------------------------

def votes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote per lineitem: item = order key, vote in 1..5."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("item"),
        ((F.floor("l_quantity").cast("long") % 5) + 1).cast("int").alias("vote"),
    )


def pair_rating_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One (object, term) pair per order, with its recorded answer."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pred_text = (key % 7).cast("string")
    r = key % 3
    return o.select(
        key.alias("id"),
        F.col("o_orderpriority").alias("object"),
        F.lower(F.col("o_orderstatus")).alias("term"),
        F.when(r == 0, F.concat(pred_text, F.lit(". natural")))
         .when(r == 1, F.concat(F.lit("("), pred_text, F.lit(")")))
         .otherwise(pred_text).alias("recorded_response"),
    )


def vote_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row vote arrays that exist without any grouping: one vote per
    embedding component (``floor(|x| * 5) % 5 + 1``)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("item"),
        F.transform("embedding", lambda x: ((F.floor(F.abs(x.cast("double")) * 5).cast("long") % 5) + 1).cast("int")).alias("votes"),
        ((F.col("label").cast("long") % 5) + 1).cast("int").alias("gold"),
        (F.col("vec_id") % 7).cast("int").alias("pred"),
    )


# ---------------------------------------------------------------------------
# two-way classification from `labels`
# ---------------------------------------------------------------------------

def yes_no_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return lb.select(
        d.alias("id"),
        F.col("quality").cast("int").alias("label"),
        F.when(d % 9 == 0, F.lit("1")).when(d % 4 == 0, F.lit("no")).otherwise(F.lit("yes")).alias("recorded_response"),
    )


def a_b_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    r = d % 6
    return lb.select(
        d.alias("id"),
        F.array(F.col("toxic").cast("int")).alias("correct_ids"),
        F.when(r == 0, F.lit("A")).when(r == 1, F.lit("B.")).when(r == 2, F.lit("(A)"))
         .when(r == 3, F.lit("B: because")).when(r == 4, F.lit("yes")).otherwise(F.lit(" 1")).alias("recorded_response"),
    )


# ---------------------------------------------------------------------------
# conversations: messages and few-shot pairs
# ---------------------------------------------------------------------------

def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with its ordered messages.

    ``collect_list`` order is not guaranteed, so the turn number is carried in
    the struct and the array is sorted by it.  One group is one conversation.
    """
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def few_shot_id(spark: SparkSession, sf_dir: str, id_: Column) -> Column:
    """The conversation whose turns are an item's few-shot examples: items are
    dealt over all conversations."""
    last = table(spark, sf_dir, "conversations").agg(F.max("conv_id").alias("m")).first()["m"]
    return F.pmod(id_, F.lit((last or 0) + 1))


def few_shot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn answered by the next (assistant) turn is one example.

    ``turn`` is the message's position in its conversation (0, 1, 2, ...), so
    "the next turn" is an equi-join on ``(conv_id, turn + 1)``.  Its key is
    unique per row, so a conversation holding a large share of all turns
    spreads over many tasks instead of one window partition.
    """
    c = table(spark, sf_dir, "conversations")
    users = c.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("next_turn"), F.col("turn").alias("ord"), F.col("text").alias("user"))
    answers = c.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("assistant"))
    return users.join(answers, ["conv_id", "next_turn"]).select(
        F.col("conv_id").alias("fs_id"), "ord", "user", "assistant",
        F.lit(None).cast("array<string>").alias("images"))


# ---------------------------------------------------------------------------
# assets and placeholders
# ---------------------------------------------------------------------------

def asset_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pg = table(spark, sf_dir, "pages")
    return pg.select(
        F.col("page_id").alias("id"),
        F.col("url"),
        F.concat(F.lit("images/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("rel_path"),
    )


def asset_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pg = table(spark, sf_dir, "pages")
    return pg.select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))


def placeholder_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``doc_id % 3`` trailing ``<image>`` tokens and
    ``doc_id % 4`` images (``doc_id % 5 = 0`` gives no image list at all)."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    names = F.transform(F.sequence(F.lit(1), F.lit(3)),
                        lambda j: F.concat(F.lit("img/"), i.cast("string"), F.lit("_"), j.cast("string")))
    return d.select(
        i.alias("id"),
        F.concat(F.col("text"), F.repeat(F.lit("<image>"), (i % 3).cast("int"))).alias("text"),
        F.when(i % 5 == 0, F.lit(None).cast("array<string>")).otherwise(F.slice(names, 1, (i % 4).cast("int"))).alias("images"),
    )


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.split(F.col("text"), " ").alias("tokens"))
