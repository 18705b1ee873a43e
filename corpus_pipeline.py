"""Corpus pipeline over ``documents``: language, toxicity, near-duplicates,
packing.  Each stage is one operator of ``evalframe.llm`` over all rows its
predecessor kept; every stage but the last returns the columns of documents.

* language: rejects documents without a letter, those of which no language
  holds ``crf_langid.LEAST_SCORE``, and those whose words are not made as in the
  learned texts of their language (other languages, junk).
* toxicity: rejects documents whose clauses score 0.5 or more; learned from
  the labels of the documents that are left.
* near_duplicates: keeps one document (the smallest doc_id) of each component
  of fingerprints linked at 4 or fewer differing bits, of 4-word shingles.
* packing: sequences of at most 4096 tokens.

Null texts are rejected by the first stage; repeated rows leave one row; texts
of any length are read whole by every stage and cut only by packing, into
pieces of whole sequences; documents may have further columns of any names,
which all stages but the last keep; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalframe.llm import crf_langid, packing, simhash_covering, toxicity_grammar
from evalframe.llm.common import prepare, read_table, saved
from evalframe.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return crf_langid.keep_identified(docs, crf_langid.train(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity_grammar.keep_clean(docs, toxicity_grammar.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_covering.keep_one(docs, radius=4, shingle=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), "word", 1, 4096)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", pack)]

# No stage's rows can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
