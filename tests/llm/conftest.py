from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalframe.llm.common import prepare
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def _prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def small_docs() -> pd.DataFrame:
    return pd.read_parquet(f"{SF_SMALL}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and further
    columns named like an operator's own."""
    long_text = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, " \t\n ", "en", "a", 4), (5, long_text, "en", "a", len(long_text)), (5, long_text, "en", "a", len(long_text)),
            (None, "a text without an id, twice", "en", None, 27), (None, "a text without an id, twice", "en", None, 27),
            (6, "1234 !!! ---", "de", "b", 12), (7, "größer als über den Fluß", "de", "b", 24),
            (5, "another text of the same id", "en", "a", 27), (8, "漢字 😀 emoji \x00 <s> ▁", "fr", "b", 20)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("fp", "_fp", "_score", "_lang", "root", "shard", "length", "task", "score", "ids", "n_tokens")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
