"""Response parsing (G1-G9): documented examples, the edge table, and a
property test against Python's own strip + regex."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalframe.functions import parsing as P

PY_RX = re.compile(r"\({0,1}(-1|[0-5]|[A-B]|yes|no)[.,:;)]{0,1}")


def py_extract(s: str) -> str:
    m = PY_RX.match(s.strip())
    return m.group(1) if m else "-100"


EDGE = [
    ("(1) Some answer", "1"), ("Invalid", "-100"), ("(1) x", "1"), ("yes", "yes"), ("Yes", "-100"),
    ("no idea", "no"), ("not", "no"), ("Answer: A", "A"), ("Bag", "B"), ("B:x", "B"), ("(-1)", "-1"),
    ("-2", "-100"), ("-100", "-1"), ("7", "-100"), ("12", "1"), ("5.5", "5"), ("((1)", "-100"), ("( 1", "-100"),
    ("", "-100"), ("C", "-100"), ("\n\n3\n", "3"), ("\u30001\u3000", "1"), ("\x1c2", "2"), ("\x852", "2"),
    ("\u200b2", "-100"), ("\ufeff1", "-100"), ("\uff11", "-100"), ("1\uff09", "1"),
]


def _eval(spark, rows, expr, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_extract_edge_table(spark):
    got = _eval(spark, [(s,) for s, _ in EDGE], P.extract_choice("t"))
    assert got == [e for _, e in EDGE]
    assert [py_extract(s) for s, _ in EDGE] == [e for _, e in EDGE]


def test_strip_matches_python(spark):
    samples = [" a ", "\u3000x\u3000", "\t\n y \x0b", "\u2003z\u205f", "\u200bkeep\u200b", "", "\xa0 \x85"]
    got = _eval(spark, [(s,) for s in samples], P.strip_text("t"))
    assert got == [s.strip() for s in samples]


_ALPHABET = st.sampled_from(list(" \t\n\u3000\xa0\x85\u200b()-.,:;)012345679ABCyesnoxY\uff11"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=_ALPHABET, max_size=8), min_size=1, max_size=20))
def test_extract_property(spark, texts):
    got = _eval(spark, [(s,) for s in texts], P.extract_choice("t"))
    assert got == [py_extract(s) for s in texts]


def test_codes(spark):
    labels = ["A", "B", "-100", "yes", "no", "1", "-1"]
    df = spark.createDataFrame([(x,) for x in labels], "p string")
    rows = df.select(P.code_a_b("p"), P.code_yes_no("p"), P.code_selection("p")).collect()
    assert [r[0] for r in rows] == [0, 1, -100, -100, -100, -100, -100]
    assert [r[1] for r in rows] == [-100, -100, -100, 1, 0, -100, -100]
    assert [r[2] for r in rows] == [-100, -100, -100, -100, -100, 1, -1]


def test_strict_codes_raise(spark):
    df = spark.createDataFrame([("yes",)], "p string")
    with pytest.raises(Exception):
        df.select(P.code_a_b("p", strict=True)).collect()
    with pytest.raises(Exception):
        df.select(P.code_int("p", strict=True)).collect()


def test_gold(spark):
    df = spark.createDataFrame([([2, 0],), ([],)], "c array<int>")
    assert [r[0] for r in df.select(P.gold_or_none("c")).collect()] == [2, -1]
    assert df.limit(1).select(P.gold_first("c")).collect()[0][0] == 2
    with pytest.raises(Exception):
        df.where(F.size("c") == 0).select(P.gold_first("c")).collect()
