"""Importance resampling: against one text after the other."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from evalframe.llm import importance_resampling as R
from evalframe.llm import queries
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None) -> tuple[int, list[int]]:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs: list[tuple], target: list, percent: int = 25, least: int = 20) -> list[tuple]:
    known = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in known for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in known:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is not None, o[0] or 0))
    rank = {id(o): r for r, o in enumerate(able[:percent * len(able) // 100], 1)}
    return [(o[0], o[2], o[3], o[4], rank.get(id(o))) for o in out]


def as_rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


ORDER = lambda r: tuple((x is not None, x or 0) for x in r)


def test_op12_rows(spark, small_docs):
    target = pd.read_parquet(f"{SF_SMALL}/benchmark.parquet")["text"]
    got = as_rows(queries.queries()["op12_resample"](spark, SF_SMALL))
    want = plain(list(zip(small_docs["doc_id"], small_docs["text"])), list(target))
    assert sorted(got, key=ORDER) == sorted(want, key=ORDER)


@pytest.mark.parametrize("hot, counted", [(10_000, 100_000), (3, 2)])
def test_lines_across_documents(spark, monkeypatch, hot, counted):
    """A line in a third of all rows, texts that differ in their line breaks
    only, words across breaks and blank lines; hot lines and small flushes."""
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R, "COUNTED_LINES", counted)
    shared = "Terms of use: all rights reserved by the owner"
    docs = [(i, f"{shared}\nbody {i % 7} of page number {i} and some more words to be read by all who came here\n\n--\r\n{shared if i % 3 else ''}")
            for i in range(90)]
    docs += [(100, "one two\nthree four"), (101, "one two three four"), (102, "one\n\n \n two three\nfour"), (103, "ONE Two! three-four")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = ["all rights reserved", "one two\nthree", None, ""]
    got = as_rows(R.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 30, 5))
    assert sorted(got) == sorted(plain(docs, target, 30, 5), key=lambda r: r[0])
    by_id = {r[0]: r for r in got}
    assert by_id[100][1:3] == by_id[101][1:3] == by_id[102][1:3] == by_id[103][1:3]


def test_resampling_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = as_rows(R.resample(odd_docs, target, 50, 4))
    want = plain(rows, [r["text"] for r in target.collect()], 50, 4)
    assert sorted(got, key=ORDER) == sorted(want, key=ORDER)  # of repeated rows one may be drawn, one not
    empty = target.limit(0)
    assert sorted(as_rows(R.resample(odd_docs, empty, 50, 4)), key=ORDER) == sorted(plain(rows, [], 50, 4), key=ORDER)
    assert as_rows(R.resample(no_docs, target)) == [] and as_rows(R.resample(no_docs, empty)) == []
    assert all(r[4] is None for r in as_rows(R.resample(odd_docs, target, 0, 4)))


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(9, 30, 5), (2, 30, 5), (7, 30, 5), (None, 30, 5), (1, 30, 4), (3, 3, 9), (4, 30, 6)],
                                 "doc_id long, n_words long, score long")
    got = {r["doc_id"]: r["rank"] for r in R.with_rank(rows, 67, 20).collect()}
    assert got == {4: 1, None: 2, 2: 3, 7: 4, 9: None, 1: None, 3: None}
