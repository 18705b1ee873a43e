"""Attention-based quality: derivatives, the plain formula, held-out labels."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalframe.llm import mil_quality as Q
from evalframe.llm import queries
from tests.conftest import SF_MID


def random_parts(rng: np.random.Generator, n: int = 9, code: int = 5, gate: int = 3) -> tuple[np.ndarray, ...]:
    draw = lambda *s: rng.normal(0, 0.7, s)
    return draw(n, code), draw(code), draw(code, gate), draw(code, gate), draw(gate), draw(code), np.float64(0.3)


def test_slopes_equal_differences():
    rng = np.random.default_rng(0)
    parts, sizes = random_parts(rng), np.array([1, 4, 2, 3])
    x, y, weight = rng.normal(size=(10, 9)), np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 0.5, 3])
    begin, bag = np.append(0, np.cumsum(sizes))[:-1], np.repeat(np.arange(4), sizes)
    _, slopes = Q.loss_and_slopes(parts, x, begin, bag, y, weight)
    for i, part in enumerate(parts):
        flat = np.atleast_1d(part)
        for at in np.ndindex(flat.shape):
            near = []
            for step in (1e-5, -1e-5):
                moved = flat.copy()
                moved[at] += step
                changed = [*parts[:i], moved.reshape(np.shape(part)), *parts[i + 1:]]
                near.append(Q.loss_and_slopes(tuple(changed), x, begin, bag, y, weight)[0])
            assert np.atleast_1d(slopes[i])[at] == pytest.approx((near[0] - near[1]) / 2e-5, rel=1e-4, abs=1e-7)


def plain_score(model: Q.QualityModel, text: str) -> float:
    """One passage after the other, by the formula."""
    w, b, v, g, u, c, d = (np.asarray(p, float) for p in model.parts)
    codes, logits = [], []
    for at in range(0, max(1, len(text)), Q.PASSAGE):
        passage = text[at:at + Q.PASSAGE]
        x = Q._shares(np.array([ord(ch) for ch in passage], np.uint32), np.zeros(len(passage), int), 1)[0]
        h = np.tanh((x - model.mean) / model.scale @ w + b)
        codes.append(h)
        logits.append(float(np.tanh(h @ v) * (1 / (1 + np.exp(-(h @ g)))) @ u))
    a = np.exp(np.array(logits) - max(logits))
    z = (np.array(codes) * (a / a.sum())[:, None]).sum(0)
    return float(1 / (1 + np.exp(-(z @ c + d))))


def test_scores_equal_the_formula(small_docs, monkeypatch):
    model = Q.QualityModel(random_parts(np.random.default_rng(2), Q.N_FEATURES), np.full(Q.N_FEATURES, 0.1), np.full(Q.N_FEATURES, 0.3))
    texts = [*(t or "" for t in small_docs["text"].head(60)), "", " \n\t ", "x" * 5_000, "ab ß😀 " * 900, "no"]
    want = [plain_score(model, t) for t in texts]
    assert model.scores(texts) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(Q, "WINDOW", 2)  # texts and batches in many windows
    assert model.scores(texts) == pytest.approx(want, abs=1e-5)


def test_passage_features_by_hand():
    shares = Q._shares(np.array([ord(c) for c in "ab ab, ab"], np.uint32), np.zeros(9, int), 1)[0]
    assert shares[Q.LOWER] == pytest.approx((6 / 9) ** 0.5) and shares[Q.KINDS.index(",")] == pytest.approx((1 / 9) ** 0.5)
    repeated, distinct, distinct_pairs, mean, _, total = shares[-Q.N_SHAPES:]
    assert repeated == 0 and distinct == pytest.approx(2 / 3) and distinct_pairs == 1
    assert mean == pytest.approx(np.log1p(7 / 3)) and total == pytest.approx(np.log1p(3))
    assert Q._shares(np.array([ord(c) for c in "no no no no"], np.uint32), np.zeros(11, int), 1)[0][-Q.N_SHAPES] == pytest.approx(3 / 4)


def test_op11_held_out(spark):
    got = queries.queries()["op11_quality"](spark, SF_MID).toPandas()
    docs, labels = (pd.read_parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert all(got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]])
    assert got["score"].between(0, 1).all() and all(got["predicted"] == (got["score"] >= 0.3))
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() >= 0.95


def test_one_junk_passage_of_many_and_long_documents_are_learned(spark):
    """All documents of label 0 are long, and junk only in a part."""
    rng = np.random.default_rng(4)
    words = ["stone", "river", "of", "the", "walked", "slowly", "morning", "a", "light"]
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    rows = []
    for i in range(120):
        text = " ".join(prose(12) for _ in range(60))
        rows.append((i, text if i % 2 else text[:2_000] + " $$$ ### click %%% " * 300 + text[2_000:], i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    out = Q.scored(docs, labels).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "quality"]), on="doc_id")
    assert (out["predicted"] == out["quality"])[out["held_out"]].all()


def test_the_cut_does_not_depend_on_the_sample(spark, monkeypatch):
    docs = [(i, " ".join(["word"] * (i % 7 + 3))) for i in range(400)]
    labels = [(i, int(i % 20 != 0)) for i in range(400)]  # nothing to learn but the share
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    means = []
    for most in (1_500, 20):
        monkeypatch.setattr(Q, "TRAIN_DOCS", most)
        means.append(Q.scored(*frames).agg(F.avg("score")).first()[0])
    assert means[0] == pytest.approx(0.95, abs=0.06) and means[1] == pytest.approx(0.95, abs=0.12)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 1), (7, None), (None, 1), (8, 3)], "doc_id long, quality int")
    out = Q.scored(odd_docs, labels).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert by_id[2] == by_id[3]  # null is empty
    assert Q.scored(no_docs, labels).count() == 0
    none = labels.limit(0)
    assert all(r["score"] < 1e-9 for r in Q.scored(odd_docs, none).collect())
    only = spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in Q.scored(odd_docs, only).collect()} == {1}
    model = Q.train(odd_docs, labels)
    kept = Q.keep_good(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == 12
