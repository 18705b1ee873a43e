"""Covering SimHash and fraction sketches: against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash

from evalframe.llm import fraction_sketch as K
from evalframe.llm import queries
from evalframe.llm import simhash_covering as S
from tests.conftest import SF_SMALL

MASK = (1 << 64) - 1


def plain_fingerprint(text: str | None, k: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_roots(fps: list[int], radius: int = 4) -> list[int]:
    """For each fingerprint the place of the first one of its component."""
    values = np.array(fps, dtype=np.uint64)
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("family", [0, 1])
def test_masks_cover_every_pair_within_the_radius(family):
    masks = [m & MASK for m in S.covering_masks(4, family)]
    assert len(masks) == 31
    rng = np.random.default_rng(5)
    for _ in range(3000):
        x = int(rng.integers(0, 1 << 62))
        y = x
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("bucket", [4096, 6, 2])
def test_components_of_chains(spark, bucket):
    """Chains and clouds of fingerprints; small buckets go through the second
    family and the chunks."""
    rng = np.random.default_rng(1)
    fps = {0, 1}
    for base in rng.integers(0, 1 << 62, 12).tolist():
        x = base
        for _ in range(25):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
            x = y if rng.random() < 0.5 else x
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = plain_roots([s & MASK for s in signed])
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["fp"]: r["root"] for r in S.roots(distinct, 4, bucket).collect()}
    assert got == {s: signed[w] for s, w in zip(signed, want)}


def test_connected_long_path(spark):
    """A path of 300 nodes in random order: rounds, not steps."""
    names = np.random.default_rng(2).permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    assert {(r["node"], r["root"]) for r in S.connected(edges).collect()} == {(n, 0) for n in names}


def test_op5_rows(spark, small_docs):
    got = {r["doc_id"]: r for r in queries.op5_simhash(spark, SF_SMALL).collect()}
    fps = [plain_fingerprint(t) for t in small_docs.text]
    ids = small_docs.doc_id.tolist()
    for i, f, root in zip(ids, fps, plain_roots(fps)):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", ids[root])


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    rows = S.components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {("0" * 16, 2)}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert S.components(no_docs).count() == 0


def test_keep_one(spark, odd_docs, no_docs):
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    texts = [(r["doc_id"], (r["text"] or "")[:20]) for r in rows]
    assert len(texts) == len(set(texts)) == 8   # 2, 3 and 4 are one group, as are equal rows
    assert {r["doc_id"] for r in rows} == {1, 2, 5, None, 6, 7, 8} and sum(r["doc_id"] == 5 for r in rows) == 2
    assert S.keep_one(no_docs).count() == 0


# ----------------------------------------------------------------- sketches

def test_op4_rows(spark, small_docs):
    docs = small_docs.sort_values("doc_id", ascending=False)
    texts, got = list(docs.text), {r["doc_id"]: r for r in queries.op4_fraction_sketch(spark, SF_SMALL).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(zip(docs.doc_id, texts)):
        n, following = len(t), texts[(k + 1) % len(texts)]
        edited = t[: n - n // 3] + following[: n // 3]
        own, changed, other = K.sketch(t), K.sketch(edited), K.sketch(following)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (K.written(own), K.written(changed))
        assert (r["near_edited"], r["near_next"]) == (K.likeness(own, changed), K.likeness(own, other))


def test_sketch_odd_rows(spark, odd_docs, no_docs):
    rows = K.fingerprints(odd_docs).collect()
    assert sorted(((r["doc_id"] or -1, r["n_chars"]) for r in rows)) == sorted(
        ((r["doc_id"] or -1, len(r["text"] or "")) for r in odd_docs.collect()))
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 4)} == {""}
    assert K.fingerprints(no_docs).count() == 0
    one = K.fingerprints(odd_docs.where("doc_id = 1")).collect()   # its own next document
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_sketches_keep_a_fraction_and_merge():
    rng = np.random.default_rng(0)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 50_000, 8000)) for _ in range(2))
    s = K.sketch(a)
    assert abs(len(s) / 8000 - 1 / K.SCALE) < 0.02 and (s < (1 << 64) // K.SCALE).all()
    both = K.merged(s, K.sketch(b))
    assert set(s) <= set(both)
    part = " ".join(a.split()[:800])   # a tenth of the document
    assert K.containment(K.sketch(part), s) > 0.95 and K.containment(s, K.sketch(part)) < 0.2
    assert len(K.sketch("one")) == 1 and len(K.sketch("")) == 0
