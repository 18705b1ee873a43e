"""Spelling variants: the index and its searches against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evalframe.llm import queries
from evalframe.llm import spelling_variants as V
from tests.conftest import SF_SMALL


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def all_near(words: list[str]) -> dict[str, set[str]]:
    """Words that agree when a code point is left out of each or of one."""
    near: dict[str, set[str]] = {w: set() for w in words}
    by_rest: dict[str, set[str]] = {}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_rest.setdefault(rest, set()).add(w)
    for met in by_rest.values():
        for a in met:
            near[a] |= {b for b in met if one_edit(a, b)}
    return near


def plain(docs: list[tuple], least: int = 3, every: int = 97) -> list[tuple]:
    counts: Counter[str] = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    near = all_near(list(n))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def as_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(40))
def test_searches_find_all_words_one_edit_apart(seed):
    rng = random.Random(seed)
    letters = "abcé" if seed % 2 else "ab"
    words = sorted({"".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(rng.randint(1, 150))})
    indexed, asked = [w for w in words if rng.random() < 0.8] or words[:1], [w for w in words if rng.random() < 0.7] or words[:1]
    index = V.BidirectionalIndex(indexed, letters)
    found = []
    for by_first in (True, False):
        query, word = V.near_pairs(index, indexed, asked, by_first)
        found += [(asked[q], indexed[w]) for q, w in zip(query, word)]
    near = all_near(words)
    assert len(found) == len(set(found)) and set(found) == {(q, w) for q in asked for w in near[q] if w in set(indexed)}


def test_intervals_of_both_directions():
    """Extending at random, to both sides, keeps the number of occurrences and
    both intervals of the index."""
    words, rng = sorted(["banana", "bandana", "cabana", "ababab", "nab", "bananas"]), random.Random(3)
    letters = "abcdns"
    index = V.BidirectionalIndex(words, letters)
    text = "$" + "$".join(words) + "$"
    reverse = "$" + "$".join(sorted(w[::-1] for w in words)) + "$"
    rank = lambda t: sorted(range(len(t)), key=lambda i: (t[i:].split("$")[0] + "$", t[:i].count("$"), i) if t[i] != "$" else ("", t[:i].count("$"), i))
    orders = [[t[i:] for i in rank(t)] for t in (text, reverse)]
    for _ in range(400):
        pattern, states = "", index.start(1)
        while len(states.query) and len(pattern) < 8:
            right = rng.random() < 0.5
            if not pattern or (pattern[-1] if right else pattern[0]) != "$":
                c = rng.choice(letters if not pattern else letters + "$")
                states = index.extend(states, np.array([(" " + letters).index(c) if c != "$" else 0]), right)
                pattern = pattern + c if right else c + pattern
                n = sum(text.startswith(pattern, i) for i in range(len(text)))
                assert (states.size[0] if len(states.query) else 0) == n
                if n:
                    assert all(s.startswith(pattern) for s in orders[0][states.lo[0]:states.lo[0] + n])
                    assert all(s.startswith(pattern[::-1]) for s in orders[1][states.rev[0]:states.rev[0] + n])
            else:
                break


@pytest.mark.parametrize("block", [V.BLOCK, 25])
def test_op13_rows(spark, small_docs, monkeypatch, block):
    """Also with groups that are cut into many blocks."""
    monkeypatch.setattr(V, "BLOCK", block)
    docs = small_docs if block != 25 else small_docs.head(60)
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    got = as_rows(queries.queries()["op13_spelling"](spark, SF_SMALL) if block != 25 else V.group(frame))
    assert got == plain(list(zip(docs["doc_id"], docs["text"])))


def test_chains_ties_and_slips(spark):
    """Chains of forms over several rounds; equal counts; × and ÷ are letters
    of the range, other letters end a run; A-Z only are lower-cased."""
    words = {"aaaaa": 3, "aaaab": 7, "aaabb": 15, "aabbb": 40, "abbbb": 90, "bbbbb": 200, "bbbbbc": 200, "bbbbbd": 90,
             "×÷ÿÀà": 6, "×÷ÿÀàx": 12, "ÉÉÉÉÉ": 4, "ééééé": 9, "zzzzz": 2, "zzzzzz": 2, "abcde": 5, "abcdf": 9}
    docs = [(i, " ".join([w if i % 2 else w.upper() if w.isascii() else w] * n) + "—Ωmega") for i, (w, n) in enumerate(words.items())]
    for every in (97, 3, 1):
        got = as_rows(V.group(spark.createDataFrame(docs, "doc_id long, text string"), 3, every))
        assert got == plain(docs, 3, every)
    roots = {r[0]: r[2] for r in as_rows(V.group(spark.createDataFrame(docs, "doc_id long, text string"), 3, 10 ** 9))}
    assert roots["aaaaa"] == roots["abbbb"] == "bbbbb"


def test_spelling_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(9, "y" * 3_000 + " " + "y" * 2_999), (9, "y" * 3_000 + " " + "y" * 2_999)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(V.group(more, 1)) == plain(rows, 1)
    assert as_rows(V.group(odd_docs, 1)) == plain(rows[:-2], 1)
    assert as_rows(V.group(no_docs)) == []
