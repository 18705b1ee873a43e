"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` code points, and only the bag
has a label.  A passage is encoded from how it is written (kinds of characters
and of their neighbours, repeated words and pairs of words) by a learned
layer; gated attention, learned from the document labels, weighs the passages;
the weighted sum of their codes is what is scored:

    h = tanh(W x + b)        a = softmax over passages of  u . (tanh(V h) * sigmoid(G h))
    score = sigmoid(c . sum(a h) + d)

So one passage of junk can decide a long document, and clean passages beside it
need not hide it, as far as the labels say so.

Training takes at most ``TRAIN_DOCS`` labelled documents of each class, those
of the smallest hashes of doc_id, and of each at most ``TRAIN_PASSAGES``
passages, those of the smallest hashes of their number, spread over the whole
text; no document is left out for its length.  A document stands for as many
as its class has for each one taken, so a score means the same at every size.
Passages are encoded to numbers in tasks; only those go to the driver, where
the small network is fitted (Adam, fixed seed).  Scoring is a map over all
passages of every text.  Neither labels, lang, source nor doc_id is an input.

Defined results: a null or empty text is one empty passage and has its score;
a very long text is encoded in windows of ``WINDOW`` passages, its passages
weighed together; labels that are null or neither 0 nor 1 are not learned from;
a document labelled twice is learned twice, repeated rows are scored each for
itself, equal texts alike; without labels of both classes all scores are the
share of label 1 (0 without any); an empty table gives no rows; columns of
clashing names are kept or, if the query does not return them, not read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import hashed_sample, schema_with, text_list, unused_name

# Code points of a passage; passages encoded at once.
PASSAGE, WINDOW = 512, 2_048
# Labelled documents of each class, and passages of each, that are learned from.
TRAIN_DOCS, TRAIN_PASSAGES = 1_500, 16
# The network: sizes of the code and of the attention; passes over the sample.
CODE, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 20, 64, 0.01, 1e-3

# Kinds of characters; further characters by their Unicode category.
KINDS = [" ", "\n", ".", ",", ";:", "!?", "\"'`", "-_", "|", "#$%&*@^~+=", "()[]{}<>/\\"]
OTHER_SPACE, LOWER, UPPER, DIGIT, FAR_LOWER, FAR_UPPER, LETTER, MARK = range(len(KINDS), len(KINDS) + 8)
N_KINDS = len(KINDS) + 8
N_SHAPES = 6
N_FEATURES = N_KINDS + N_KINDS * N_KINDS + N_SHAPES


@functools.cache
def _kind_table() -> np.ndarray:
    table = np.full(0x10000, MARK, np.uint8)
    for code in range(0x10000):
        category = unicodedata.category(chr(code))
        if category[0] in "ZC":
            table[code] = OTHER_SPACE
        elif category == "Nd":
            table[code] = DIGIT
        elif category[0] == "L":
            table[code] = {"Ll": LOWER if code < 128 else FAR_LOWER, "Lu": UPPER if code < 128 else FAR_UPPER}.get(category, LETTER)
    for kind, chars in enumerate(KINDS):
        for c in chars:
            table[ord(c)] = kind
    return table


# ------------------------------------------------------------------ passages

def _shares(codes: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Features of ``n`` passages from their code points (``passage``
    increases): shares of kinds and of neighbouring kinds, and word shapes."""
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(codes):
        return out
    kind = _kind_table()[np.where(codes < 0x10000, codes, 0xFFFD)].astype(np.int64)
    size = np.bincount(passage, minlength=n)[:, None].clip(1)
    out[:, :N_KINDS] = np.sqrt(np.bincount(passage * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, -1) / size)
    beside = passage[1:] == passage[:-1]
    pair = passage[:-1] * N_KINDS ** 2 + kind[:-1] * N_KINDS + kind[1:]
    out[:, N_KINDS:-N_SHAPES] = np.sqrt(np.bincount(pair[beside], minlength=n * N_KINDS ** 2).reshape(n, -1) / size)
    # words: runs between white space, known by a hash of their code points
    in_word = (kind > 1) & (kind != OTHER_SPACE)
    starts = np.flatnonzero(in_word & ~np.append(False, in_word[:-1] & beside))
    if not len(starts):
        return out
    word = np.cumsum(np.bincount(starts, minlength=len(codes))) - 1
    held = np.flatnonzero(in_word)
    place = held - starts[word[held]]
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(PASSAGE, 0x9E3779B97F4A7C15, np.uint64)))
    with np.errstate(over="ignore"):
        hashed = np.add.reduceat((codes[held].astype(np.uint64) + np.uint64(7)) * powers[place], np.flatnonzero(place == 0))
        pairs = hashed[1:] * np.uint64(31) + hashed[:-1]
    owner, length = passage[starts], np.bincount(word[held], minlength=len(starts))
    words = np.bincount(owner, minlength=n)
    total = words.clip(1)
    same = owner[1:] == owner[:-1]

    def distinct(of: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        o, v = of[order], values[order]
        new = np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1]))
        return np.bincount(o[new], minlength=n)

    share = lambda x, by: np.bincount(x, minlength=n) / by
    mean = np.bincount(owner, length, n) / total
    out[:, -6] = share(owner[1:][same & (hashed[1:] == hashed[:-1])], total)
    out[:, -5] = distinct(owner, hashed) / total
    if same.any():
        out[:, -4] = distinct(owner[1:][same], pairs[same]) / np.bincount(owner[1:][same], minlength=n).clip(1)
    out[:, -3] = np.log1p(mean)
    out[:, -2] = np.log1p(np.sqrt(np.maximum(0, np.bincount(owner, length.astype(float) ** 2, n) / total - mean ** 2)))
    out[:, -1] = np.log1p(words)
    return out


def encoded(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text number of each passage, features), some passages at a time."""
    pieces: list[tuple[int, str]] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for _, p in pieces])
        counts = np.maximum(1, -(-sizes // PASSAGE))
        first = np.append(0, np.cumsum(counts))
        codes = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = np.repeat(first[:-1], sizes) + within // PASSAGE
        return np.repeat([i for i, _ in pieces], counts), _shares(codes, passage, int(first[-1]))

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PASSAGE * WINDOW):
            piece = text[at:at + PASSAGE * WINDOW]
            if pieces and held + len(piece) > PASSAGE * WINDOW:
                yield flush()
                pieces, held = [], 0
            pieces.append((i, piece))
            held += len(piece)
    if pieces:
        yield flush()


# ------------------------------------------------------------------- network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _softmax_of_bags(logit: np.ndarray, begin: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(logit - np.maximum.reduceat(logit, begin)[bag])
    return e / np.add.reduceat(e, begin)[bag]


@dataclass(frozen=True)
class QualityModel:
    """``parts``: W, b, V, G, u, c, d; ``mean`` and ``scale`` of the features;
    a constant logit without labels of both classes."""

    parts: tuple[np.ndarray, ...]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def codes(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and attention logit of each passage."""
        w, b, v, g, u, _, _ = self.parts
        h = np.tanh((features - self.mean) / self.scale @ w + b)
        return h, (np.tanh(h @ v) * _sigmoid(h @ g)) @ u

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), _sigmoid(np.float64(self.constant or 0.0)))
        owners, codes, logits = [], [], []
        for owner, features in encoded(texts):
            h, logit = self.codes(features)
            owners.append(owner), codes.append(h), logits.append(logit)
        owner, h, logit = np.concatenate(owners), np.concatenate(codes), np.concatenate(logits)
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        a = _softmax_of_bags(logit, begin, owner)
        z = np.add.reduceat(h * a[:, None], begin)
        return _sigmoid(z @ self.parts[5] + self.parts[6])


def loss_and_slopes(parts: tuple[np.ndarray, ...], x: np.ndarray, begin: np.ndarray, bag: np.ndarray, y: np.ndarray,
                    weight: np.ndarray) -> tuple[float, tuple[np.ndarray, ...]]:
    """Weighted log loss of bags of standardised passages ``x`` (bag i begins
    at ``begin[i]``) and its derivatives."""
    w, b, v, g, u, c, d = parts
    h = np.tanh(x @ w + b)
    t, s = np.tanh(h @ v), _sigmoid(h @ g)
    a = _softmax_of_bags((t * s) @ u, begin, bag)
    z = np.add.reduceat(h * a[:, None], begin)
    p = _sigmoid(z @ c + d)
    loss = -float(np.sum(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))))
    of_logit = weight * (p - y)
    of_z = of_logit[:, None] * c
    of_a = np.sum(of_z[bag] * h, axis=1)
    of_e = a * (of_a - np.add.reduceat(a * of_a, begin)[bag])
    of_t, of_s = of_e[:, None] * s * u * (1 - t * t), of_e[:, None] * t * u * s * (1 - s)
    of_h = (a[:, None] * of_z[bag] + of_t @ v.T + of_s @ g.T) * (1 - h * h)
    return loss, (x.T @ of_h, of_h.sum(0), h.T @ of_t, h.T @ of_s, (t * s).T @ of_e, z.T @ of_logit, of_logit.sum())


def fit(bags: list[np.ndarray], labels: list[int], stands_for: dict[int, float] | None = None) -> QualityModel:
    """``bags``: the features of each document's passages."""
    y = np.array(labels, float)
    weight = np.array([(stands_for or {}).get(label, 1.0) for label in labels], float)
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
    if not 0 < share < 1:
        return QualityModel((), np.zeros(N_FEATURES), np.ones(N_FEATURES), 30.0 if share else -30.0)
    weight /= weight.mean()
    x = np.concatenate(bags)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    x = (x - mean) / scale
    sizes = np.array([len(b) for b in bags])
    ends = np.cumsum(sizes)
    rng = np.random.default_rng(0)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    parts = (draw(N_FEATURES, CODE), np.zeros(CODE, np.float32), draw(CODE, GATE), draw(CODE, GATE), draw(GATE), draw(CODE),
             np.float32(np.log(share / (1 - share))))
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            rows = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in pick])
            begin = np.append(0, np.cumsum(sizes[pick]))[:-1]
            _, slopes = loss_and_slopes(parts, x[rows], begin, np.repeat(np.arange(len(pick)), sizes[pick]), y[pick], weight[pick] / len(pick))
            step += 1
            moved = []
            for i, (p, s) in enumerate(zip(parts, slopes)):
                first[i] = 0.9 * first[i] + 0.1 * s
                second[i] = 0.999 * second[i] + 0.001 * s * s
                change = first[i] / (1 - 0.9 ** step) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
                moved.append(p - rate * (change + (DECAY * p if p.ndim == 2 else 0)))
            parts = tuple(moved)
    return QualityModel(parts, mean, scale)


# ------------------------------------------------------------------ on Spark

def _sampled_passages(text: str) -> np.ndarray:
    """Features of at most ``TRAIN_PASSAGES`` passages, of the smallest hashes
    of their numbers."""
    n = max(1, -(-len(text) // PASSAGE))
    number = np.arange(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    taken = np.sort(np.argsort(mixed ^ (mixed >> np.uint64(32)), kind="stable")[:TRAIN_PASSAGES])
    return np.concatenate([f for i in taken.tolist() for _, f in encoded([text[i * PASSAGE:(i + 1) * PASSAGE]])])


def train(docs: DataFrame, labels: DataFrame, usable: Callable[[F.Column], F.Column] | None = None) -> QualityModel:
    """``usable``: a condition on ``doc_id`` of the labels to learn from."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    if usable is not None:
        known = known.where(usable(F.col("_id")))
    known = known.distinct()
    total = dict(known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect())
    drawn = [hashed_sample(known.where(F.col("_y") == y), TRAIN_DOCS, total.get(y, 0), "_id") for y in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [_sampled_passages(t).astype(np.float16).tobytes() for t in text_list(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("doc_id") == F.col("_id"))
            .select("_id", "_y", "text").mapInArrow(run, "id long, y int, bag binary").distinct()
            # documents of one id are few; the bound holds whatever the table
            .orderBy(F.xxhash64("id"), "id", "y", "bag").limit(2 * TRAIN_DOCS).collect())
    rows.sort(key=lambda r: (r["id"], r["y"], r["bag"]))
    taken = {y: sum(r["y"] == y for r in rows) for y in (0, 1)}
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in rows]
    return fit(bags, [r["y"] for r in rows], {y: total[y] / taken[y] for y in (0, 1) if taken[y]})


def with_score(docs: DataFrame, model: QualityModel, column: str) -> DataFrame:
    """All rows and columns of ``docs`` and the score of ``text``: a map, no
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(text_list(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, column])

    at = docs.columns.index("text")
    return docs.mapInArrow(run, schema_with(docs, **{column: "double"}))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``; labels of documents
    whose crc32(doc_id as text) is divisible by ``folds`` are not learned from."""
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    model = train(docs, labels, lambda c: fold(c) != 0)
    out = with_score(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """The rows whose text is predicted to be of good quality."""
    score = unused_name("_score", docs.columns)
    return with_score(docs, model, score).where(F.col(score) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
