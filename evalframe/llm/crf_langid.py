"""Language identification by a linear-chain conditional random field.

Every word of a text is a position of the chain and has one label, its
language.  A word's features are its affixes, its character trigrams and its
lexicon entry (the word itself), hashed to weight rows; transitions between
the labels of neighbouring words are weights too.  Forward-backward gives each
word's label probabilities, so a text that switches its language is labelled
word by word; the text's language is the one its words hold most of, and the
score is the share of it.

Training takes ``TRAIN_DOCS`` texts of each language, of at most
``TRAIN_CHARS`` characters, those of the smallest hashes of doc_id.  Their
words are labelled with their text's language; windows of different texts are
joined to chains, so the transitions are learned from text that switches.
Gradients are those of the conditional likelihood (expected against observed
counts by forward-backward), steps are Adam's.

Label shares say only which learned language is nearest.  Whether a text is in
one at all is told by its words' trigrams: a word is familiar as far as one
language's learned texts have them, and what share of familiar text is usual
for a language is measured on texts held out of it (``known``).

Long texts do not make long loops: chains are cut into segments of ``SEGMENT``
words that advance side by side, each as a matrix from the label before it to
the label at its end, and these matrices are chained over the segments.  The
result is exactly that of one pass over the whole text.

Defined results: a text of any length is labelled whole; of languages of equal
mass the first by name is taken; ``und`` with score 0 for a null text or one without a letter;
null languages are not learned from; without any language every text is
``und``; repeated rows are labelled each for itself; an empty table gives no
rows.  lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import hashed_sample_by, schema_with, text_list, unused_name, with_spread_text
from evalframe.llm.word_cache import no_cycle_collection

# Texts of a language, and characters of a text (of longer ones, whole words
# of pieces spread over all of it), that are learned from.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
# Rows of hashed features; words of a training window; windows of a chain.
ROWS, WINDOW, JOINED = 1 << 17, 24, 3
SEGMENT = 64
STEPS, RATE, RIDGE = 30, 0.15, 1e-6
# Words whose label scores a worker keeps before it starts anew.
CACHE_WORDS = 400_000
UNKNOWN = "und"
# Languages of fewer held-out texts have no usual share of familiar text.
LEAST_HELD = 10
# A known text has so much of the usual share, with so many familiar words
# added, as one word says little; and so much but for a line of other text.
OF_USUAL, ADDED, OF_USUAL_LONG, LINE = 0.6, 2, 0.85, 8

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words; none for a text without a letter."""
    words = _WORD.findall(text.lower())
    if not any(map(str.isalpha, words)) and not any(c.isalpha() for c in text):
        return []
    return words or [text.lower()]


def feature_rows(word: str) -> list[int]:
    """Hashed features: the word, its affixes of up to three letters, its
    trigrams with its ends marked."""
    w = f"^{word}$"
    names = {f"w{word}", *(f"p{word[:n]}" for n in (1, 2, 3)), *(f"s{word[-n:]}" for n in (1, 2, 3)),
             *(w[i:i + 3] for i in range(len(w) - 2))}
    return [zlib.crc32(n.encode()) % ROWS for n in names]


# ---------------------------------------------------------- forward-backward

def _normalized(a: np.ndarray) -> np.ndarray:
    return a / a.sum(axis=tuple(range(1, a.ndim)), keepdims=True)


def label_mass(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray,
               segment: int = SEGMENT) -> np.ndarray:
    """For each chain the sum of its words' label probabilities.  ``scores``:
    log potentials of all words, chain after chain; every length is positive."""
    k = scores.shape[1]
    move = np.exp(transition - transition.max()).astype(np.float64)
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    # segments, longest first
    pieces = -(-lengths // segment)
    chain_of = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(chain_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + place * segment
    size = np.minimum(segment, np.repeat(lengths, pieces) - place * segment)
    order = np.argsort(-size, kind="stable")
    begin, size, place, chain_of = begin[order], size[order], place[order], chain_of[order]
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]
    # each segment as a matrix: label before it -> label at its end
    through = np.repeat(np.eye(k)[None], len(size), axis=0)
    first = place == 0
    for t, n in enumerate(active):
        moved = (through[:n].reshape(-1, k) @ move).reshape(n, k, k)
        if t == 0:
            moved[first[:n]] = through[:n][first[:n]]  # nothing is before a chain
        through[:n] = _normalized(moved * potential[begin[:n] + t][:, None, :])
    # chained over the segments of a chain: what comes in from before and from after
    at = np.empty(len(size), dtype=np.int64)
    offset = np.cumsum(pieces) - pieces
    at[offset[chain_of] + place] = np.arange(len(size))  # (chain, place) -> row
    before, after = np.empty((len(size), k)), np.ones((len(size), k))
    most = int(pieces.max()) if len(pieces) else 0
    prior = np.exp(start - start.max())
    for p in range(most):
        chains = np.flatnonzero(pieces > p)
        rows = at[offset[chains] + p]
        if p == 0:
            before[rows] = prior / prior.sum()
        else:
            last = at[offset[chains] + p - 1]
            before[rows] = _normalized((before[last][:, None, :] @ through[last])[:, 0, :])
    for p in range(most - 2, -1, -1):
        chains = np.flatnonzero(pieces > p + 1)
        rows, follows = at[offset[chains] + p], at[offset[chains] + p + 1]
        after[rows] = _normalized((through[follows] @ after[follows][:, :, None])[:, :, 0])
    # inside the segments
    forward = np.empty((max(len(active), 1), len(size), k))
    state = before
    for t, n in enumerate(active):
        moved = state[:n] @ move
        if t == 0:
            moved[first[:n]] = state[:n][first[:n]]
        state = _normalized(moved * potential[begin[:n] + t])
        forward[t, :n] = state
    mass = np.zeros((len(size), k))
    backward = after.copy()
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        mass[:n] += _normalized(forward[t, :n] * backward[:n])
        if t:
            backward[:n] = _normalized((potential[begin[:n] + t] * backward[:n]) @ move.T)
    out = np.zeros((len(lengths), k))
    np.add.at(out, chain_of, mass)
    return out


def _expected(scores: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities and summed transition probabilities of chains of
    one length; ``scores``: (chains, words, labels)."""
    move = np.exp(transition)
    potential = np.exp(scores - scores.max(axis=2, keepdims=True))
    n, length, k = scores.shape
    forward, pairs = np.empty_like(potential), np.zeros((k, k))
    forward[:, 0] = _normalized(np.exp(start) * potential[:, 0])
    for t in range(1, length):
        forward[:, t] = _normalized((forward[:, t - 1] @ move) * potential[:, t])
    marginal = np.empty_like(potential)
    backward = np.ones((n, k))
    marginal[:, -1] = forward[:, -1]
    for t in range(length - 1, 0, -1):
        coming = potential[:, t] * backward
        joint = forward[:, t - 1][:, :, None] * move[None] * coming[:, None, :]
        pairs += _normalized(joint).sum(axis=0)
        backward = _normalized(coming @ move.T)
        marginal[:, t - 1] = _normalized(forward[:, t - 1] * backward)
    return marginal, pairs, marginal[:, 0].sum(axis=0)


# ----------------------------------------------------------------- learning

@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    trigrams: dict[str, int] = field(default_factory=dict)  # trigram -> sum of 1 << 32 * label
    usual: tuple[float, ...] = ()  # familiar share of almost all held-out texts of a label, 0 if not known

    def familiar(self, word: str) -> float:
        """The largest share of the word's trigrams that a language has."""
        names = trigrams(word)
        found = sum(self.trigrams.get(x, 0) for x in names)
        return max(found >> 32 * j & 0xFFFFFFFF for j in range(len(self.labels))) / len(names)

    def known(self, label: int, words: int, familiar: float) -> bool:
        """``familiar``: sum over the text's words."""
        usual = self.usual[label] if self.usual else 0.0
        return (familiar + ADDED >= OF_USUAL * usual * (words + ADDED)) and (words - familiar <= LINE + (1 - OF_USUAL_LONG * usual) * words)


def trigrams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i:i + 3] for i in range(len(w) - 2)}


def _trigrams(texts: list[list[str]], marks: list[int]) -> dict[str, int]:
    """Trigrams of two texts of a label, or of one if there are few."""
    out: dict[str, int] = {}
    for label, n in Counter(marks).items():
        counts = Counter()
        for words, mark in zip(texts, marks):
            if mark == label:
                counts.update(set().union(*map(trigrams, set(words))))
        for name, times in counts.items():
            if times >= min(2, n // LEAST_HELD + 1):
                out[name] = out.get(name, 0) + (1 << 32 * label)
    return out


def _familiarity(texts: list[str], marks: list[int], labels: list[str]) -> tuple[dict[str, int], tuple[float, ...]]:
    """The trigrams of all texts, and the usual shares by every second text of
    a language held out of those of the others."""
    words = [words_of(t) for t in texts]
    held, seen = [], Counter()
    for mark in marks:
        held.append(seen[mark] % 2 == 1)
        seen[mark] += 1
    half = LanguageModel(labels, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), _trigrams(
        [w for w, h in zip(words, held) if not h], [m for m, h in zip(marks, held) if not h]))
    shares: dict[int, list[float]] = {j: [] for j in range(len(labels))}
    cache: dict[str, float] = {}
    for w, mark, h in zip(words, marks, held):
        if h and w:
            for x in w:
                if x not in cache:
                    cache[x] = half.familiar(x)
            shares[mark].append(sum(cache[x] for x in w) / len(w))
    return _trigrams(words, marks), tuple(float(np.quantile(s, 0.01)) if len(s) >= LEAST_HELD else 0.0 for s in shares.values())


def fit(texts: list[str], langs: list[str], seed: int = 0) -> LanguageModel:
    labels = sorted(set(langs))
    k = max(1, len(labels))
    familiarity = _familiarity(texts, [labels.index(x) for x in langs], labels)
    zero = LanguageModel(labels, np.zeros((ROWS, k), np.float32), np.zeros((k, k)), np.zeros(k), *familiarity)
    number: dict[str, int] = {}
    windows, marks = [], []
    for text, lang in zip(texts, langs):
        ids = [number.setdefault(w, len(number)) for w in words_of(text)]
        for i in range(0, len(ids) - WINDOW + 1, WINDOW):
            windows.append(ids[i:i + WINDOW])
            marks.append(labels.index(lang))
        if ids and len(ids) < WINDOW:  # short texts, repeated to a window
            windows.append((ids * WINDOW)[:WINDOW])
            marks.append(labels.index(lang))
    if len(labels) < 2 or len(windows) < JOINED:
        return zero
    order = np.random.default_rng(seed).permutation(len(windows))
    order = order[: len(order) // JOINED * JOINED].reshape(-1, JOINED)
    x = np.array(windows, dtype=np.int64)[order].reshape(len(order), -1)
    y = np.repeat(np.array(marks)[order], WINDOW, axis=1)
    rows = [feature_rows(w) for w in number]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, owner = np.fromiter(chain.from_iterable(rows), np.int64), np.repeat(np.arange(len(rows)), counts)
    edges = np.cumsum(counts) - counts
    observed = np.stack([np.bincount(x[y == j], minlength=len(rows)) for j in range(k)], axis=1).astype(float)
    observed_pairs = np.zeros((k, k))
    np.add.at(observed_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    observed_start = np.bincount(y[:, 0], minlength=k).astype(float)
    parameters = [np.zeros((ROWS, k)), np.zeros((k, k)), np.zeros(k)]
    means, squares = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, STEPS + 1):
        word_scores = np.add.reduceat(parameters[0][flat], edges, axis=0)
        marginal, pairs, first = _expected(word_scores[x], parameters[1], parameters[2])
        expected = np.stack([np.bincount(x.ravel(), weights=marginal[:, :, j].ravel(), minlength=len(rows)) for j in range(k)], axis=1)
        surplus = observed - expected
        slope = np.stack([np.bincount(flat, weights=surplus[owner, j], minlength=ROWS) for j in range(k)], axis=1)
        slopes = [slope / x.size - RIDGE * parameters[0], (observed_pairs - pairs) / x.size, (observed_start - first) / len(x)]
        for p, g, m, s in zip(parameters, slopes, means, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return LanguageModel(labels, parameters[0].astype(np.float32), parameters[1], parameters[2], *familiarity)


def train(docs: DataFrame, usable: Callable[[F.Column], F.Column] | None = None) -> LanguageModel:
    """``usable``: a condition on ``doc_id`` of the documents to learn from."""
    known = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_l")).where("_l is not null and _id is not null")
    if usable is not None:
        known = known.where(usable(F.col("_id")))
    known = known.distinct()
    langs = dict(sorted(known.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()))  # as many rows as there are languages
    if not langs:
        return fit([], [])
    # twice as many ids as texts, as some texts are empty
    chosen = hashed_sample_by(known, "_l", langs, 2 * TRAIN_DOCS, "_id")
    found = (docs.select("doc_id", "lang", "text").where(F.length("text") > 0)
             .join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_l")))
             .select("_l", F.xxhash64("_id").alias("_h"), "text"))
    rows = with_spread_text(found, TRAIN_CHARS).distinct().orderBy("_h", "text").limit(2 * TRAIN_DOCS * len(langs)).collect()
    taken = [r for x in langs for r in [r for r in rows if r["_l"] == x][:TRAIN_DOCS]]
    return fit([r["text"] for r in taken], [r["_l"] for r in taken])


# ---------------------------------------------------------------- labelling

class _WordScores(dict):
    """Word -> row of ``table``, its label scores; anew beyond ``CACHE_WORDS``."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.weights = model.weights
        self.table = np.zeros((CACHE_WORDS, model.weights.shape[1]), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table[: len(self.table) // 4 + 1])])
        self.table[row] = self.weights[feature_rows(word)].sum(axis=0)
        return row


class _Familiar(dict):
    """Word -> its familiar share; anew beyond ``CACHE_WORDS``."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        share = self[word] = self.model.familiar(word)
        return share


class Labeller:
    def __init__(self, model: LanguageModel):
        self.model, self.scores, self.familiar = model, _WordScores(model), _Familiar(model)

    def known(self, texts: list[str], labels: list[str]) -> list[bool]:
        """Whether the texts are in the languages they are labelled with."""
        number = {x: j for j, x in enumerate(self.model.labels)}
        out = []
        for text, label in zip(texts, labels):
            words = words_of(text) if label in number else []
            out.append(bool(words) and self.model.known(number[label], len(words), sum(map(self.familiar.__getitem__, words))))
        return out

    def labels(self, texts: list[str], group_words: int = 200_000) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        model, out = self.model, [(UNKNOWN, 0.0)] * len(texts)
        if not model.labels:
            return out
        held: list[tuple[int, np.ndarray]] = []
        total = 0

        def flush() -> None:
            lengths = np.array([len(rows) for _, rows in held])
            mass = label_mass(self.scores.table[np.concatenate([rows for _, rows in held])], lengths, model.transition, model.start)
            mass /= mass.sum(axis=1, keepdims=True)
            for (i, _), m in zip(held, mass):
                best = int(m.argmax())
                out[i] = (model.labels[best], float(m[best]))
            held.clear()
            if len(self.scores) >= CACHE_WORDS:
                self.scores.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                held.append((i, np.fromiter(map(self.scores.__getitem__, words), np.int64, len(words))))
                total += len(words)
                if total >= group_words:
                    flush()
                    total = 0
        if held:
            flush()
        return out


def with_language(docs: DataFrame, model: LanguageModel, label: str, score: str, checked: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, the language of ``text`` and its
    score: a map, no shuffle.  ``checked``: texts that are not known have the
    language ``und`` and score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS x languages weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        with no_cycle_collection():
            for b in batches:
                texts = text_list(b.column(at))
                found = labeller.labels(texts)
                if checked:
                    known = labeller.known(texts, [f[0] for f in found])
                    found = [f if ok else (UNKNOWN, 0.0) for f, ok in zip(found, known)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*b.schema.names, label, score])

    at = docs.columns.index("text")
    return docs.mapInArrow(run, schema_with(docs, **{label: "string", score: "double"}))


def identified(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``; documents whose
    crc32(doc_id as text) leaves ``held`` are not learned from."""
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    model = train(docs, lambda c: fold(c) != held)
    out = with_language(docs.select("doc_id", "text"), model, "lang_pred", "score")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


# A document of which no language holds so much is rejected; a short text with
# a license line in another language still has a language of about 0.4.
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose text is known and has a language that holds
    ``LEAST_SCORE`` of it."""
    label = unused_name("_lang", docs.columns)
    score = unused_name("_score", [*docs.columns, label])
    return (with_language(docs, model, label, score, checked=True)
            .where((F.col(label) != UNKNOWN) & (F.col(score) >= LEAST_SCORE))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
