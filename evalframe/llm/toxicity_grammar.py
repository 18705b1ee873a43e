"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, colon, quote,
clause end.  Small transducers each read a clause's symbols and rewrite what
they know:

* *report* turns an insult or threat in reported speech into a quoted one:
  after a report word, after its colon or between its quotation marks, or just
  before it ("..., he said");
* *negation* turns one in its scope into a denied one;
* *target* marks one that a person stands near, before or after it;
* *insult* and *threat* turn what is left into matches, by arcs with weights.

Those that look back are composed into one transducer, and so are those that
look ahead; a clause is read once forwards by the first and its output once
backwards by the second (state pairs are built as they are reached).  A
clause's score is the sum of the weights of the arcs it took, an insult's times
the insult's own, so a word counts by what its clause does with it.  The best
clause decides a text, and what the others score adds its logarithm.

Insult words are learned from labelled texts: words whose texts are toxic far
more often than others, counted once for each distinct pair of neighbouring
words, so that a passage copied into many texts counts once.  The weights of
the arcs are learned by logistic regression on the same texts, in turn with
the choice of their best clauses.  Target, threat, negation and report words
are fixed lists.

Learning takes at most ``TRAIN_DOCS`` labelled texts of each class, those of
the smallest hashes of doc_id, and of each at most about ``TRAIN_CHARS``
characters, spread over the whole text; no text is left out for its length.  In the fit
a text stands for as many as its class has for each one taken, so the bias and
the cut mean the same at every size.  Scoring reads every text whole.  Neither doc_id nor source, language or label is an
input of a score.

Defined results: a text of any length is read whole, a clause at a time; of
clauses of equal score the first is the best; a null or empty text, or one without a match, has the score
of no match; labels that are null are not learned from; repeated rows are
scored each for itself; without labels of both classes all scores are the
share of toxic labels (0 without any); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import hashed_sample_by, schema_with, text_list, unused_name, with_spread_text
from evalframe.llm.word_cache import no_cycle_collection

# Labelled texts of a class, and characters of a text, that are learned from.
TRAIN_DOCS, TRAIN_CHARS = 2_000, 20_000
# An insult word: so many distinct neighbourhoods in toxic texts, and such log
# odds, that chance would give at most so many words as good.
LEAST_CONTEXTS, LEAST_LOG_ODDS, BY_CHANCE = 3, 1.5, 0.5

# ------------------------------------------------- fixed values: word classes
TARGET_WORDS = """you your yours yourself he him his she her they them their these those everyone
du dich dir dein deine sie ihr ihn ihm euch
tu te toi ton ta vous votre vos il elle ils elles lui leur
tú ti tu usted ustedes él ella ellos ellas vosotros""".split()
THREAT_WORDS = """kill murder hurt beat attack destroy burn shoot stab
töten umbringen schlagen verletzen zerstören erschießen
tuer frapper blesser détruire brûler
matar golpear herir destruir quemar""".split()
NEGATION_WORDS = """not no never none nobody neither nor isn aren wasn don doesn didn won
nicht kein keine keinen nie niemals
ne pas jamais aucun aucune non
nunca jamás ningún ninguna tampoco""".split()
REPORT_WORDS = """said says say wrote writes called calls quoted quotes claimed claims reported
sagte sagt schrieb nannte behauptete
dit disait écrit appelé affirmé
dijo dice escribió llamó afirmó""".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, END = "insult", "threat", "target", "negation", "report", "end"
COLON, QUOTE = "colon", "quote"
# words between a symbol and the word it acts on, at most; between a word and the report of it that follows
REACH, REACH_BACK = 6, 3
MATCHES = [f"{kind} {how}" for kind in (INSULT, THREAT) for how in ("plain", "aimed", "denied", "quoted")]

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;|\n:\"“”„«»]")


# ------------------------------------------------------------- transducers

@dataclass
class Transducer:
    """``step(state, symbol)`` gives the next state and the symbol written."""

    start: object
    step: Callable[[object, tuple], tuple[object, tuple]]
    table: dict = field(default_factory=dict)

    def __call__(self, state: object, symbol: tuple) -> tuple[object, tuple]:
        key = (state, symbol)
        found = self.table.get(key)
        if found is None:
            found = self.table[key] = self.step(state, symbol)
        return found

    def then(self, other: Transducer) -> Transducer:
        """Composition: ``other`` reads what this one writes."""

        def step(state: tuple, symbol: tuple) -> tuple[tuple, tuple]:
            mine, written = self(state[0], symbol)
            theirs, out = other(state[1], written)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def _scope(opener: str, mark: str, over: tuple[str, ...] = ("plain",), reach: int = REACH, closers: tuple[str, ...] = (END,)) -> Transducer:
    """Marks an insult or threat at most ``reach`` words after ``opener`` (in
    reading direction) that is marked as one of ``over`` so far.  A symbol is
    (kind, words since the last symbol, mark)."""

    def step(state: int, symbol: tuple) -> tuple[int, tuple]:
        kind, gap, how = symbol
        left = max(0, state - gap)
        if kind in closers:
            return 0, symbol
        if kind == opener:
            return reach, symbol
        if kind in (INSULT, THREAT) and left > 0 and how in over:
            return left, (kind, gap, mark)
        return left, symbol

    return Transducer(0, step)


def _speech() -> Transducer:
    """Marks what a report word introduces: to the end of the clause after its
    colon, to the closing mark after a quotation mark, else its scope."""

    def step(state: object, symbol: tuple) -> tuple[object, tuple]:
        kind, gap, how = symbol
        if kind == END:
            return 0, symbol
        if state in (COLON, QUOTE):
            if kind == QUOTE:  # closes a quotation, or begins the one that the colon announced
                return (0 if state == QUOTE else QUOTE), symbol
            return state, (kind, gap, "quoted") if kind in (INSULT, THREAT) else symbol
        left = max(0, state - gap)
        if kind == REPORT:
            return REACH, symbol
        if kind in (COLON, QUOTE) and left > 0:
            return kind, symbol
        return left, (kind, gap, "quoted") if kind in (INSULT, THREAT) and left > 0 else symbol

    return Transducer(0, step)


def _scored(kind: str, weights: dict[str, float]) -> Transducer:
    """Writes the match that a clause has of ``kind`` and its weight."""

    def step(state: int, symbol: tuple) -> tuple[int, tuple]:
        if symbol[0] == kind and len(symbol) == 3:
            match = f"{kind} {symbol[2]}"
            return state, (match, weights.get(match, 0.0))
        return state, symbol

    return Transducer(0, step)


def grammar(weights: dict[str, float]) -> tuple[Transducer, Transducer]:
    """The transducers that read forwards and those that read backwards.
    Quoted goes before denied before aimed: a quoted denial is quoted."""
    forwards = _speech().then(_scope(NEGATION, "denied", closers=(END, COLON, QUOTE))).then(_scope(TARGET, "aimed"))
    backwards = (_scope(REPORT, "quoted", ("plain", "denied", "aimed"), REACH_BACK).then(_scope(TARGET, "aimed"))
                 .then(_scored(INSULT, weights)).then(_scored(THREAT, weights)))
    return forwards, backwards


class Matcher:
    """The matches of a text's clauses; an insult counts by its weight."""

    def __init__(self, insults: dict[str, float], weights: dict[str, float] | None = None):
        self.insults = insults
        self.kind = {w: TARGET for w in TARGET_WORDS} | {w: NEGATION for w in NEGATION_WORDS}
        self.kind |= {w: REPORT for w in REPORT_WORDS} | {w: THREAT for w in THREAT_WORDS}
        self.kind |= {w: INSULT for w in insults} | {c: END for c in ".!?;|\n"} | {":": COLON} | {c: QUOTE for c in "\"“”„«»"}
        self.scored = set(insults) | set(THREAT_WORDS)
        self.forwards, self.backwards = grammar(weights or {})

    def clauses(self, text: str) -> Iterator[list[tuple[str, float, float]]]:
        """Of each clause that has any: its matches (name, weight of its arc,
        weight of the word)."""
        tokens = _TOKEN.findall(text.lower())
        if self.scored.isdisjoint(tokens):
            return
        kinds = self.kind
        clause: list[tuple[str, int, str]] = []  # kind, place, word
        any_scored = False
        for i, token in enumerate(tokens):
            kind = kinds.get(token)
            if kind is None:
                continue
            if kind != END:
                clause.append((kind, i, token))
                any_scored = any_scored or kind in (INSULT, THREAT)
                continue
            if any_scored:
                yield self._read(clause)
            clause, any_scored = [], False
        if any_scored:
            yield self._read(clause)

    def _read(self, clause: list[tuple[str, int, str]]) -> list[tuple[str, float, float]]:
        state, at, marked = self.forwards.start, clause[0][1], []
        for kind, place, _ in clause:
            state, written = self.forwards(state, (kind, min(place - at, REACH + 1), "plain"))
            marked.append(written)
            at = place
        state, at, out = self.backwards.start, clause[-1][1], []
        for (kind, place, word), (_, _, how) in zip(reversed(clause), reversed(marked)):
            state, written = self.backwards(state, (kind, min(at - place, REACH + 1), how))
            at = place
            if len(written) == 2:
                out.append((*written, self.insults.get(word, 1.0)))
        return out[::-1]

    def matches(self, text: str) -> dict[str, float]:
        """Matches of the whole text: name -> sum of the words' weights."""
        out: dict[str, float] = defaultdict(float)
        for clause in self.clauses(text):
            for match, _, word in clause:
                out[match] += word
        return dict(out)

    def features(self, text: str) -> np.ndarray:
        """A row for each clause: the weight of its words by match."""
        rows = []
        for clause in self.clauses(text):
            row = np.zeros(len(MATCHES))
            for match, _, word in clause:
                row[_PLACE[match]] += word
            rows.append(row)
        return np.array(rows).reshape(-1, len(MATCHES))

    def evidence(self, text: str) -> tuple[float, float]:
        """The score of the best clause, and the logarithm of what the others
        score; zeros without a match."""
        scores = [sum(arc * word for _, arc, word in clause) for clause in self.clauses(text)]
        return _evidence(np.array(scores))


_PLACE = {m: i for i, m in enumerate(MATCHES)}


def _evidence(scores: np.ndarray) -> tuple[float, float]:
    if not len(scores):
        return 0.0, 0.0
    best = int(scores.argmax())
    return float(scores[best]), math.log1p(float(np.delete(scores, best).clip(0).sum()))


# ----------------------------------------------------------------- learning

@dataclass(frozen=True)
class ToxicityModel:
    """``weights``: of the arcs by match, then of the other clauses' evidence."""

    insults: dict[str, float]
    weights: np.ndarray
    bias: float

    def matcher(self) -> Matcher:
        return Matcher(self.insults, dict(zip(MATCHES, self.weights.tolist())))

    def score(self, evidence: tuple[float, float]) -> float:
        z = evidence[0] + float(self.weights[-1]) * evidence[1] + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_insults(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Word -> weight: log odds of toxic against clean neighbourhoods."""
    contexts: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    for text, label in zip(texts, labels):
        words = re.findall(r"[^\W\d_]+", text.lower())
        seen: set[str] = set()
        for left, word, right in zip(chain([""], words), words, chain(words[1:], [""])):
            if word not in seen:  # one neighbourhood of a word for each text
                seen.add(word)
                contexts[label][word].add(hash((left, right)))
    n = Counter(labels)
    share = n[1] / max(1, len(labels))
    counted = {w: (len(c), len(contexts[0].get(w, ()))) for w, c in contexts[1].items() if len(c) >= LEAST_CONTEXTS and len(w) > 1}
    seen_often = Counter(len(contexts[0].get(w, ())) + len(contexts[1].get(w, ())) for w in {*contexts[0], *contexts[1]})
    out = {}
    for word, (a, b) in counted.items():
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        if odds < LEAST_LOG_ODDS or a / (a + b) <= share:
            continue
        # Chernoff's bound on so large a toxic share of a + b, for all words seen as often
        bound = a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0.0)
        candidates = sum(k for times, k in seen_often.items() if times >= a)
        if math.exp(-bound) * candidates <= BY_CHANCE:
            out[word] = odds
    return out


def _regression(x: np.ndarray, y: np.ndarray, each: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression: Newton steps with a ridge."""
    n = x.shape[1]
    weights, bias = np.zeros(n), 0.0
    design = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1e-3 * len(x) ** 0.5] * n + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        slope = design.T @ (each * (y - p)) - ridge @ np.append(weights, bias)
        curve = design.T @ (design * (each * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(curve)), slope)
        weights, bias = weights + step[:-1], bias + step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return weights, float(bias)


# Turns of choosing the best clauses and weighing their arcs.
TURNS = 6


def fit(texts: list[str], labels: list[int], stands_for: dict[int, float] | None = None) -> ToxicityModel:
    """Insult words from one half of the texts and weights of the arcs from
    the other and the other way round, so that the weights see insults as new
    texts show them; the words of both halves together are kept.

    ``stands_for``: the texts of its class that a text of a label stands for."""
    y = np.array(labels, dtype=float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        constant = math.log((share + 1e-9) / (1 - share + 1e-9))
        return ToxicityModel({}, np.zeros(len(MATCHES) + 1), constant)
    clauses: list[np.ndarray] = [np.zeros((0, len(MATCHES)))] * len(texts)
    for half in (0, 1):
        matcher = Matcher(learn_insults(texts[half::2], labels[half::2]))
        for i in range(1 - half, len(texts), 2):
            clauses[i] = matcher.features(texts[i])
    insults = learn_insults(texts, labels)
    if insults and not any(map(len, clauses)):  # too few texts to learn any word from a half
        matcher = Matcher(insults)
        clauses = [matcher.features(t) for t in texts]
    each = np.array([(stands_for or {}).get(label, 1.0) for label in labels], dtype=float)
    each /= each.mean()  # the ridge is for so many texts
    # at first the sums over all clauses; then the best clause by the last weights, and the others' evidence
    weights, bias = _regression(np.array([np.log1p(c.sum(axis=0)) for c in clauses]), y, each)
    weights = np.append(weights, 0.0)
    for _ in range(TURNS):
        x = np.zeros((len(texts), len(MATCHES) + 1))
        for i, c in enumerate(clauses):
            if len(c):
                scores = c @ weights[:-1]
                x[i, :-1], x[i, -1] = c[int(scores.argmax())], _evidence(scores)[1]
        weights, bias = _regression(x, y, each)
    return ToxicityModel(insults, weights, bias)


def train(docs: DataFrame, labels: DataFrame, usable: Callable[[F.Column], F.Column] | None = None) -> ToxicityModel:
    """``usable``: a condition on ``doc_id`` of the labels to learn from."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    if usable is not None:
        known = known.where(usable(F.col("_id")))
    known = known.distinct()
    # ids of each class by hash, twice as many as needed, as some have no text; then one scan of the texts
    total = dict(known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect())
    chosen = hashed_sample_by(known, "_y", total, 2 * TRAIN_DOCS, "_id")
    texts = (docs.select("doc_id", "text").where(F.col("text").isNotNull())
             .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
             .select(F.xxhash64("_id").alias("_h"), "_id", "text", "_y"))
    rows = with_spread_text(texts, TRAIN_CHARS).distinct().orderBy("_h", "_id", "text", "_y").limit(4 * TRAIN_DOCS).collect()
    found = {y: [r for r in rows if r["_y"] == y] for y in (0, 1)}
    taken = sorted((r for y in (0, 1) for r in found[y][:TRAIN_DOCS]), key=lambda r: (r["_id"], r["_y"], r["text"]))
    # labels for each id drawn, texts found for each text taken
    stands_for = {y: total[y] / min(total[y], 2 * TRAIN_DOCS) * len(found[y]) / len(found[y][:TRAIN_DOCS]) for y in (0, 1) if found[y]}
    return fit([r["text"] for r in taken], [r["_y"] for r in taken], stands_for=stands_for)


# ------------------------------------------------------------------ scoring

def with_score(docs: DataFrame, model: ToxicityModel, column: str) -> DataFrame:
    """All rows and columns of ``docs`` and the score of ``text``: a map, no
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        with no_cycle_collection():
            for b in batches:
                scores = [model.score(matcher.evidence(t)) for t in text_list(b.column(at))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, column])

    at = docs.columns.index("text")
    return docs.mapInArrow(run, schema_with(docs, **{column: "double"}))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``; labels of documents
    whose crc32(doc_id as text) is divisible by ``folds`` are not learned from."""
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    model = train(docs, labels, lambda c: fold(c) != 0)
    out = with_score(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows whose text is not predicted to be toxic."""
    score = unused_name("_score", docs.columns)
    return with_score(docs, model, score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
