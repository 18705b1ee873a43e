"""Spelling variants by search schemes in a bidirectional FM-index.

Words of a corpus are counted, and each frequent word is looked up with one
error (a code point inserted, deleted or replaced) among all others.  Of a pair
of such words either the first or the second half of the one is found unchanged
in the other, so two searches suffice:

* first half exact: match the half from its last letter to its first and the
  delimiter before the word, then extend to the right across the second half,
  allowing one error;
* second half exact: match it to the delimiter after the word, then extend to
  the left across the first half, allowing one error.

The index holds the words of a block between delimiters, in sorted order, as
two Burrows-Wheeler transforms, of the text and of its reverse.  A search state
is the pair of suffix-rank intervals of a pattern and of its reverse; extending
it to either side moves both.  As delimiters rank by the word after them, the
interval of ``$word$`` is the word's number.  All searches of a block advance
together, letter by letter, in numpy.

The vocabulary is dealt twice: by its first two letters for the first search
and by its last three for the second (the exact halves of words of five letters
or more hold these), so words that may be near are in one group.  Groups of
many words are cut into blocks of about ``BLOCK`` words and every block is
searched for every block of its group, so no task holds a larger group and
nothing is left out.  Chains of forms are followed by pointer doubling.

Defined results: null and empty texts have no words; a null doc_id counts as
empty text in the hash; every row is a document, so repeated rows count again;
ties between forms go to the smaller word by code points; words of any length
take part; an empty table gives no rows; columns besides ``doc_id`` and
``text`` are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import saved
from evalframe.llm.word_cache import no_cycle_collection

# Words of an index block, about; counted words a task holds before it passes them on.
BLOCK, COUNTED_WORDS = 65_536, 300_000
# Letters that words of a group share at their beginning, at their end: words
# of LEAST_LETTERS or more agree in one of them if one edit apart.
FIRST, LAST, LEAST_LETTERS = 2, 3, 5
# BWT symbols between two stored rows of counts; rank queries done at once.
STRIDE, SLICE = 64, 1 << 15

_RUN = re.compile("[a-zÀ-ÿ]+")


# ---------------------------------------------------------------- vocabulary

def with_slip(run: str, start: int, every: int) -> str:
    """The run, or the run less one code point if its hash is divisible by
    ``every``; ``start`` is the hash of what precedes the run."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, least: int = 3, every: int = 97) -> DataFrame:
    """``word``, ``n``: words of five letters or more that occur ``least``
    times or more over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        with no_cycle_collection():
            for b in batches:
                for doc_id, text in zip(b.column(0), b.column(1)):
                    raw = text.as_py()
                    if not raw:
                        continue
                    prefix = doc_id.as_py()
                    start = zlib.crc32(f"{'' if prefix is None else prefix}:".encode())
                    for word, n in Counter(_RUN.findall(raw.lower().decode())).items():  # bytes: A-Z only
                        counts[with_slip(word, start, every)] += n
                    if len(counts) >= COUNTED_WORDS:
                        yield flush()
            yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return (source.mapInArrow(run, "word string, n long").where(F.length("word") >= LEAST_LETTERS)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


# --------------------------------------------------------------------- index

def suffix_ranks(text: np.ndarray, n_delimiters: int) -> np.ndarray:
    """Suffix array by prefix doubling.  Symbol 0 is a delimiter; delimiters
    rank by their position, before all letters."""
    rank = text.astype(np.int64) + n_delimiters - 1
    rank[text == 0] = np.arange(n_delimiters)
    n, width = len(text), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-width or None] = rank[width:] + 1
        key = rank * (n + int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if new[order[-1]] == n - 1:
            return order
        rank, width = new, 2 * width


class Transform:
    """The Burrows-Wheeler transform of a delimited text, with counts of
    smaller symbols every ``STRIDE`` rows."""

    def __init__(self, text: np.ndarray, n_delimiters: int, n_symbols: int):
        order = suffix_ranks(text, n_delimiters)
        # nothing precedes the text: a symbol above all others
        bwt = np.where(order > 0, text[order - 1], n_symbols)
        n = len(text)
        rows = -(-(n + 1) // STRIDE)
        self.rows = np.full(rows * STRIDE, 255, np.uint8)
        self.rows[:n] = bwt
        self.rows = self.rows.reshape(rows, STRIDE)
        hist = np.zeros((rows, n_symbols + 2), np.int64)
        np.add.at(hist, (np.arange(n) // STRIDE, bwt + 1), 1)
        smaller = np.cumsum(hist, axis=1)  # of a stride, symbols below each symbol
        self.smaller = np.zeros((rows, n_symbols + 2), np.int32)
        self.smaller[1:] = np.cumsum(smaller, axis=0)[:-1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))[:n_symbols]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows before ``row``: how many hold a smaller symbol, how many
        ``symbol`` itself."""
        below, equal = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        for at in range(0, len(row), SLICE):
            s, r = symbol[at:at + SLICE], row[at:at + SLICE]
            stride, inside = r // STRIDE, np.arange(STRIDE) < (r % STRIDE)[:, None]
            cells, c = self.rows[stride], s.astype(np.uint8)[:, None]
            base = self.smaller[stride, s]
            below[at:at + SLICE] = base + np.count_nonzero((cells < c) & inside, axis=1)
            equal[at:at + SLICE] = self.smaller[stride, s + 1] - base + np.count_nonzero((cells == c) & inside, axis=1)
        return below, equal


@dataclass
class States:
    """Search states: the query of each, its interval in the index of the text
    (``lo``) and of the reversed text (``rev``), both of ``size`` rows."""

    query: np.ndarray
    lo: np.ndarray
    rev: np.ndarray
    size: np.ndarray

    def at(self, pick: np.ndarray) -> States:
        return States(self.query[pick], self.lo[pick], self.rev[pick], self.size[pick])

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("query", "lo", "rev", "size")))


class BidirectionalIndex:
    """Words (sorted, distinct) between delimiters, searched in both directions."""

    def __init__(self, words: list[str], letters: str):
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.n_symbols = len(letters) + 1
        delimited = lambda ws: np.array([0] + [x for w in ws for x in [*map(self.code.__getitem__, w), 0]], np.int64)
        self.ahead = Transform(delimited(words), len(words) + 1, self.n_symbols)
        self.back = Transform(delimited(sorted(w[::-1] for w in words)), len(words) + 1, self.n_symbols)
        self.n = sum(map(len, words)) + len(words) + 1

    def start(self, n_queries: int) -> States:
        zeros = np.zeros(n_queries, np.int64)
        return States(np.arange(n_queries), zeros, zeros.copy(), np.full(n_queries, self.n))

    def extend(self, states: States, symbol: np.ndarray, right: bool) -> States:
        """The states that are left when ``symbol`` is put at the right or left end."""
        side, lo = (self.back, states.rev) if right else (self.ahead, states.lo)
        below, equal = side.rank(symbol, lo)
        below_end, equal_end = side.rank(symbol, lo + states.size)
        mine, other = side.first[symbol] + equal, (states.lo if right else states.rev) + below_end - below
        # nothing matched yet: the transform's end of text would count as above all symbols
        other = np.where(states.size == self.n, side.first[symbol], other)
        out = States(states.query, other if right else mine, mine if right else other, equal_end - equal)
        return out.at(out.size > 0)

    def letters_beside(self, states: States, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a state and a letter that may stand beside it: the letters
        of small intervals as they are in the transform, else all letters."""
        side, lo = (self.back, states.rev) if right else (self.ahead, states.lo)
        small = np.flatnonzero(states.size < self.n_symbols)
        sizes = states.size[small]
        state = np.repeat(small, sizes)
        row = np.repeat(lo[small] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        symbol = side.rows.reshape(-1)[row].astype(np.int64)
        pair = np.unique(state * (self.n_symbols + 1) + symbol)
        state, symbol = pair // (self.n_symbols + 1), pair % (self.n_symbols + 1)
        is_letter = (symbol > 0) & (symbol < self.n_symbols)
        large = np.flatnonzero(states.size >= self.n_symbols)
        letters = np.arange(1, self.n_symbols)
        return (np.concatenate([state[is_letter], np.repeat(large, len(letters))]),
                np.concatenate([symbol[is_letter], np.tile(letters, len(large))]))


# ------------------------------------------------------------------- schemes

def first_half(word: str) -> int:
    """Letters of the first half: a word one edit longer or shorter, or equal
    in length, agrees with this one in these letters or in all the others."""
    return (len(word) - 1) // 2


class _Parts:
    """A part of every query, in the order in which a search reads it."""

    def __init__(self, parts: list[str], code: dict[str, int]):
        self.length = np.array([len(p) for p in parts], np.int64)
        self.begin = np.append(0, np.cumsum(self.length))[:-1]
        self.flat = np.array([code[c] for p in parts for c in p], np.int64)

    def symbol(self, query: np.ndarray, at: int) -> np.ndarray:
        """The symbol at ``at``, the delimiter behind the last one."""
        inside = at < self.length[query]
        return np.where(inside, self.flat[np.where(inside, self.begin[query] + at, 0)], 0)


def _exact(index: BidirectionalIndex, states: States, parts: _Parts, right: bool) -> States:
    """Extended by every symbol of the part, then by the delimiter."""
    done, at = [], 0
    while len(states.query):
        states = index.extend(states, parts.symbol(states.query, at), right)
        ends = parts.length[states.query] == at
        done.append(states.at(ends))
        states, at = states.at(~ends), at + 1
    return States.joined(done) if done else states


def _one_error(index: BidirectionalIndex, exact: States, parts: _Parts, right: bool) -> States:
    """Extended across the part with exactly one error, then by the delimiter."""
    found, erred, at = [exact.at(np.zeros(len(exact.query), bool))], [], 0
    while len(exact.query) or any(len(e.query) for e in erred):
        here = parts.symbol(exact.query, at)
        inside = at < parts.length[exact.query]
        state, letter = index.letters_beside(exact, right)
        other = letter != here[state]
        state, letter = state[other], letter[other]
        grown = index.extend(exact.at(state), letter, right)
        # one letter more: the symbol here is still to come
        now = States.joined([*erred, grown])
        # one replaced, one left out (of a run of equal letters, the last)
        replaced = grown.at(at < parts.length[grown.query])
        left_out = exact.at(inside & (parts.symbol(exact.query, at + 1) != here))
        now = index.extend(now, parts.symbol(now.query, at), right)
        ends = parts.length[now.query] == at
        found.append(now.at(ends))
        erred = [now.at(~ends), replaced, left_out]
        exact = index.extend(exact.at(inside), here[inside], right)
        at += 1
    return States.joined(found)


def near_pairs(index: BidirectionalIndex, words: list[str], queries: list[str], by_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) one edit apart, as numbers: those that agree in the
    query's first half, or all others."""
    halves = [first_half(q) for q in queries]
    first = _Parts([q[:h][::-1] for q, h in zip(queries, halves)], index.code)
    second = _Parts([q[h:] for q, h in zip(queries, halves)], index.code)
    states = index.start(len(queries))
    if by_first:
        states = _one_error(index, _exact(index, states, first, right=False), second, right=True)
    else:
        states = _one_error(index, _exact(index, states, second, right=True), first, right=False)
    pairs = np.unique(states.query * len(words) + states.lo)
    query, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    if not by_first:
        agree = [queries[q][:halves[q]] == words[w][:halves[q]] for q, w in zip(query.tolist(), word.tolist())]
        keep = ~np.array(agree, bool)
        query, word = query[keep], word[keep]
    return query, word


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def search_block(rows: pa.Table, by_first: bool) -> pa.Table:
    """For each word of ``rows`` that is a query, how many words of the index
    are near and the most frequent of them."""
    all_words, all_n = rows["word"].to_pylist(), rows["n"].to_pylist()
    indexed = sorted((w, n) for w, n, i in zip(all_words, all_n, rows["indexed"].to_pylist()) if i)
    words, n = [w for w, _ in indexed], np.array([n for _, n in indexed], np.int64)
    queries = [w for w, a in zip(all_words, rows["asked"].to_pylist()) if a]
    if not words or not queries:
        return _NEAR.empty_table()
    index = BidirectionalIndex(words, "".join(sorted({*"".join(words), *"".join(queries)})))
    query, word = near_pairs(index, words, queries, by_first)
    order = np.lexsort((word, -n[word], query))
    query, word = query[order], word[order]
    at, first, counts = np.unique(query, return_index=True, return_counts=True)
    best = word[first]
    columns = [[queries[q] for q in at], counts, n[best], [words[w] for w in best]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NEAR)], schema=_NEAR)


def searched(vocab: DataFrame, by_first: bool, total: int) -> DataFrame:
    """The searches of one scheme over the whole (saved) vocabulary."""
    spark = vocab.sparkSession
    key = F.substring("word", 1, FIRST) if by_first else F.expr(f"right(word, {LAST})")
    keyed = vocab.withColumn("key", key)
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # a block as index (i) and as queries (q): each word goes to its row and its column of the square
    cells = F.expr("""array_distinct(concat(transform(sequence(0, blocks - 1), x -> struct(own as i, x as q)),
                                            transform(sequence(0, blocks - 1), x -> struct(x as i, own as q))))""")
    lumps = max(1, math.ceil(total / BLOCK))
    dealt = (placed.withColumn("cell", F.explode(cells))
             .select("word", "n", (F.col("cell.i") == F.col("own")).alias("indexed"), (F.col("cell.q") == F.col("own")).alias("asked"),
                     # words of small groups share a task; a cell of a cut group has its own
                     F.when(F.col("blocks") == 1, F.concat(F.lit("lump "), F.pmod(F.xxhash64("key"), F.lit(lumps))))
                     .otherwise(F.concat_ws(" ", "key", "cell.i", "cell.q")).alias("cell")))
    tasks = min(20_000, max(4 * lumps, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return (dealt.repartition(tasks, "cell").groupBy("cell")
            .applyInArrow(lambda rows: search_block(rows, by_first), "word string, n_near long, best_n long, best string"))


# ----------------------------------------------------------------- the whole

def roots(forms: DataFrame, longest: int) -> DataFrame:
    """``word``, ``root`` of all words that have a form: the last of its chain,
    by pointer doubling; no chain is longer than ``longest``."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        after = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = saved(at.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def group(docs: DataFrame, least: int = 3, every: int = 97) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every
    word of ``docs`` (``doc_id``, ``text``)."""
    vocab = saved(vocabulary(docs, least, every), "vocabulary")
    size = vocab.agg(F.count(F.lit(1)).alias("total"), F.max("n").alias("most")).first()
    nothing = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    near = vocab.select("word", "n", *nothing)
    for by_first in (True, False):
        near = near.unionByName(searched(vocab, by_first, size["total"]).withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    merged = near.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    words = saved(merged.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"),
                                F.when(is_form, -F.col("best.less")).alias("form_n")), "words")
    # each step of a chain at least doubles n, which begins at `least`
    longest = int(math.log2(max(1.0, (size["most"] or 1) / least))) + 1
    of_word = roots(words.where("form is not null"), longest)
    return words.join(of_word, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
