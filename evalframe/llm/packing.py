"""Packing documents into fixed-length sequences by linear grouping.

The scheme needs only how many pieces there are of each length, and lengths
are bounded by the capacity, so one small histogram (at most ``capacity``
rows) leads to the whole plan:

1. Large lengths (over a share of the capacity) are sorted and cut into groups of
   equal cardinality; each group's lengths are rounded up to its longest.
2. The few rounded sizes are packed by configurations: column generation over
   the linear relaxation, then whole copies of the configurations it chose.
3. Actual documents replace the rounded ones, slot by slot; as none is longer
   than its slot, every configuration still fits.
4. The rest, longest first, goes where it fits best: into the sequences with
   the least free space that still holds it, whole runs of equal lengths at a
   time; sequences are opened only when none holds it.

The plan is a list of runs "pieces ``first .. first + n`` of length ``l`` go to
sequences ``sequence, sequence + 1, ...``, ``each`` to a sequence, from place
``offset``".  Pieces are numbered within their length by a distributed count
(per task and length, then a running sum over tasks), and each finds its run
by binary search; no document, and no list of documents, passes through the
driver or through one task.

Defined results: a null text is an empty text; every document ends with the
end id, so an empty one makes a piece of length 1; only documents longer than
``capacity`` are cut; equal pieces are interchangeable (repeated rows are
packed each for itself); an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import saved, text_list
from evalframe.llm.word_cache import library_encoder, no_cycle_collection

# Lengths over this share of the capacity are grouped; so many groups.  The
# settings are tried in turn until a plan needs at most ``NEAR`` times the
# sequences that the tokens alone would fill; the best plan is taken.
SETTINGS, NEAR = ((0.45, 128), (0.2, 64)), 1.001

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


@dataclass(frozen=True)
class Run:
    """Pieces ``first .. first + count - 1`` of ``length``."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


# ---------------------------------------------------------------- the plan

def _best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` within ``capacity``."""
    order = np.array([j for j in range(len(sizes)) if values[j] > 1e-12], dtype=int)
    counts = np.zeros(len(sizes), dtype=int)
    if not len(order):
        return 0.0, counts
    size, value = np.array(sizes)[order], values[order]
    least = int(size.min())
    # best[room], with a margin of -inf for rooms below zero
    margin = int(size.max())
    best = np.concatenate([np.full(margin, -np.inf), np.zeros(capacity + 1)])
    choice = np.full(capacity + 1, -1)
    for room in range(least, capacity + 1):
        worth = best[margin + room - size] + value
        j = int(worth.argmax())
        if worth[j] > best[margin + room - 1] + 1e-12:
            best[margin + room], choice[room] = worth[j], j
        else:
            best[margin + room] = best[margin + room - 1]
    room = capacity
    while room >= least:
        if choice[room] < 0:
            room -= 1
        else:
            counts[order[choice[room]]] += 1
            room -= size[choice[room]]
    return float(best[-1]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (items of each size) and how many whole copies of each,
    from the linear relaxation solved by column generation; together they
    hold at most ``demand``."""
    m = len(sizes)
    columns = [np.eye(m, dtype=int)[j] * (capacity // sizes[j]) for j in range(m)]
    basis, need = np.array(columns, dtype=float).T, np.array(demand, dtype=float)
    amounts = need / np.diag(basis)
    for _ in range(40 * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, column = _best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-6:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(np.argmin(ratios))
        step = ratios[leaves]
        amounts = np.maximum(amounts - step * direction, 0)
        amounts[leaves] = step
        basis[:, leaves], columns[leaves] = column, column
    left, out = np.array(demand, dtype=int), []
    for j in np.argsort(-amounts):
        copies = int(amounts[j] + 1e-6)
        used = columns[j] > 0
        copies = min([copies, *(left[used] // columns[j][used])]) if used.any() else 0
        if copies > 0:
            out.append((columns[j], copies))
            left -= columns[j] * copies
    return out


class _Open:
    """Sequences that have been begun: runs of them by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, {}, 0

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def add(self, free: int, sequence: int, count: int) -> None:
        if free > 0 and count > 0:
            self.runs.setdefault(free, []).append((sequence, count))


def _substituted(sizes: list[int], members: list[list[tuple[int, int]]], capacity: int, taken: Counter,
                 opened: _Open) -> list[Run]:
    """Copies of the configurations, filled with actual lengths.  ``members``:
    for each group its (length, count), longest first; ``taken``: pieces of a
    length that have a place, extended here."""
    plan: list[Run] = []
    at = [0] * len(sizes)
    left = [[list(x) for x in group] for group in members]
    demand = [sum(n for _, n in group) for group in members]
    for column, copies in configurations(sizes, demand, capacity):
        shares = {j: int(k) for j, k in enumerate(column) if k}
        while copies > 0:
            # as many copies as the current length of every group can fill
            for j in shares:
                while left[j][at[j]][1] == 0:
                    at[j] += 1
            block = min([copies] + [left[j][at[j]][1] // k for j, k in shares.items()])
            if block == 0:  # one copy, its slots filled one by one across lengths
                block, filled = 1, []
                for j, k in shares.items():
                    for _ in range(k):
                        while left[j][at[j]][1] == 0:
                            at[j] += 1
                        left[j][at[j]][1] -= 1
                        filled.append((left[j][at[j]][0], 1))
            else:
                filled = []
                for j, k in shares.items():
                    left[j][at[j]][1] -= block * k
                    filled.append((left[j][at[j]][0], k))
            sequence, offset = opened.new(block), 0
            for length, k in filled:
                plan.append(Run(length, taken[length], block * k, sequence, k, offset))
                taken[length] += block * k
                offset += length * k
            opened.add(capacity - offset, sequence, block)
            copies -= block
    return plan


def _best_fit(rest: list[tuple[int, int]], capacity: int, taken: Counter, opened: _Open) -> list[Run]:
    """``rest``: (length, count), longest first."""
    plan: list[Run] = []
    spaces = sorted(opened.runs)

    def put(length: int, count: int, sequence: int, each: int, free: int) -> None:
        plan.append(Run(length, taken[length], count, sequence, each, capacity - free))
        taken[length] += count

    def keep(free: int, sequence: int, count: int) -> None:
        if free > 0 and count > 0:
            if free not in opened.runs:
                bisect.insort(spaces, free)
            opened.add(free, sequence, count)

    for length, count in rest:
        while count > 0:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                free = spaces[k]
                sequence, bins = opened.runs[free].pop()
                if not opened.runs[free]:
                    del opened.runs[free], spaces[k]
            else:
                free = capacity
                bins = -(-count // (capacity // length))
                sequence = opened.new(bins)
            each = free // length
            full = min(bins, count // each)
            if full:
                put(length, full * each, sequence, each, free)
                keep(free - each * length, sequence, full)
                count -= full * each
            sequence, bins = sequence + full, bins - full
            if bins and count:  # fewer than ``each`` are left
                put(length, count, sequence, count, free)
                keep(free - count * length, sequence, 1)
                sequence, bins, count = sequence + 1, bins - 1, 0
            keep(free, sequence, bins)
    return plan


def pack_plan(histogram: dict[int, int], capacity: int,
              settings: tuple[tuple[float, int], ...] = SETTINGS) -> list[Run]:
    """Where the pieces of each length go; ``histogram``: pieces by length."""
    least = sum(length * n for length, n in histogram.items()) / capacity
    best, sequences = [], float("inf")
    for large, groups in settings:
        plan, used = _pack_plan(histogram, capacity, large, groups)
        if used < sequences:
            best, sequences = plan, used
        if sequences <= NEAR * least + 1:
            break
    return best


def _pack_plan(histogram: dict[int, int], capacity: int, large: float, groups: int) -> tuple[list[Run], int]:
    lengths = sorted((x for x in histogram if histogram[x] > 0), reverse=True)
    opened, taken, plan = _Open(capacity), Counter(), []
    if lengths and lengths[0] == capacity:
        n = histogram[capacity]
        plan.append(Run(capacity, 0, n, opened.new(n), 1, 0))
        taken[capacity] = n
        lengths = lengths[1:]
    big = [x for x in lengths if x > capacity * large]
    total = sum(histogram[x] for x in big)
    if total:
        per_group = -(-total // groups)
        members, room = [], 0
        for x in big:
            n = histogram[x]
            while n > 0:
                if room == 0:
                    members.append([])
                    room = per_group
                k = min(n, room)
                members[-1].append((x, k))
                n, room = n - k, room - k
        # neighbouring groups of one rounded size are one size of the configurations
        merged: dict[int, list[tuple[int, int]]] = {}
        for group in members:
            merged.setdefault(group[0][0], []).extend(group)
        plan += _substituted(list(merged), list(merged.values()), capacity, taken, opened)
    plan += _best_fit([(x, histogram[x] - taken[x]) for x in lengths if histogram[x] > taken[x]], capacity, taken, opened)
    return plan, opened.sequences


# ------------------------------------------------------------- the documents

def pieces(docs: DataFrame, path: str, kind: str, end_id: int, capacity: int) -> DataFrame:
    """Token ids of every document, cut into pieces, saved with each piece's
    task and its number among the task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), Counter()
        encoder, last = library_encoder(path, kind), np.array([end_id], dtype="<u4").tobytes()
        with no_cycle_collection():
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), text_list(b.column(1))):
                    ids = encoder.ids(text) + last
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[i:i + 4 * capacity]
                        n = len(part) // 4
                        rows.append((doc_id, k, i // 4, n, zlib.crc32(part), task, numbers[n]))
                        numbers[n] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.int64()) for f in _PIECES.split(", ")])
    return saved(docs.select("doc_id", "text").mapInArrow(cut, _PIECES), "pieces")


def pack(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, capacity: int = 4096,
         settings: tuple[tuple[float, int], ...] = SETTINGS) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``."""
    cut = pieces(docs, path, kind, end_id, capacity)
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts, "piece-counts")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(pack_plan(histogram, capacity, settings), key=lambda r: (r.length, r.first))
    runs = np.array([(r.length, r.first, r.sequence, r.each, r.offset) for r in plan], dtype=np.int64).reshape(-1, 5)
    before = counts.selectExpr("task as _t", "length as _l", "sum(n) over (partition by length order by task) - n as _before")
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        # (length, first) as one sortable number: numbers stay below 2^50
        keys = runs[:, 0] * (1 << 50) + runs[:, 1]
        for b in batches:
            length, number = (b.column(k).to_numpy() for k in (3, 5))
            r = runs[np.searchsorted(keys, length * (1 << 50) + number, side="right") - 1]
            within = number - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(r[:, 2] + within // r[:, 3]), pa.array(r[:, 4] + within % r[:, 3] * length)],
                names=[f.split()[0] for f in out.split(", ")])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return (cut.join(before, (cut["task"] == before["_t"]) & (cut["length"] == before["_l"]))
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("_before")).alias("number"))
            .mapInArrow(placed, out))
