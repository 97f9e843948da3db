"""Best-fit packing of pieces into sequences by a configuration linear program.

Only the histogram of lengths (at most ``capacity`` counts) reaches the driver.
A pattern says how many pieces of each length one sequence holds; the program
asks for the least total of patterns, each taken any fraction of times, that
covers the histogram.

1. Multiplicative weights: a length's weight is the exponential of how far its
   coverage so far is behind (or ahead of) its share. In each round one knapsack
   dynamic program prices all patterns by these weights, and its table gives, for
   each length that is behind, the best pattern that holds this length. It is
   taken, by the fraction that catches up, if its price is within a slack of the
   best pattern's: only (nearly) best answers count, so lengths that fit badly
   wait until their weight has grown. What is behind at the end is made up for.
2. The weights of a round over the best pattern's price are a dual solution, so
   they give a lower bound. Phases of more and more rounds begin with the weights
   of the one before and end once the fractional total is within ``GAP`` of it.
3. Rounding: every pattern its whole number of times, then, in the order of the
   fractions left, once more where all of its pieces are left and it fills no less than the mean. What remains is a
   smaller histogram with a program of its own; after ``RESIDUALS`` of these best
   fit (the longest piece, then the longest that still fits) places the rest.
4. Pieces of a length are numbered without gaps from partition counts, and the
   plan turns (length, number) into a sequence and an offset.

Defined cases: an empty table gives an empty plan; lengths outside
1..capacity are an error of the caller; repeated rows are pieces of their own;
null and empty texts are pieces of the end id alone; columns of the caller that
are named like a result are replaced by it.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .bpe_codec import library_encoder, rank_file
from .common import cut, documents, in_batches, unused

CAPACITY = 2048
#: Phases: rounds, the rate at which weights grow or fall for each round that a length is behind or ahead, and how far a
#: pattern's price may be below the best.
PHASES = ((8, 0.15, 0.01), (16, 0.15, 0.01), (24, 0.5, 0.0005), (32, 0.15, 0.01), (64, 0.5, 0.0005))
#: Tables of patterns in a round, as lengths run out; the part by which the fractional total may exceed its bound; programs for what rounding leaves.
TABLES, GAP, RESIDUALS = 8, 0.002, 1

# --------------------------------------------------------------------------
# The plan


class Knapsack:
    """Patterns of the highest price that hold each length no more than ``most`` times, for every room up to ``capacity``."""

    def __init__(self, length: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int):
        self.length = length
        # a length's pieces as items of 1, 2, 4, ... pieces; the longest first, so that they win ties
        items = []
        for k in range(len(length) - 1, -1, -1):
            left, n = int(min(most[k], capacity // length[k])), 1
            while left > 0:
                items.append((k, min(n, left)))
                left -= n
                n *= 2
        self.item, self.pieces = np.array(items, np.int64).reshape(-1, 2).T
        self.best = np.zeros(capacity + 1)
        took = np.zeros((len(items), capacity + 1), bool)
        for i, (k, n) in enumerate(items):
            size = int(length[k]) * n
            with_it, without = self.best[: capacity + 1 - size] + price[k] * n, self.best[size:]
            np.greater(with_it, without + 1e-9, out=took[i, size:])
            np.maximum(with_it, without, out=without)
        self.took = np.ascontiguousarray(took.T)

    def pattern(self, room: int) -> dict[int, int]:
        """Pieces of each length (by place) in the best pattern for this room."""
        out: dict[int, int] = {}
        before = len(self.item)
        while room > 0 and before:
            taken = self.took[room, :before][::-1]
            back = int(taken.argmax())
            if not taken[back]:
                break
            before -= 1 + back
            k, n = int(self.item[before]), int(self.pieces[before])
            out[k] = out.get(k, 0) + n
            room -= int(self.length[k]) * n
        return out


Runs = list[tuple[dict[int, int], int]]


Pattern = tuple[tuple[int, int], ...]


@dataclass
class Fractional:
    """A solution of the program: how often each pattern (place of a length, pieces) is taken, and a lower bound of any solution's total."""

    taken: dict[Pattern, float]
    bound: float

    @property
    def total(self) -> float:
        return sum(self.taken.values())


class Table:
    """The best pattern for every room, of lengths that may be taken any number of times."""

    def __init__(self, length: np.ndarray, price: np.ndarray, capacity: int):
        self.length, self.best, self.choice = length, np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(length, np.arange(capacity + 1), "right")
        for room in range(1, capacity + 1):
            self.best[room] = self.best[room - 1]
            if n := upto[room]:
                worth = self.best[room - length[:n]] + price[:n]
                k = int(worth.argmax())
                if worth[k] > self.best[room] + 1e-12:
                    self.best[room], self.choice[room] = worth[k], k

    def pattern(self, room: int) -> dict[int, int]:
        """Pieces of each length (by place) in the best pattern for a room."""
        out: dict[int, int] = {}
        while room > 0:
            k = int(self.choice[room])
            if k < 0:
                room -= 1
                continue
            out[k] = out.get(k, 0) + 1
            room -= int(self.length[k])
        return out


def fractional(length: np.ndarray, count: np.ndarray, capacity: int, phases: tuple[tuple[int, float, float], ...] = PHASES, gap: float = GAP) -> Fractional:
    """The configuration program by multiplicative weights; lengths ascend, counts are positive.

    The width of a step is bounded: no length is covered beyond its count.
    """
    weight, most = np.log(length / capacity), count.astype(float)  # at first patterns are worth what they fill
    best, bound = None, 0.0
    for rounds, rate, slack in phases:
        begin, left, taken = weight, most.copy(), {}
        for t in range(1, rounds + 1):
            price = np.exp(weight - weight.max())
            top = float(Table(length, price, capacity).best[capacity])
            bound = max(bound, float(price @ count) / top)
            due = most * (1 - t / rounds)  # what may be left after this round
            late = np.flatnonzero(left > due + 1e-9)[::-1]
            least = (1 - slack) * top if t < rounds else 0.0  # in the last round all is taken
            for _ in range(TABLES):
                live = np.flatnonzero(left > 1e-9)
                table, again = Table(length[live], price[live], capacity), []
                for k in late.tolist():
                    if left[k] <= due[k] + 1e-9:
                        continue
                    items = [(int(live[j]), n) for j, n in table.pattern(capacity - int(length[k])).items()]
                    pattern = dict(items)
                    pattern[k] = pattern.get(k, 0) + 1
                    if sum(price[j] * n for j, n in pattern.items()) < least:
                        continue  # it waits until its weight has grown
                    times = min((left[k] - due[k]) / pattern[k], min(left[j] / n for j, n in pattern.items()))
                    if times > 1e-12:
                        key = tuple(sorted(pattern.items()))
                        taken[key] = taken.get(key, 0.0) + times
                        for j, n in pattern.items():
                            left[j] = max(0.0, left[j] - times * n)
                    if left[k] > due[k] + 1e-9:
                        again.append(k)
                late = np.array(again, np.int64)
                if not len(late):
                    break
            weight = begin - rate * np.clip((due - left) / most * rounds, -40, 40)
        for k in np.flatnonzero(left > 1e-9)[::-1].tolist():  # alone with others that are left
            while left[k] > 1e-9:
                pattern, room = {k: 1}, capacity - int(length[k])
                for j in np.flatnonzero(left > 1e-9)[::-1].tolist():
                    if (n := min(room // int(length[j]), int(np.ceil(left[j] - 1e-9)) - pattern.get(j, 0))) > 0:
                        pattern[j] = pattern.get(j, 0) + n
                        room -= n * int(length[j])
                times = min(max(left[j] / n, 1e-9) for j, n in pattern.items())
                key = tuple(sorted(pattern.items()))
                taken[key] = taken.get(key, 0.0) + times
                for j, n in pattern.items():
                    left[j] = max(0.0, left[j] - times * n)
        now = Fractional(taken, bound)
        if best is None or now.total < best.total:
            best = now
        best.bound = bound
        if best.total <= bound * (1 + gap):
            break
    return best


def _rounded(length: np.ndarray, taken: dict[Pattern, float], left: np.ndarray) -> Runs:
    """Patterns by whole numbers, as far as their pieces are left; ``left`` is lowered. Fractions are rounded up for patterns that fill no less than the mean."""
    runs: Runs = []
    fill = {pattern: sum(int(length[k]) * n for k, n in pattern) for pattern in taken}
    mean = sum(x * fill[p] for p, x in taken.items()) / max(sum(taken.values()), 1e-12)

    def use(pattern: Pattern, most: int) -> None:
        times = min(most, *(int(left[k]) // n for k, n in pattern))
        if times > 0:
            for k, n in pattern:
                left[k] -= times * n
            runs.append((dict(pattern), times))

    for pattern, x in sorted(taken.items(), key=lambda p: (-p[1], p[0])):
        use(pattern, int(x + 1e-9))
    for pattern, x in sorted(taken.items(), key=lambda p: (-(p[1] % 1), p[0])):
        if fill[pattern] >= mean * (1 - 1e-9):
            use(pattern, 1)
    return runs


@dataclass
class Plan:
    """Runs of pieces: from number ``first`` on, pieces of ``length`` go to sequences
    from ``sequence`` on, ``each`` to one, the first of these at ``offset``.

    of_program: sequences that come from the program's patterns, the others from
    best fit; bound: no plan has fewer sequences; fractional: the program's total
    before rounding.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int
    of_program: int = 0
    bound: int = 0
    fractional: float = 0.0

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 44 | self.first
        at = np.searchsorted(key, length.astype(np.int64) << 44 | number, "right") - 1
        rest = number - self.first[at]
        return self.sequence[at] + rest // self.each[at], self.offset[at] + rest % self.each[at] * length


def _generated(length: np.ndarray, count: np.ndarray, capacity: int) -> tuple[Runs, np.ndarray, float]:
    """The same by column generation: a basis of one pattern for each length, its weights rounded down, and the program's value."""
    n = len(length)
    basis = np.diag(capacity // length)
    inverse = np.diag(1.0 / np.diag(basis))
    weight = inverse @ count
    bound = 0.0
    for _ in range(PIVOTS):
        price = np.maximum(inverse.sum(0), 0)
        sack = Knapsack(length, price, np.full(n, capacity), capacity)
        bound = max(bound, float(price @ count) / float(sack.best[capacity]))
        if sack.best[capacity] <= 1 + 1e-9:
            break
        pattern = np.zeros(n)
        for k, times in sack.pattern(capacity).items():
            pattern[k] = times
        step = inverse @ pattern
        k = int(np.argmin(np.where(step > 1e-9, np.maximum(weight, 0) / np.maximum(step, 1e-9), np.inf)))
        inverse[k] /= step[k]
        weight[k] /= step[k]
        others = np.arange(n) != k
        inverse[others] -= np.outer(step[others], inverse[k])
        weight[others] -= step[others] * weight[k]
        basis[:, k] = pattern
    left, runs = count.copy(), []
    # a weight just below a whole number is that number; no pattern takes more than is left
    for negative, pattern in sorted((-w, tuple(p.tolist())) for w, p in zip(weight + 1e-6, basis.T) if w >= 1):
        column = np.array(pattern, np.int64)
        used = np.flatnonzero(column)
        times = int(min(-negative, (left[used] // column[used]).min()))
        if times:
            left -= times * column
            runs.append((dict(zip(used.tolist(), column[used].tolist())), times))
    return runs, left, bound


def _best_fit(length: np.ndarray, left: np.ndarray, capacity: int) -> Runs:
    """Sequences for what is left: the longest piece, then what of the rest fills its sequence best."""
    left, runs = left.copy(), []
    while left.any():
        live = np.flatnonzero(left)
        here = length[live]
        room = capacity - int(here[-1])
        pattern = {len(live) - 1: 1}
        if n := int(np.searchsorted(here, room, "right")):
            most = left[live[:n]] - (np.arange(n) == len(live) - 1)
            for k, m in Knapsack(here[:n], here[:n].astype(float), most, room).pattern(room).items():
                pattern[k] = pattern.get(k, 0) + m
        at, m = live[list(pattern)], np.array(list(pattern.values()))
        times = int((left[at] // m).min())
        left[at] -= times * m
        runs.append((dict(zip(at.tolist(), m.tolist())), times))
    return runs


def solve(length: np.ndarray, count: np.ndarray, capacity: int = CAPACITY, phases: tuple[tuple[int, float, float], ...] = PHASES) -> Plan:
    """A plan for a histogram of lengths."""
    order = np.argsort(length)
    length, count = np.asarray(length, np.int64)[order], np.asarray(count, np.int64)[order]
    sequences = lambda r: sum(times for _, times in r)
    runs: Runs = []
    bound, total, left = float(max(-(-int(length @ count) // capacity), count[2 * length > capacity].sum())), 0.0, count.copy()
    for turn in range(1 + RESIDUALS):
        live = np.flatnonzero(left)
        if not len(live):
            break
        solution = fractional(length[live], left[live], capacity, phases if not turn else phases[:1])
        if not turn:
            bound, total = max(bound, solution.bound), solution.total
        rest = left[live]
        runs += [({int(live[k]): n for k, n in pattern.items()}, times) for pattern, times in _rounded(length[live], solution.taken, rest)]
        left[live] = rest
    rest = _best_fit(length, left, capacity)
    rows = []
    given = np.zeros(len(length), np.int64)
    at = 0
    for pattern, times in runs + rest:
        offset = 0
        for k in sorted(pattern, reverse=True):
            rows.append((int(length[k]), int(given[k]), at, pattern[k], offset))
            given[k] += pattern[k] * times
            offset += pattern[k] * int(length[k])
        at += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), sequences=at, of_program=sequences(runs), bound=int(np.ceil(bound - 1e-6)), fractional=total)


# --------------------------------------------------------------------------
# Pieces

PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("_task", T.IntegerType(), False),
        T.StructField("_nth", T.LongType(), False),
    ]
)


def _running(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each row among the rows of its length so far; ``seen`` goes on."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else ordered
    out = np.zeros(len(length), np.int64)
    size = np.diff(np.append(head, len(ordered)))
    out[order] = np.arange(len(ordered)) - np.repeat(head, size) + seen[ordered]
    seen[ordered[head]] += size
    return out


def cut_pieces(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of every text's ids (with the end id): the first may be shorter, all others have ``capacity`` ids."""
    kept = [c for c in df.columns if c not in (text, *PIECES.names, "ids")]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] if with_ids else []
    schema = T.StructType([df.schema[c] for c in kept] + PIECES.fields + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encoder = library_encoder(tokenizer_path)
        pid = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in in_batches(batches, text, 2_000_000):
            found, count = encoder.encode(batch.column(text).to_pylist())
            ids = np.insert(found, np.cumsum(count), end_id).astype("<u4")  # the end id after each text
            count = count + 1
            begin = np.cumsum(count) - count
            pieces = -(-count // capacity)
            row = np.repeat(np.arange(len(count)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = count - (pieces - 1) * capacity
            start = np.where(number, first[row] + (number - 1) * capacity, 0)
            length = np.where(number, capacity, first[row])
            at = (begin[row] + start).tolist()
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist())]
            new = [
                pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                pa.array(np.full(len(row), pid, np.int32)), pa.array(_running(length, seen)),
            ]
            if with_ids:
                new.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(index) for c in kept), *new], names=[*kept, *schema.names[len(kept) :]]
            )

    return df.select(*kept, text).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give pieces (a written table with ``length``, and ``_task``, ``_nth`` as ``cut_pieces`` gives them) a ``sequence_id`` and an ``offset``.

    An empty table gives no rows; a null length is an error.
    """
    counts = cut(pieces.groupBy("_task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    plan = solve(np.array([r.length for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each length of a task: it grows with the input, so it is joined by a shuffle of both sides, never broadcast
    base = counts.select("_task", "length", F.coalesce(before, F.lit(0)).alias("_base")).hint("merge")
    names = [c for c in pieces.columns if c not in ("_task", "_nth", "sequence_id", "offset")]
    schema = T.StructType(
        [pieces.schema[c] for c in names] + [T.StructField(c, T.LongType(), False) for c in ("sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column(number).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    (number,) = unused(pieces, "_number")
    joined = pieces.join(base, ["_task", "length"]).select(*names, (F.col("_nth") + F.col("_base")).alias(number))
    return joined.mapInArrow(run, schema)


def pack_texts(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack the column ``text`` of ``df``."""
    return pack(cut(cut_pieces(df, tokenizer_path, capacity), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place every document's pieces in as few sequences as the program finds."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pack_texts(docs, rank_file("byte_bpe_50k.json"))
