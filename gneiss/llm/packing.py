"""Best-fit packing of token pieces into sequences of a fixed capacity.

The lengths' histogram (at most `capacity` rows, whatever the corpus) goes to the driver. There a configuration linear
program over the lengths is solved by multiplicative weights, priced by a knapsack dynamic program, until its value is within
`tolerance` of the bound that the prices prove. Its amounts are rounded, the program is solved again over what
rounding has left, and what is left in the end goes best-fit into the remaining gaps. The result is a plan of
runs: "items r0..r1 of length n go to sequences s0.. at offset o". Spark ranks the pieces within their length by prefix sums
over partitions and reads each place off the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder
from .common import settle, table

CAPACITY = 2048
#: Fractions of a configuration from which it is rounded up, in the order in which they are tried.
THRESHOLDS = (1.0, 0.9, 0.75, 0.6, 0.5)
#: A share of the sequences that is not worth another threshold: below a thousand sequences none.
CLOSE = 0.001
#: A share of the sequences that classes of lengths may cost; above it the grain is halved.
COARSE = 0.1
Config = tuple[tuple[int, int], ...]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; only the first may be shorter than the capacity when a text is cut."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: the id, piece, start, length, ids_crc32 (and ids as bytes), task, local_rank.

    A null text counts as empty (one piece: the end id); repeated rows and null ids are documents of their own. An added
    token's string in a text has that token's id. local_rank
    numbers the pieces of one length within a task, from 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task int, local_rank long" + ", ids binary" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary, added=True), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), defaultdict(int)
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = (enc.ids(text) if text else b"") + end
                for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, zlib.crc32(own), task, seen[length], own))
                    at.append(i)
                    seen[length] += 1
            cols = [*zip(*rows, strict=True)] if rows else [()] * 7
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [id_col, "piece", "start", "length", "ids_crc32", "task", "local_rank", "ids"][: 7 + with_ids]
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: 7 + with_ids], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


class _Knapsack:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of sizes within each room up to `room`."""

    def __init__(self, value: np.ndarray, sizes: np.ndarray, room: int):
        self.sizes = sizes
        self.best, self.pick = np.zeros(room + 1), np.full(room + 1, -1)
        upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
        for c in range(1, room + 1):
            self.best[c] = self.best[c - 1]
            if (k := int(upto[c])) and (got := self.best[c - sizes[:k]] + value[:k])[j := int(got.argmax())] > self.best[c]:
                self.best[c], self.pick[c] = got[j], j

    def config(self, c: int, *start: int) -> Config:
        """The best multiset within c, and the classes given."""
        counts = Counter(start)
        while c > 0:
            if (j := int(self.pick[c])) < 0:
                c -= 1
            else:
                counts[j] += 1
                c -= int(self.sizes[j])
        return tuple(sorted(counts.items(), reverse=True))


def solve_configurations(demand: np.ndarray, sizes: np.ndarray, room: int, *, tolerance: float = 0.01, passes: int = 12, columns: int = 256, rate: float = 0.5) -> tuple[dict[Config, float], float]:
    """Fractional configurations that make up `demand` exactly, and a lower bound on the sum of any such (the best of all dual prices).

    Multiplicative weights in passes. In a pass the classes' prices are fixed and those with demand left are priced by one knapsack
    after another; the best configuration, and the best ones with each of the largest `columns` classes, are taken as far as demand
    lasts. The last part of the demand, a small share of `tolerance`, is made up of configurations of one class. After a pass a class's price grows by exp(rate * w), with w the share of room that went empty beside it, so the classes
    that were hard to place are placed earlier. It ends when the best pass is within `tolerance` of the bound.
    """
    price = (sizes / room) ** 1.05
    least, best, bound = np.inf, {}, float(demand @ sizes) / room
    for _ in range(passes):
        left, used, waste = demand.astype(float), defaultdict(float), np.zeros(len(sizes))
        while float(left @ sizes) > 0.3 * tolerance * float(demand @ sizes):
            open_ = np.flatnonzero(left > 1e-9)
            sack = _Knapsack(price[open_], sizes[open_], room)
            if open_.size == len(sizes):
                bound = max(bound, float(price @ demand) / sack.best[room])
            found = [sack.config(room)] + [sack.config(room - int(sizes[open_[j]]), j) for j in range(len(open_) - 1, max(-1, len(open_) - 1 - columns), -1)]
            for config in dict.fromkeys(found):
                own = tuple((int(open_[j]), k) for j, k in config)
                amount = min(left[j] / k for j, k in own)
                if amount <= 1e-9:
                    continue
                if amount > 1:
                    amount = float(int(amount + 1e-9))
                used[own] += amount
                empty = 1 - sum(int(sizes[j]) * k for j, k in own) / room
                for j, k in own:
                    left[j] -= amount * k
                    waste[j] += amount * k * empty
        for j in np.flatnonzero(left > 1e-9).tolist():
            used[(j, room // int(sizes[j])),] += left[j] / (room // int(sizes[j]))
        if (total := sum(used.values())) < least:
            least, best = total, dict(used)
        if least <= bound * (1 + tolerance):
            break
        price = price * np.exp(rate * waste / demand)
    return best, bound


class _Plan:
    """Runs of equal placements, kept by ranges of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = dict(counts), capacity
        self.next_rank, self.sequences = defaultdict(int), 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.by_program = 0

    def put(self, length: int, first: int, n: int, used: int) -> None:
        """n items of one length, one each to sequences first.. at offset `used`."""
        self.runs.append((length, self.next_rank[length], n, first, used))
        self.next_rank[length] += n
        self.left[length] -= n

    def keep(self, first: int, n: int, used: int) -> None:
        if n and used < self.capacity:
            gap = self.capacity - used
            if not self.open[gap]:
                insort(self.gaps, gap)
            self.open[gap].append((first, n))

    def fill(self, config: list[list[int]], n: int) -> None:
        """n new sequences; for each slot, its class's lengths, longest first, as long as there are any."""
        n = min(n, max((sum(self.left[x] for x in lengths) for lengths in config), default=0))  # no sequence stays empty
        ranges = [(self.sequences, n, 0)]
        self.sequences += n
        for lengths in config:
            after = []
            for first, m, used in ranges:
                for length in lengths:
                    if (k := min(m, self.left[length])) and used + length <= self.capacity:
                        self.put(length, first, k, used)
                        after.append((first, k, used + length))
                        first, m = first + k, m - k
                if m:
                    after.append((first, m, used))
            ranges = after
        for x in ranges:
            self.keep(*x)

    def best_fit(self) -> None:
        """What is left, longest first, into the smallest gap that holds it, or new sequences."""
        for length in sorted(self.left, reverse=True):
            while left := self.left[length]:
                if (i := bisect_left(self.gaps, length)) < len(self.gaps):
                    gap = self.gaps[i]
                    first, n = self.open[gap].pop()
                    if not self.open[gap]:
                        self.gaps.pop(i)
                    k, used = min(n, left), self.capacity - gap
                    self.put(length, first, k, used)
                    self.keep(first, k, used + length)
                    self.keep(first + k, n - k, used)
                else:
                    each = self.capacity // length
                    full, rest = divmod(left, each)
                    for n, times in ((full, each), (1, rest)):
                        if n and times:
                            for t in range(times):
                                self.put(length, self.sequences, n, t * length)
                            self.keep(self.sequences, n, times * length)
                            self.sequences += n


def _program(plan: _Plan, classes: dict[int, list[int]], room: int) -> tuple[dict[Config, float], np.ndarray, float]:
    """The program's configurations for what the plan has left, the sizes that they are of, and the bound on its sequences."""
    left = {s: n for s in sorted(classes) if (n := sum(plan.left[x] for x in classes[s]))}
    sizes = np.array(list(left), dtype=np.int64)
    if not len(sizes) or sizes[-1] > room:
        return {}, sizes, 0.0
    used, bound = solve_configurations(np.array(list(left.values()), dtype=float), sizes, room)
    return used, sizes, bound


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, *, grain: int = 1, rounds: int = 3) -> _Plan:
    """A plan that places every item; by_program: how many of them stand in configurations of the program.

    Lengths are classed by `grain` tokens, rounded up, or by half of it if that costs too much. The amounts of configurations are rounded: up where the fraction is at least a threshold
    (a configuration that demand no longer fills keeps the gap), else down. The program is solved again for the items that this leaves,
    `rounds` times at most; best fit places the last ones into the gaps of configurations and, where none is left, into new sequences.
    Of several thresholds, the one that needs the fewest sequences is taken; a plan within CLOSE of the program's bound ends the search.
    """
    classes: dict[int, list[int]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        classes[-(-length // grain)].append(length)
    room = capacity // grain
    first, sizes, bound = _program(_Plan(counts, capacity), classes, room)
    if grain > 1:  # the program's bound is that of the classes, not of the lengths
        bound = sum(length * n for length, n in counts.items()) / capacity
    best = None
    for threshold in THRESHOLDS:
        plan, used, of = _Plan(counts, capacity), first, sizes
        for k in range(rounds):
            if k:
                used, of, _ = _program(plan, classes, room)
            whole = [(n, config) for config, amount in used.items() if (n := int(amount + 1 - threshold + 1e-9))]
            for n, config in sorted(whole, key=lambda x: (-x[0], x[1])):
                plan.fill([classes[int(of[j])] for j, c in config for _ in range(c)], n)
            if not whole:
                break
        plan.by_program = sum(counts.values()) - sum(plan.left.values())
        plan.best_fit()
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= ceil(bound - 1e-6) * (1 + CLOSE):
            break
    if grain > 1 and best.sequences > (1 + COARSE) * bound:
        return min(best, make_plan(counts, capacity, grain=grain // 2, rounds=rounds), key=lambda plan: plan.sequences)
    return best


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY, *, grain: int = 1) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, items, first sequence, offset) runs that place every item, and the number of sequences."""
    plan = make_plan(counts, capacity, grain=grain)
    return plan.runs, plan.sequences


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a settled table with length, task and local_rank).

    Only the histogram of lengths goes to the driver, and only the plan, bounded by the number of lengths and
    configurations, comes back. Pieces are ranked by (length, task) with sums over tasks before, not by one sort.
    """
    by_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    runs.sort()
    length, rank, _, sequence, offset = (np.array(x, dtype=np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 5))
    keys = length * (1 << 48) + rank

    @F.pandas_udf("sequence_id long, offset long")
    def place(n, r):
        import pandas as pd

        i = np.searchsorted(keys, n.to_numpy(dtype=np.int64) * (1 << 48) + r.to_numpy(dtype=np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[i] + r.to_numpy(dtype=np.int64) - rank[i], "offset": offset[i]})

    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = found.join(before, ["task", "length"]).withColumn("at", place("length", F.col("before") + F.col("local_rank")))
    return ranked.select("*", "at.sequence_id", "at.offset").drop("at", "before", "task", "local_rank")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document, tokenised, ended and cut, with its place in a sequence; see `pieces` for nulls and repeated rows. An empty table gives no rows."""
    found = settle(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids), "pieces")
    return pack(found, capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
