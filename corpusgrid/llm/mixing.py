"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a fixed pseudo-random order, are cut into blocks; one block runs per slot. The target is a fluid: at every moment each source that still has
blocks is served at its weight's share among those that have. Block k of a source is released in the slot in which its fluid passes k - 1 blocks, and due by
the end of the slot in which it passes k; of the released blocks the one with the earliest deadline runs. So each source is less than one block from its
target at every slot, over the whole run, slots are never empty, and no row is dropped or repeated. Releases and deadlines come from the exact weights in
whole numbers, and nothing is rounded.

The schedule is drawn up in ranges of slots, each by a task of its own. A range needs the blocks that have run before it. Earliest-deadline-first schedules from
different states become equal once the deadlines that were open at the start have passed: while two states differ, the latest deadline of a block in
which they differ never grows, and blocks past their deadlines have run in both. So each range starts early enough from a feasible state (the fluid rounded down, then
the open blocks of the earliest deadlines), and from its first own slot on it is exactly the schedule that begins at slot 0.

A source may hold most rows, so block numbers do not come from a window over the source: rows fall into bins of a hash, as many as the source's
size asks for, bins are counted and summed up per source, and rows are numbered within their bin.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import read

BLOCK, BIN_ROWS, RANGE, MAX_SOURCES = 16, 4096, 1 << 16, 100_000


class Fluid:
    """The target: blocks served of each source, for whole positive `weights` and numbers of `blocks`."""

    def __init__(self, weights: Sequence[int], blocks: Sequence[int]) -> None:
        self.weights, self.blocks, self.total = list(weights), list(blocks), sum(blocks)
        order = sorted(range(len(weights)), key=lambda s: Fraction(blocks[s], weights[s]))
        self.ends = [Fraction(blocks[s], weights[s]) for s in order]  # virtual times at which sources run out
        self.served, self.rates, done, rate = [0], [sum(weights)], 0, sum(weights)
        for s in order:
            done, rate = done + blocks[s], rate - weights[s]
            self.served.append(done)
            self.rates.append(rate)
        self.times = [self.served[j] + self.rates[j] * end for j, end in enumerate(self.ends)]  # the same as slots

    def window(self, s: int, k: int) -> tuple[int, int]:
        """First slot in which block k (from 1) of source s may run, and the slot by whose begin it must have run."""
        w = self.weights[s]
        before, after = (bisect_right(self.ends, Fraction(x, w)) for x in (k - 1, k))
        released = self.served[before] * w + self.rates[before] * (k - 1)
        due = self.served[after] * w + self.rates[after] * k
        return released // w, -(-due // w)

    def at(self, slot: int) -> list[Fraction]:
        """Blocks of each source that the fluid has served by the begin of `slot`."""
        j = bisect_right(self.times, slot)
        if j == len(self.ends):
            return [Fraction(b) for b in self.blocks]
        v = Fraction(slot - self.served[j], self.rates[j])
        return [min(Fraction(b), w * v) for b, w in zip(self.blocks, self.weights, strict=True)]

    def reach(self, slot: int) -> int:
        """The longest window open at `slot`."""
        open_ = ((s, int(y)) for s, y in enumerate(self.at(slot)) if y < self.blocks[s])
        return max((d - slot for s, y in open_ for _, d in (self.window(s, y + 1),)), default=0)


def schedule(fluid: Fluid, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block from 0) of the slots first .. last - 1. Ties of deadlines go to the source of the smaller number."""
    begin = max(0, first)
    while begin and begin + fluid.reach(begin) > first:
        begin = max(0, min(begin - 1, 2 * begin - (begin + fluid.reach(begin))))
    state = [int(y) for y in fluid.at(begin)]
    open_ = [(fluid.window(s, n + 1), s) for s, n in enumerate(state) if n < fluid.blocks[s]]
    early = sorted((d, s) for (r, d), s in open_ if r < begin)
    for _, s in early[: begin - sum(state)]:
        state[s] += 1
    waiting = [(*fluid.window(s, n + 1), s) for s, n in enumerate(state) if n < fluid.blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for slot in range(begin, min(last, fluid.total)):
        while waiting and waiting[0][0] <= slot:
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s))
        _, s = heapq.heappop(ready)
        if slot >= first:
            yield slot, s, state[s]
        state[s] += 1
        if state[s] < fluid.blocks[s]:
            heapq.heappush(waiting, (*fluid.window(s, state[s] + 1), s))


def whole(weights: Sequence[float]) -> list[int]:
    """Whole numbers in exactly the same proportions."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(x.denominator for x in exact)) if exact else 1
    return [int(x * scale) for x in exact]


def source_rows(docs: DataFrame, source_col: str) -> dict[str | None, int]:
    """Rows of each source; one row per source comes back."""
    rows = docs.groupBy(source_col).count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer first")
    return {r[0]: r[1] for r in rows}


def stages(rows: Mapping[str | None, int], weights: Mapping[str | None, float] | None, power: float, block: int) -> list[tuple[list, Fluid]]:
    """(sources in the order of their names, null last; fluid) of the sources with a weight, then of those without one, at equal weights."""
    if weights is None:
        weights = {s: float(n) ** power for s, n in rows.items()}
    if any(not w >= 0 or w == float("inf") for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    out = []
    for some in ([s for s in rows if weights.get(s, 0) > 0], [s for s in rows if not weights.get(s, 0) > 0]):
        some.sort(key=lambda s: (s is None, s or ""))
        if some:
            out.append((some, Fluid(whole([weights.get(s) or 1.0 for s in some]), [-(-rows[s] // block) for s in some])))
    return out


def slots(spark, plan: list[tuple[list, Fluid]], slot_range: int = RANGE) -> DataFrame:
    """__number (of the source in the plan), __k, slot for every block. Each task draws up ranges of slots."""
    work, base, number = [], 0, 0
    for i, (names, fluid) in enumerate(plan):
        work += [(i, base, number, first) for first in range(0, fluid.total, slot_range)]
        base, number = base + fluid.total, number + len(names)
    fluids = [f for _, f in plan]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, base, number, first in frame.itertuples(index=False):
                got = list(schedule(fluids[i], first, first + slot_range))
                yield pd.DataFrame({"__number": [number + s for _, s, _ in got], "__k": [k for _, _, k in got], "slot": [base + t for t, _, _ in got]})

    ranges = spark.createDataFrame(work, "i int, base long, number int, first long").repartition(max(1, len(work)), "i", "first")
    return ranges.mapInPandas(run, "__number int, __k long, slot long")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, block: int = BLOCK, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", slot_range: int = RANGE, bin_rows: int = BIN_ROWS) -> DataFrame:
    """`docs` with mix_slot, mix_row (place within the block) and mix_block (block number in its source).

    Sort by (mix_slot, mix_row) for the mixed order; slots are numbered from 0 without gaps. Without `weights` these are the row counts to the `power`.
    Null sources form a source of their own. Sources of weight 0 and those that `weights` leaves out follow after the others, at equal
    weights, so that rows stay whole. Rows of equal id take neighbouring places in an undefined order. An empty table stays
    empty. Input columns of the three names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c in ("mix_slot", "mix_row", "mix_block")))
    named = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    rows = {s: n for s, n in source_rows(docs.select(F.col(source_col).cast("string").alias("s")), "s").items()}
    plan = stages(rows, weights, power, block)
    names = [s for some, _ in plan for s in some]
    known = spark.createDataFrame([("-" if s is None else f"+{s}", i, max(1, -(-rows[s] // bin_rows))) for i, s in enumerate(names)], "__name string, __number int, __bins long")

    # one exchange on (source, bin) serves the numbering and the join with the bins' slots
    hashed = docs.withColumns({"__name": named, "__hash": F.xxhash64(F.col(id_col), F.lit(seed))}).join(F.broadcast(known), "__name")  # a row for each source: at most MAX_SOURCES
    hashed = hashed.withColumn("__bin", F.pmod(F.col("__hash"), F.col("__bins")))
    counts = hashed.groupBy("__number", "__bin").count()
    before = Window.partitionBy("__number").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    counts = counts.withColumn("__k", F.explode(F.sequence(F.expr(f"__before div {block}"), F.expr(f"(__before + count - 1) div {block}"))))
    bins = counts.join(slots(spark, plan, slot_range), ["__number", "__k"]).groupBy("__number", "__bin").agg(
        F.min("__before").alias("__before"), F.transform(F.array_sort(F.collect_list(F.struct("__k", "slot"))), lambda x: x["slot"]).alias("__slots")
    )  # about bin_rows / block slots in each row
    within = Window.partitionBy("__number", "__bin").orderBy("__hash", F.col(id_col).asc_nulls_last())
    numbered = hashed.withColumn("__row", F.row_number().over(within) - 1).join(bins.hint("merge"), ["__number", "__bin"])
    numbered = numbered.withColumn("__row", F.col("__row") + F.col("__before"))
    number = F.expr(f"__row div {block}")
    slot = F.get("__slots", (number - F.expr(f"__before div {block}")).cast("int"))
    return numbered.select(*docs.columns, slot.alias("mix_slot"), F.pmod("__row", F.lit(block)).cast("long").alias("mix_row"), number.cast("long").alias("mix_block"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_slot", "mix_row", "mix_block")
