"""Periodic runs of words, found on a grammar of each document.

Re-Pair names the words of a document and replaces repeated pairs of neighbours by nonterminals until no pair repeats. A round replaces the most frequent pair
of every document of a block and, with it, each pair that is more frequent than those that overlap it. So every gap between two words is
the boundary of one node of the derivation: of an occurrence of a nonterminal, or of the start rule. A nonterminal's boundary is looked at once, in the first place
where the nonterminal stands; the gaps of its other places are left out.

Runs that cross a boundary: for periods q in (L / 2, L], L = 1, 2, 4, ..., the windows of L words around the boundaries are grouped by hash. Two neighbouring
occurrences q apart make a stretch of period q, which a binary search over prefix hashes extends to both sides. What crosses a boundary
is cut to its nonterminal; if enough is left it goes to every place where the nonterminal stands. A run of `times` periods lies in some lowest node, whose boundary it crosses,
and holds two windows there q apart, as times >= 3. Intervals of one period that overlap by a period are merged, so that what nodes have cut is put together.

Words, symbols and windows are compared by hashes of 64 bits that belong to one document. Nothing is shuffled: a document's text is one row, and blocks of
rows of a few MB are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm import hashing
from corpusgrid.llm.common import read
from corpusgrid.llm.common import words as words_of
from corpusgrid.llm.tokens import slices

TIMES, LEAST, BLOCK_BYTES = 4, 6, 6 << 20
TOP, LEFT_OUT = -1, -2  # gaps of the start rule; gaps of nonterminals that are looked at elsewhere, or are too short for a run
_BASE, _U = 0x9E3779B97F4A7C15, np.uint64
_BYTES = np.arange(256, dtype=np.uint8)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of `keys` by key, equal ones in order of place; and whether each begins a new key."""
    n = len(keys)
    bits = _U(max(1, (n - 1).bit_length()))
    low = (_U(1) << bits) - _U(1)
    packed = (keys & ~low) | np.arange(n, dtype=np.uint64)  # one fast sort of integers
    packed.sort()
    order = (packed & low).astype(np.int64)
    by = keys[order]
    new = np.append(True, by[1:] != by[:-1])[:n]
    if n and (new[1:] & (packed[1:] >> bits == packed[:-1] >> bits)).any():  # two keys that only differ in the low bits
        order = np.argsort(keys, kind="stable")
        by = keys[order]
        new = np.append(True, by[1:] != by[:-1])
    return order, new


class Grammar:
    """Re-Pair of a block of documents. `gap[b]`: TOP, LEFT_OUT, or the nonterminal whose boundary before word b is to be looked at. A nonterminal k fills [begin[k], end[k])
    where it stands first; all its places are `place[of[k] : of[k + 1]]`."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray, least: int = LEAST) -> None:
        n = len(symbols)
        self.gap = np.full(n, TOP, np.int64)
        begin, end, names, places, count = [], [], [], [], 0
        at, to = np.arange(n), np.arange(1, n + 1)  # the words that a symbol stands for
        while len(symbols) > 1:
            keys = hashing.mix(symbols[:-1] * _U(_BASE) + hashing.mix(symbols[1:]))
            beside = doc[1:] == doc[:-1]
            order, new = grouped(keys)
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(keys)))
            often = np.empty(len(keys), np.int64)
            often[order] = np.repeat(size, size)
            often[~beside] = 0
            often[often < 2] = 0
            # a pair is replaced where it is more frequent than the pairs that overlap it (ties: by key); of a stretch of one pair (a a a), every second
            equal = np.append(False, (keys[1:] == keys[:-1]) & beside[1:] & beside[:-1])
            start = np.maximum.accumulate(np.where(equal, 0, np.arange(len(keys))))
            more = (often[1:] > often[:-1]) | (often[1:] == often[:-1]) & (keys[1:] > keys[:-1])  # than the one before
            chosen = (often > 0) & ((np.arange(len(keys)) - start) % 2 == 0)
            chosen[1:] &= equal[1:] | more
            chosen[:-1] &= equal[1:] | ~more
            pick = np.flatnonzero(chosen)
            if not len(pick):
                break
            _, first, which = np.unique(keys[pick], return_index=True, return_inverse=True)
            long = to[pick[first] + 1] - at[pick[first]] >= least
            number = np.where(long, count + np.cumsum(long) - 1, LEFT_OUT)  # of each nonterminal of this round
            self.gap[at[pick + 1]] = LEFT_OUT
            self.gap[at[pick[first] + 1]] = number
            begin.append(at[pick[first]][long])
            end.append(to[pick[first] + 1][long])
            worth = long[which]
            names.append(number[which][worth])
            places.append(at[pick][worth])
            count += int(long.sum())
            symbols = symbols.copy()
            symbols[pick] = hashing.mix(keys[pick] ^ _U(0xA0761D6478BD642F))
            to = to.copy()
            to[pick] = to[pick + 1]
            keep = np.ones(len(symbols), bool)
            keep[pick + 1] = False
            active = np.zeros(int(doc[-1]) + 1, bool)  # documents without a repeated pair are done
            active[doc[pick]] = True
            keep &= active[doc]
            symbols, doc, at, to = symbols[keep], doc[keep], at[keep], to[keep]
        none = np.zeros(0, np.int64)
        self.begin, self.end = np.concatenate([none, *begin]), np.concatenate([none, *end])
        name, place = np.concatenate([none, *names]), np.concatenate([none, *places])
        order = np.argsort(name, kind="stable")
        self.place, self.of = place[order], np.searchsorted(name[order], np.arange(count + 1))


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes, one after another: each member's group, and its number in it."""
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals: those of one period that overlap by a period at least are one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    lift = np.cumsum(np.append(0, period[1:] != period[:-1])) * (int(end.max()) + 1)  # the furthest end so far, by period
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.append(True, (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:]))
    heads = np.flatnonzero(new)
    return start[heads], np.maximum.reduceat(end, heads), period[heads]


def find_runs(hashes: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of the documents whose words are hashes[first[d] : first[d + 1]], by start and period; starts count from the block's first word."""
    if times < 3:
        raise ValueError("runs of fewer than 3 periods are not looked for")
    n = len(hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    symbols = hashing.mix(hashes ^ hashing.mix(doc.astype(np.uint64) + _U(1)))  # equal within a document only
    grammar = Grammar(symbols, doc, least)
    lo, hi = first[doc], first[doc + 1]
    examined = grammar.gap != LEFT_OUT
    examined[first[:-1][first[:-1] < n]] = False  # no gap before a document's first word
    before = np.append(0, np.cumsum(examined))  # examined gaps before word b
    sums, up = hashing._sums(symbols, _BASE)

    def window(at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (sums[at + size] - sums[at]) * up[at + size]

    def extent(at: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words from `at` on (or, with step -1, before `at`) equal those q further on, at most `most`."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            size = (low + high + 1) // 2
            here = at if step > 0 else at - size
            same = window(here, size) == window(here + q, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low

    found: list[tuple[np.ndarray, ...]] = []
    length, active = 1, np.arange(n)
    while True:
        active = active[(active + length <= hi[active]) & (hi[active] - lo[active] >= times * (length // 2 + 1))]
        near = active[before[np.minimum(active + 2 * length, n)] > before[np.maximum(active - length + 1, 0)]]  # as the first or the second of two windows at most `length` apart around a boundary
        if len(near) < 2:
            break
        order, new = grouped(hashing.mix(window(near, length)))
        by = near[order]
        again = ~new[1:]  # the next of the same window
        gap = by[1:] - by[:-1]
        close = again & (gap <= length) & (gap > length // 2)
        j, q = by[:-1][close], gap[close]
        if len(j):
            order = np.argsort(j)
            j, q = j[order], q[order]
            heads = np.flatnonzero(np.append(True, (j[1:] != j[:-1] + 1) | (q[1:] != q[:-1])))
            last = np.append(heads[1:], len(j)) - 1
            start, end, q = j[heads], j[last] + length + q[heads], q[heads]
            end = end + extent(end - q, q, hi[start] - end, 1)
            start = start - extent(start, q, start - lo[start], -1)
            fits = end - start >= np.maximum(least, times * q)
            found.append((start[fits], end[fits], q[fits]))
        # a longer window is looked at only if its first and last part repeat; any repeat within the document counts, near a boundary or not
        if len(near) < len(active):
            order, new = grouped(hashing.mix(window(active, length)))
            by, again = active[order], ~new[1:]
        repeats = np.zeros(n + 1, bool)
        repeats[by[:-1][again]] = repeats[by[1:][again]] = True
        active = np.flatnonzero(repeats[:n])
        active = active[active + length < n]
        active = active[repeats[active + length]]
        length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    stretch = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
    start, end, q = stretch[:, 0], stretch[:, 1], stretch[:, 2]
    # the boundaries that each crosses: those of the start rule see all of it, a nonterminal's only its own part
    group, step = _spread(end - start - 1)
    b = start[group] + 1 + step
    node = grammar.gap[b]
    top = np.unique(group[node == TOP])
    inner = node >= 0
    group, node = group[inner], node[inner]
    s, e, p = np.maximum(start[group], grammar.begin[node]), np.minimum(end[group], grammar.end[node]), q[group]
    fits = e - s >= np.maximum(least, times * p)
    s, e, p, node = s[fits], e[fits], p[fits], node[fits]
    copy, step = _spread(grammar.of[node + 1] - grammar.of[node])  # to all places of the nonterminal
    shift = grammar.place[grammar.of[node][copy] + step] - grammar.begin[node[copy]]
    s, e, p = _merged(np.concatenate([start[top], s[copy] + shift]), np.concatenate([end[top], e[copy] + shift]), np.concatenate([q[top], p[copy]]))
    return _least_periods(s, e, p)


def _least_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs by start and period, without those that a run of a smaller period, a divisor of theirs, holds: windows between two neighbours may not have been looked at."""
    order = np.lexsort((period, -end, start))
    keep, held = np.ones(len(start), bool), []
    for i in order:
        held = [k for k in held if end[k] > start[i]]  # few runs of different periods hold one word
        keep[i] = not any(end[k] >= end[i] and period[i] % period[k] == 0 and period[k] < period[i] for k in held)
        if keep[i]:
            held.append(i)
    kept = order[keep[order]]
    kept = kept[np.lexsort((period[kept], start[kept]))]
    return start[kept], end[kept], period[kept]


def collapse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space; `data` has a byte behind every word."""
    size = (ends - starts + 1)[keep]
    to = np.append(0, np.cumsum(size))
    out = data[np.repeat(starts[keep] - to[:-1], size) + np.arange(to[-1])]
    out[to[1:] - 1] = 0x20
    at = to[np.append(0, np.cumsum(keep))[first]]
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: by start and period), collapsed: a row for each row of `docs`.

    A run is a stretch of words with smallest period q, of max(least, times * q) words at least (times >= 3), which no neighbouring word extends. `collapsed` is the text without the words that
    a run holds after its first q, joined by one space. A text that is null, empty or white space has no words, no runs and an empty result. Rows are judged
    alone: repeated rows and ids, and null ids, come back as they are; other columns are not looked at. Nothing comes of an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, BLOCK_BYTES):
                data, begin = hashing.joined(texts.slice(a, b - a), _BYTES)
                starts, ends, hashes = hashing.words(data)
                first = np.searchsorted(starts, begin)
                s, e, p = find_runs(hashes, first, times, least)
                drop = np.zeros(len(starts) + 1, np.int64)
                np.add.at(drop, s + p, 1)
                np.add.at(drop, e, -1)
                kept = collapse(data, starts, ends, np.cumsum(drop[:-1]) == 0, first)
                of = np.searchsorted(s, first)
                own = s - first[np.searchsorted(first, s, side="right") - 1]
                fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (own, e - s, p)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(of, pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def _strongest(runs: Column) -> Column:
    """The run of greatest length / period, as a fraction; of equal ones the first."""

    def pick(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), pick)


def digest(found: DataFrame) -> DataFrame:
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.select("doc_id", "collapsed", "runs", _strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """`documents` with the repeats of the contract: in a document whose crc32 h of the id ends in the digit 0, the words from a = g % n on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    known = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    known = known.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    known = known.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a) div p + 1))), 1, int(n - a)))")
    return known.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(read(spark, sf_dir, "documents"))))
