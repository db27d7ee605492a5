"""Substring dedup by level-wise doubling.

Every word in a window of `target` words that also starts in a document of smaller id is removed. Windows of half the
length come first: every target window is represented by the smallest hash among the half-length windows in it, so that
equal target windows have equal representatives, and a block sends only about a quarter of its half windows. Only where
a representative is repeated are windows extended to the full (double) length and compared again; the others cannot repeat. That answers what to remove.

From there the length is doubled until no candidates survive (`repeat_lengths`). A window of 2, 4, 8 ... times `target` words can only be repeated where all its target windows are, so
only runs of repeated target windows are kept, as texts of their own. A first pass compares windows at anchors, the places whose target window has the smallest hash within so many neighbours that every
passage of half as many words again holds one; anchors of a length are among those of the length before. It settles most documents: what a run is long enough for has then been
found. For the others every window of the lengths in question is compared, with every window elsewhere that has the same smallest target window, so no place is left out.

Texts move once, as compressed blocks of about `block_bytes` in a table that is bucketed by block, and meet the answers of the levels there. Hashes are
dealt out by their value into many more buckets than tasks, which a task works on one at a time; a block sends each hash once, however often it occurs, so a passage that stands in
a third of all documents costs one entry for each block. An answer has a bit or two for each hash, in the order in which the block has sent them. What is removed and how long repeats are is decided by 128 bits of hashes of the words; single hashes of 64 bits only choose candidates.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm import hashing
from corpusgrid.llm.common import partitions, salted_join, small_batches
from corpusgrid.session import materialise, shared_dir

TARGET, BLOCK_BYTES, BUCKETS = 13, 2 << 20, 8
SLICE = 1 << 17  # bytes of whole documents whose words are hashed at once: that takes about 80 times as much
LAST = np.iinfo(np.int64).max


def _pack(keys: np.ndarray, nulls: np.ndarray, texts: list[bytes]) -> bytes:
    import zstandard

    head = struct.pack("<q", len(texts)) + keys.tobytes() + nulls.tobytes() + np.array([len(t) for t in texts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"\n".join(texts))


class Block:
    """A block's documents, their words and windows."""

    def __init__(self, payload: bytes, target: int) -> None:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = struct.unpack_from("<q", raw)[0]
        self.keys = np.frombuffer(raw, np.int64, n, 8)
        self.nulls = np.frombuffer(raw, np.bool_, n, 8 + 8 * n)
        sizes = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.size, self.data = sizes, memoryview(raw)[8 + 17 * n :]
        cuts = [*np.unique(self.begin[np.searchsorted(self.begin, np.arange(0, self.begin[-1] + 1, SLICE))]).tolist(), len(self.data)]
        data = np.frombuffer(self.data, np.uint8)
        parts = [(s + a, w) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for s, _, w in [hashing.words(data[a:b])]]
        starts, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = np.searchsorted(starts, np.append(self.begin, len(self.data) + 1))  # each document's first word
        self.starts, self.words = starts, words
        self.windows = hashing.windows(words, target)
        doc = np.repeat(np.arange(n), np.diff(self.first))
        valid = doc[: len(self.windows)] == doc[target - 1 :] if len(doc) >= target else np.zeros(0, bool)
        self.at, self.doc = np.flatnonzero(valid), doc[: len(self.windows)][valid]
        self.windows, self.target = self.windows[valid], target

    def least(self) -> np.ndarray:
        """The representative of each window."""
        half = self.target // 2 + 1
        return hashing.sliding_min(hashing.windows(self.words, half), self.target - half + 1)[self.at]

    def repeated(self, answers: list | None, n: int) -> np.ndarray:
        """The windows whose representative is repeated."""
        least = self.least()
        hashes = np.unique(least)
        return np.flatnonzero(told(hashes, answers, n)[0][np.searchsorted(hashes, least)]) if len(hashes) else np.zeros(0, int)

    def smallest(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen windows: distinct hashes (pairs of 64 bits), the smallest document key of each, whether another document of the block has it, and the place of each window's hash among them."""
        second = hashing.windows(self.words, self.target, second=True)[self.at[chosen]]
        return keyed(pairs(self.windows[chosen], second), self.keys[self.doc[chosen]])

    def ahead(self, size: int) -> np.ndarray:
        """The windows from which a document goes on for `size` words."""
        return np.flatnonzero(self.at + size <= self.first[self.doc + 1])


def keyed(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of pairs, the smallest key of each, whether it has several keys, and the place of each row among them."""
    hashes, where = distinct(rows)
    least, most = np.full(len(hashes), LAST), np.full(len(hashes), -LAST - 1)
    np.minimum.at(least, where, keys)
    np.maximum.at(most, where, keys)
    return hashes, least, least < most, where


def pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.column_stack([one, two])


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of pairs, and the place of each row among them."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    held = rows[order]
    head = np.append(True, (held[1:] != held[:-1]).any(axis=1)) if len(held) else np.zeros(0, bool)
    where = np.empty(len(rows), np.int64)
    where[order] = np.cumsum(head) - 1
    return held[head], where


def _rows(names: dict[str, pa.DataType], **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in names.items()], names=list(names))


def by_block(df: DataFrame, name: str) -> DataFrame:
    """As `materialise`, in a table that is bucketed by block: later steps join answers to it without moving it again."""
    n, table = partitions(df), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, "block").write.bucketBy(n, "block").sortBy("block").option("path", f"{shared_dir(df.sparkSession)}/{table}").saveAsTable(table)
    return df.sparkSession.table(table)


def blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """block, payload: the rows of each partition in blocks, in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        names = {"block": pa.int64(), "payload": pa.binary()}

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            keys = [LAST if k is None else k for k, _ in held]
            payload = _pack(np.array(keys, np.int64), np.array([k is None for k, _ in held]), [t for _, t in held])
            number, held, size = number + 1, [], 0
            return _rows(names, block=[number - 1], payload=[payload])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.append((key, text or b""))
                size += len(text or b"")
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    with small_batches(docs.sparkSession):
        return by_block(rows.mapInArrow(run, "block long, payload binary"), "text_blocks")


def dealt(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which hashes (64 bits, or pairs of them) are sent, by n buckets, and where the buckets begin (with the end last)."""
    bucket = ((hashes if hashes.ndim == 1 else hashes[:, 0]) >> np.uint64(36)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))


def _sent(block: int, hashes: np.ndarray, n: int, marks: np.ndarray, least: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket of the hashes, which are distinct: hashes, marks (bits) and keys that fall to it."""
    order, ends = dealt(hashes, n)
    used = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
    names = {"bucket": pa.int32(), "block": pa.int64(), "hashes": pa.binary(), "marks": pa.binary(), "least": pa.binary()}
    cut = lambda x, f=lambda y: y: [f(x[ends[i] : ends[i + 1]]).tobytes() for i in used]
    return _rows(names, bucket=used, block=[block] * len(used), hashes=cut(hashes[order]), marks=cut(marks[order], np.packbits), least=[b""] * len(used) if least is None else cut(least[order]))


SENT = "bucket int, block long, hashes binary, marks binary, least binary"


def told(hashes: np.ndarray, answers: list | None, n: int) -> np.ndarray:
    """Two rows of flags: what `judge` has said of the hashes, which a block has sent in this order."""
    order, ends = dealt(hashes, n)
    flags = np.zeros((2, len(hashes)), bool)
    for x in answers or ():
        a, b = int(ends[x["bucket"]]), int(ends[x["bucket"] + 1])
        bits = np.unpackbits(np.frombuffer(x["flags"], np.uint8).reshape(2, -1), axis=1, count=b - a)
        flags[:, order[a:b]] = bits.astype(bool)
    return flags


def judge(parts: list[tuple[int, bytes, bytes, bytes]], how: str) -> Iterator[tuple[int, bytes]]:
    """(block, two rows of bits) for each part of one bucket, a bit for each hash.

    how = "blocks": sent by several blocks, or marked. "marks": marked by any block. "keys" (pairs): other documents have it, that is, blocks with another smallest key, or it is marked; and one of a smaller key has it.
    """
    width = 2 if how == "keys" else 1
    sizes = [len(h) // (8 * width) for _, h, _, _ in parts]
    hashes = np.frombuffer(b"".join(h for _, h, _, _ in parts), np.uint64).reshape(-1, width)
    marks = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=s) for (_, _, m, _), s in zip(parts, sizes, strict=True)]).astype(bool)
    order = np.lexsort(hashes.T[::-1])
    held = hashes[order]
    head = np.append(True, (held[1:] != held[:-1]).any(axis=1))
    heads, group = np.flatnonzero(head), np.cumsum(head) - 1
    marked = np.logical_or.reduceat(marks[order], heads)
    flags = np.zeros((2, len(hashes)), bool)
    if how == "keys":
        least = np.frombuffer(b"".join(x for _, _, _, x in parts), np.int64)[order]
        low, high = np.minimum.reduceat(least, heads), np.maximum.reduceat(least, heads)
        flags[:, order] = (marked | (low < high))[group], least > low[group]
    else:
        flags[0, order] = (marked | (np.diff(np.append(heads, len(held))) > 1) if how == "blocks" else marked)[group]
    at = 0
    for (block, *_), s in zip(parts, sizes, strict=True):
        own, at = flags[:, at : at + s], at + s
        if own.any():
            yield block, np.packbits(own, axis=1).tobytes()


def _judged(sent: DataFrame, n: int, how: str, name: str) -> DataFrame:
    """block, `name` (bucket, flags): what `judge` says of all buckets. A task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, parts = {"block": pa.int64(), "bucket": pa.int32(), "flags": pa.binary()}, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            got = list(judge(parts, how)) if parts else []
            if got:
                yield _rows(names, block=[b for b, _ in got], bucket=[now] * len(got), flags=[x for _, x in got])

        for batch in batches:
            for bucket, *part in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if bucket != now:
                    yield from flush()
                    now, parts = bucket, []
                parts.append(part)
        yield from flush()

    judged = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, flags binary")
    return materialise(judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias(name)), name)


def _each(df: DataFrame, of: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """What `of` makes of each row of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if (made := of(*(column[i].as_py() for column in batch.columns))) is not None:
                    yield made

    return df.mapInArrow(run, schema)


def _levels(docs: DataFrame, target: int, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """block, payload, ones and twos: what is said of its representatives and of its windows."""
    n = partitions(docs)
    buckets = n * BUCKETS
    base = blocks(docs, id_col, text_col, block_bytes)

    def first(block: int, payload: bytes) -> pa.RecordBatch:
        b = Block(payload, target)
        least = b.least()
        order = np.lexsort((b.doc, least))
        held, doc = least[order], b.doc[order]
        head = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
        return _sent(block, held[head], buckets, doc[head] != doc[np.append(head[1:], len(held)) - 1] if len(held) else np.zeros(0, bool))

    def second(block: int, payload: bytes, ones: list | None) -> pa.RecordBatch:
        b = Block(payload, target)
        hashes, least, several, _ = b.smallest(b.repeated(ones, buckets))
        return _sent(block, hashes, buckets, several, least)

    known = base.join(_judged(_each(base, first, SENT), n, "blocks", "ones").hint("merge"), "block", "left").select("block", "payload", "ones")
    twos = _judged(_each(known, second, SENT), n, "keys", "twos")
    return known.join(twos.hint("merge"), "block", "left").select("block", "payload", "ones", "twos")


def _removed(known: DataFrame, target: int) -> DataFrame:
    buckets = partitions(known) * BUCKETS

    def last(block: int, payload: bytes, ones: list | None, twos: list | None) -> pa.RecordBatch:
        b = Block(payload, target)
        chosen = b.repeated(ones, buckets)
        hashes, least, _, where = b.smallest(chosen)
        gone = told(hashes, twos, buckets)[1][where] | (least[where] < b.keys[b.doc[chosen]])
        edge = np.zeros(int(b.first[-1]) + target + 1, np.int32)
        places = b.at[chosen[gone]]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + target, -1)
        keep = np.cumsum(edge[: b.first[-1]]) == 0
        texts = []
        for i in range(len(b.keys)):
            ws = bytes(b.data[b.begin[i] : b.begin[i] + b.size[i]]).split()
            k = keep[b.first[i] : b.first[i + 1]]
            texts.append(b" ".join(ws if k.all() else [w for w, x in zip(ws, k, strict=True) if x]))
        n_words = np.diff(b.first)
        n_kept = np.add.reduceat(np.append(keep, False).astype(np.int64), b.first[:-1]) * (n_words > 0)
        ids = pa.array(b.keys, mask=b.nulls)
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_words - n_kept), pa.array([t.decode() for t in texts])], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return _each(known, last, "doc_id long, n_words long, n_removed long, kept_text string")


def _runs(known: DataFrame, target: int) -> DataFrame:
    """block, payload: the runs of at least 2 * target words all of whose windows are repeated, each as a text of its document's key."""
    buckets = partitions(known) * BUCKETS

    def runs(block: int, payload: bytes, ones: list | None, twos: list | None) -> pa.RecordBatch | None:
        b = Block(payload, target)
        chosen = b.repeated(ones, buckets)
        hashes, _, _, where = b.smallest(chosen)
        chosen = chosen[told(hashes, twos, buckets)[0][where]]
        at, doc = b.at[chosen], b.doc[chosen]
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))[: len(at)])
        size = np.diff(np.append(head, len(at)))
        head, size = head[size > target], size[size > target]
        if not len(head):
            return None
        after = np.append(b.starts, len(b.data) + 1)[at[head] + size + target - 1]  # the next word's start; the run may be its document's last
        ends = np.minimum(after, (b.begin + b.size)[doc[head]])
        packed = _pack(b.keys[doc[head]], np.zeros(len(head), bool), [bytes(b.data[s:e]) for s, e in zip(b.starts[at[head]], ends, strict=True)])
        return _rows({"block": pa.int64(), "payload": pa.binary()}, block=[block], payload=[packed])

    return by_block(_each(known, runs, "block long, payload binary"), "repeated_runs")


def anchors(windows: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """Which hashes are the smallest among their neighbours up to `reach` before and behind them; each document by itself."""
    if not len(windows):
        return np.zeros(0, bool)
    nth = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    at = np.arange(len(windows)) + (nth + 1) * reach  # `reach` places between documents that no neighbour beats
    apart = np.full(int(at[-1]) + reach + 1, np.iinfo(np.uint64).max, np.uint64)
    apart[at] = windows
    least = hashing.sliding_min(apart, reach + 1)
    return np.minimum(least[at - reach], least[at]) == windows


def _anchored(runs: DataFrame, target: int) -> DataFrame:
    """level, block, key, place, one, two: hashes of the windows of target * 2 ** level words at the level's anchors."""
    names = ["level", "block", "key", "place", "one", "two"]

    def anchored(block: int, payload: bytes) -> pa.RecordBatch | None:
        b, out, level = Block(payload, target), [], 1
        while len(fits := b.ahead(target << level)):
            size = target << level
            here = np.zeros(len(b.at), bool)
            here[fits] = True
            long = np.flatnonzero((np.diff(b.first) >= size)[b.doc])  # the places in runs that are long enough
            chosen = long[anchors(b.windows[long], b.doc[long], (size >> 1) - 1) & here[long]]
            at = b.at[chosen]
            one, two = (hashing.windows(b.words, size, second)[at].view(np.int64) for second in (False, True))
            out.append((np.full(len(at), level, np.int32), np.full(len(at), block), b.keys[b.doc[chosen]], at, one, two))
            level += 1
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names) if out else None

    return _each(runs, anchored, "level int, block long, key long, place long, one long, two long")


def _open(b: Block, target: int, found: list | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, windows that are long enough for it, which of them are of documents of which no such length has been found)."""
    known = {x["key"]: x["level"] for x in found or ()}
    least, level = np.array([known.get(k, 0) for k in b.keys.tolist()]), 1
    while len(fits := b.ahead(target << level)):
        yield level, fits, least[b.doc[fits]] < level
        level += 1


def _settled(runs: DataFrame, target: int, found: DataFrame) -> DataFrame:
    """key, level: documents that have a repeated window of target * 2 ** level words, where anchors have not found one as long (found: block, found (key, level))."""
    n = partitions(runs)
    buckets = n * BUCKETS
    runs = runs.join(found.hint("merge"), "block", "left").select("block", "payload", "found")

    def tops(b: Block, level: int, fits: np.ndarray) -> np.ndarray:
        """The smallest target window in each long one, which tells levels apart."""
        return hashing.mix(hashing.sliding_min(b.windows, (target << level) - target + 1)[fits] + np.uint64(level))

    def asked(block: int, payload: bytes, found: list | None) -> pa.RecordBatch | None:
        b = Block(payload, target)
        got = [(tops(b, level, fits), open_) for level, fits, open_ in _open(b, target, found)]
        if not got:
            return None
        hashes, where = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
        marks = np.zeros(len(hashes), bool)
        marks[where[np.concatenate([x for _, x in got])]] = True
        return _sent(block, hashes, buckets, marks)

    def long(b: Block, found: list | None, asks: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, document keys and levels of the windows that someone asks for."""
        got = [(level, fits, tops(b, level, fits)) for level, fits, _ in _open(b, target, found)]
        hashes = np.unique(np.concatenate([x for _, _, x in got]))
        wanted, rows, keys, levels = told(hashes, asks, buckets)[0], [], [], []
        for level, fits, top in got:
            chosen = fits[wanted[np.searchsorted(hashes, top)]]
            rows.append(pairs(*(hashing.windows(b.words, target << level, second)[b.at[chosen]] for second in (False, True))))
            keys.append(b.keys[b.doc[chosen]])
            levels.append(np.full(len(chosen), level))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(levels)

    def compared(block: int, payload: bytes, found: list | None, asks: list | None) -> pa.RecordBatch | None:
        if not asks:
            return None
        rows, keys, _ = long(Block(payload, target), found, asks)
        hashes, least, several, _ = keyed(rows, keys)
        return _sent(block, hashes, buckets, several, least)

    def levels(block: int, payload: bytes, found: list | None, asks: list | None, repeats: list | None) -> pa.RecordBatch | None:
        if not asks:
            return None
        rows, keys, levels = long(Block(payload, target), found, asks)
        hashes, _, _, where = keyed(rows, keys)
        hit = told(hashes, repeats, buckets)[0][where]
        both = np.unique(np.column_stack([keys[hit], levels[hit]]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1].astype(np.int32))], names=["key", "level"])

    asks = _judged(_each(runs, asked, SENT), n, "marks", "asks")
    runs = runs.join(asks.hint("merge"), "block", "left").select("block", "payload", "found", "asks")
    repeats = _judged(_each(runs, compared, SENT), n, "keys", "repeats")
    return _each(runs.join(repeats.hint("merge"), "block", "left").select("block", "payload", "found", "asks", "repeats"), levels, "key long, level int")


def _lengths(known: DataFrame, target: int) -> DataFrame:
    """doc_id, longest: for each document of which a longer window than `target` is repeated elsewhere, the longest such length."""
    spark, runs = known.sparkSession, _runs(known, target)
    anchored = materialise(_anchored(runs, target), "anchored-windows")
    alive, level, out = None, 1, spark.createDataFrame([], "block long, key long, level int")
    while True:
        here = anchored.where(F.col("level") == level).select("one", "two", "key", "block", "place")
        if alive is not None:  # only what was repeated at half the length
            here = materialise(here.join(alive, ["key", "block", "place"], "left_semi"), "candidates")
        twice = here.groupBy("one", "two").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("one", "two")
        alive = materialise(salted_join(here, twice, ["one", "two"]).select("key", "block", "place"), "repeated")
        if alive.isEmpty():
            break
        out = out.unionByName(alive.select("block", "key").distinct().withColumn("level", F.lit(level)))
        level += 1
    out = materialise(out.groupBy("block", "key").agg(F.max("level").alias("level")), "found")
    found = out.groupBy("block").agg(F.collect_list(F.struct("key", "level")).alias("found"))
    out = out.select("key", "level").unionByName(_settled(runs, target, found))
    return out.groupBy("key").agg(F.max("level").alias("level")).select(F.when(F.col("key") != LAST, F.col("key")).alias("doc_id"), (F.lit(target) * F.pow(F.lit(2), "level")).cast("long").alias("longest"))


def substring_dedup(docs: DataFrame, target: int = TARGET, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row; kept words joined by one space.

    Ids are integers. Rows of equal id do not remove from one another; null ids count as larger than all others and come back
    null. Null or empty text has no words and stays empty; texts shorter than a window keep all their words.
    """
    return _removed(_levels(docs, target, block_bytes, id_col, text_col), target)


def repeat_lengths(docs: DataFrame, target: int = TARGET, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, longest for every document id that has a passage of 2 * target words or more in common with a document of another id: the greatest length target * 2 ** k of such passages."""
    return _lengths(_levels(docs, target, block_bytes, id_col, text_col), target)


def query(spark, sf_dir: str) -> DataFrame:
    known = _levels(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGET, BLOCK_BYTES, "doc_id", "text")
    out = _removed(known, TARGET).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return out.join(_lengths(known, TARGET), "doc_id", "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
