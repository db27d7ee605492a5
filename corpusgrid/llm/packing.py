"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs linear * n + quadratic * n * n (attention within the piece). Each document is cut into
full sequences and a rest. The rests of a block of documents, by descending cost, each go to the sequence of the lowest cost
that still has room; there are only as many sequences as the rests can fill. What fits nowhere is cut over the
sequences with room left, the lowest cost first. What is left of the block, less than one sequence, is cut
into sequences whose lengths are powers of two, which need no padding either.

Blocks are formed within a partition as its rows stream by: nothing is shuffled and a task holds one block's ids. If an order is asked for, rows are
range-partitioned and sorted by it first, so that blocks, and the numbers of their sequences, follow it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm.common import released

CAPACITY, BLOCK_TOKENS, END_ID = 1024, 3_000_000, 0
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def pack_block(tokens: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, int]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts, by document and start; number of sequences."""
    out: list[np.ndarray] = []
    full, rest = tokens // capacity, tokens % capacity
    n_full = int(full.sum())
    doc = np.repeat(np.arange(len(tokens)), full)
    nth = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
    out.append(np.column_stack([doc, nth * capacity, np.full(n_full, capacity), np.arange(n_full), np.zeros(n_full, np.int64)]))
    n = int(rest.sum()) // capacity
    cost, used = np.zeros(n), np.zeros(n, np.int64)
    placed: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []

    def place(d: int, start: int, size: int, s: int) -> None:
        placed.append((d, start, size, n_full + s, int(used[s])))
        used[s] += size
        cost[s] += linear * size + quadratic * size * size

    open_ = [(0.0, s) for s in range(n)]  # a heap by cost; a sequence without room for a rest waits for smaller ones
    waiting: list[tuple[int, float, int]] = []  # (-room, cost, sequence)
    for d in np.lexsort((np.arange(len(rest)), -rest)):
        if not (size := int(rest[d])):
            break
        start = int(full[d]) * capacity
        while waiting and -waiting[0][0] >= size:
            _, c, s = heapq.heappop(waiting)
            heapq.heappush(open_, (c, s))
        while open_ and capacity - used[open_[0][1]] < size:
            c, s = heapq.heappop(open_)
            heapq.heappush(waiting, (int(used[s]) - capacity, c, s))
        if open_:
            _, s = heapq.heappop(open_)
            place(int(d), start, size, s)
            heapq.heappush(open_, (float(cost[s]), s))
        else:
            over.append((int(d), start, size))
    room = [int(s) for s in np.lexsort((np.arange(n), cost)) if used[s] < capacity]
    left = int(rest.sum()) - n * capacity
    short = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
    gaps = [(s, capacity - int(used[s])) for s in room] + [(n + i, size) for i, size in enumerate(short)]
    used, cost = np.append(used, np.zeros(len(short), np.int64)), np.append(cost, np.zeros(len(short)))
    g = 0
    for d, start, size in over:
        while size:
            s, free = gaps[g]
            take = min(size, free)
            place(d, start, take, s)
            start, size, free = start + take, size - take, free - take
            gaps[g] = (s, free)
            g += not free
    if placed:
        out.append(np.array(placed, dtype=np.int64))
    pieces = np.concatenate(out)
    return pieces[np.lexsort((pieces[:, 1], pieces[:, 0]))], n_full + n + len(short)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text", order: Sequence[str] = ()) -> DataFrame:
    """Pieces of all documents: the id column, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32).

    Null text counts as empty, which leaves the end id alone. Ids may be null or repeat: each row is a document of its own.
    An empty table has no pieces. Other columns are not carried. `order`: columns that the sequences follow, block by block.
    """
    kind = docs.schema[id_col].dataType
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField(id_col, kind), *long, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from corpusgrid.llm.tokens import encoder, slices, with_end

        enc, base, held, size = encoder(tokenizer), TaskContext.get().partitionId() << 36, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held, size
            keys = pa.concat_arrays([k for k, _, _ in held])
            ids = np.concatenate([i for _, i, _ in held])
            tokens = np.concatenate([np.diff(s) for _, _, s in held])
            pieces, n = pack_block(tokens, capacity, linear, quadratic)
            bounds = np.concatenate(([0], np.cumsum(pieces[:, 2]) * 4)).astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            columns = [keys.take(pa.array(pieces[:, 0])), *(pa.array(x) for x in (pieces[:, 1], pieces[:, 2], tokens[pieces[:, 0]], base + pieces[:, 3], pieces[:, 4])), binary]
            base, held, size = base + n, [], 0
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            texts = texts.fill_null("") if texts.null_count else texts
            for a, b in slices(texts):
                ids, starts = with_end(*enc.encode(texts.slice(a, b - a)), end_id)
                held.append((keys.slice(a, b - a), ids, starts))
                size += len(ids)
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()
        enc.rest()

    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda batches: released(run(batches)), schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))
