"""Token ids in binary files: bit-plane or byte-plane shuffled, compressed, indexed.

Format. Documents in ascending id order, an end id after each, are one stream of little-endian 32-bit ids per shard;
shard numbers ascend with the document ids. A stream is cut into chunks of `chunk_ids` ids (the last may be
shorter). A chunk is transposed: plane k holds byte k (or bit k) of every id, and each plane is compressed
by itself with zstandard. Planes that are all zero have size 0 and no bytes. Chunks are the rows of a Parquet table, so that Spark's
commit protocol covers lost executors and any store will do:

    data/   shard, chunk, first (ids of the shard before the chunk), n_ids, plane_sizes, payload (the planes in order),
            and the documents' pieces in the chunk: doc_keys, doc_ordinals, doc_starts (ids of the document before the piece), doc_lengths, doc_ends
    index/  shard, chunk, first, n_ids, n_bytes: the chunk index
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.session import shared_dir

CHUNK_IDS, END_ID, LEVEL = 1 << 16, 2, 3


def to_planes(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> list[bytes]:
    """The compressed planes of these ids, lowest byte (bit) first."""
    import zstandard

    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        rows = [np.packbits((row >> k) & 1) for row in rows for k in range(8)]
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(np.ascontiguousarray(row).tobytes()) if row.any() else b"" for row in rows]


def from_planes(payload: bytes, sizes: list[int], n_ids: int) -> np.ndarray:
    """The ids of a chunk; 32 sizes mean bit planes, 4 byte planes."""
    import zstandard

    open_, at, planes = zstandard.ZstdDecompressor(), 0, []
    width = n_ids if len(sizes) == 4 else -(-n_ids // 8)
    for size in sizes:
        planes.append(np.frombuffer(open_.decompress(payload[at : at + size]), np.uint8) if size else np.zeros(width, np.uint8))
        at += size
    if len(sizes) == 32:
        flat = [np.unpackbits(p)[:n_ids] for p in planes]
        planes = [sum((flat[8 * k + j] << j for j in range(8)), np.zeros(n_ids, np.uint8)) for k in range(4)]
    return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").reshape(-1)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents to data/ and index/ under `path`.

    Null text counts as empty and leaves the end id alone. Rows without an id come first; rows of equal id keep
    apart and follow one another by text. An empty table gives empty files.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("plane_sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()), T.StructField("doc_keys", T.ArrayType(kind)),
        *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("doc_ordinals", "doc_starts", "doc_lengths")), T.StructField("doc_ends", T.ArrayType(T.BooleanType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        from corpusgrid.llm.tokens import encoder, slices, with_end

        enc, shard, target = encoder(tokenizer), TaskContext.get().partitionId(), to_arrow_schema(schema)
        keys: list = []
        ids, before, chunk, ordinal = np.zeros(0, "<u4"), np.zeros(0, np.int64), 0, 0
        lengths = np.zeros(0, np.int64)  # of the documents' parts that wait in `ids`; `before`: ids of each that are written

        def cut(n: int) -> pa.RecordBatch:
            nonlocal keys, ids, before, lengths, chunk, ordinal
            ends = np.cumsum(lengths)
            whole = int(np.searchsorted(ends, n, side="right"))
            part = n - (int(ends[whole - 1]) if whole else 0)
            k = whole + bool(part)
            sizes = lengths[:k].copy()
            if part:
                sizes[-1] = part
            planes = to_planes(ids[:n], bits)
            row = {
                "shard": shard, "chunk": chunk, "first": chunk * chunk_ids, "n_ids": n, "plane_sizes": [len(p) for p in planes], "payload": b"".join(planes), "doc_keys": keys[:k],
                "doc_ordinals": list(range(ordinal, ordinal + k)), "doc_starts": before[:k].tolist(), "doc_lengths": sizes.tolist(), "doc_ends": [True] * whole + [False] * (k - whole),
            }
            keys, ids, before, lengths, chunk, ordinal = keys[whole:], ids[n:], before[whole:].copy(), lengths[whole:].copy(), chunk + 1, ordinal + whole
            if part:
                before[0], lengths[0] = before[0] + part, lengths[0] - part
            return pa.RecordBatch.from_pylist([row], schema=target)

        for batch in batches:
            column, texts = batch.column(0), batch.column(1)
            texts = texts.fill_null("") if texts.null_count else texts
            for a, b in slices(texts):
                new, starts = with_end(*enc.encode(texts.slice(a, b - a)), end_id)
                keys = keys + column.slice(a, b - a).to_pylist()
                ids, lengths = np.concatenate([ids, new]), np.concatenate([lengths, np.diff(starts)])
                before = np.concatenate([before, np.zeros(b - a, np.int64)])
                while len(ids) >= chunk_ids:
                    yield cut(chunk_ids)
        if len(ids):
            yield cut(len(ids))

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    chunks = rows.repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), "text").mapInArrow(run, schema)
    chunks.write.option("compression", "none").parquet(f"{path}/data")
    data = docs.sparkSession.read.schema(schema).parquet(f"{path}/data")
    data.select("shard", "chunk", "first", "n_ids", F.aggregate("plane_sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_bytes")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document's piece in a chunk: doc_key, shard, ordinal (the document's number in the shard), at (ids
    of the shard before the piece), start (ids of the document before it), length, whole, ids (binary, little-endian uint32)."""
    data = spark.read.parquet(f"{path}/data")
    kind = data.schema["doc_keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_key", kind), *(T.StructField(c, T.LongType()) for c in ("shard", "ordinal", "at", "start", "length")), T.StructField("whole", T.BooleanType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                get = lambda c: row[c].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                ids = from_planes(row["payload"].as_py(), get("plane_sizes").tolist(), row["n_ids"].as_py())
                starts, lengths = get("doc_starts"), get("doc_lengths")
                n, at = len(lengths), np.cumsum(lengths) - lengths
                bounds = np.append(at, at[-1] + lengths[-1]).astype(np.int32) * 4 if n else np.zeros(1, np.int32)
                binary = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                columns = [row["doc_keys"].values, pa.array(np.full(n, row["shard"].as_py())), *(pa.array(x) for x in (get("doc_ordinals"), row["first"].as_py() + at, starts, lengths, (starts == 0) & get("doc_ends"))), binary]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return data.mapInArrow(run, schema)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_key, start (ids of all documents before), n_tokens, ids_crc32 of every document in the files.

    A document within one chunk is summed up where it is read; only those cut by a chunk's end gather their pieces.
    """
    pieces = read(spark, path).withColumns({"crc": F.when(F.col("whole"), F.crc32("ids")), "part": F.when(~F.col("whole"), F.struct("start", "ids"))}).drop("ids")
    joined = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    docs = pieces.groupBy("shard", "ordinal").agg(
        F.first("doc_key").alias("doc_key"), F.min("at").alias("at"), F.sum("length").alias("n_tokens"), F.coalesce(F.max("crc"), F.crc32(joined)).alias("ids_crc32")
    )
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))  # a row for each shard
    return docs.join(F.broadcast(shards), "shard").select("doc_key", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return documents(spark, path).withColumnRenamed("doc_key", "doc_id")
