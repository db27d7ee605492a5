"""Many literal patterns in one pass over each text: an Aho-Corasick automaton per task.

Patterns come in blocks of bounded number and size. A block travels with the tasks and costs one scan of the texts; there is no shuffle, and no limit on the number of blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BLOCK_CHARS = 5_000, 4 << 20


def build(patterns: Sequence[str]):
    """An automaton that says the number of a pattern; None without patterns. Empty patterns are left out."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        if p:
            out.add_word(p, (i, len(p)))
    if not len(out):
        return None
    out.make_automaton()
    return out


def times(automaton, text: str) -> dict[int, int]:
    """How often each pattern stands in the text, from the left, without overlaps of its own."""
    count: dict[int, int] = {}
    free: dict[int, int] = {}
    for end, (i, size) in automaton.iter(text):
        if end - size + 1 >= free.get(i, 0):
            count[i] = count.get(i, 0) + 1
            free[i] = end + 1
    return count


def blocks(rows: DataFrame, key: str, size: str, block: int = BLOCK, chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The rows in blocks of about `block` rows and `chars` characters at most, by a hash of their key."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(size)), F.lit(0)).alias("chars")).first()
    n = max(1, -(-sums["n"] // block), -(-sums["chars"] // chars))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


SUBSTRINGS = "qid long, doc long, coverage long, times long, phrase long, length long"


def substrings(docs: DataFrame, queries: DataFrame, every: bool, k: int | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """qid, doc, coverage, times, phrase, length: case-blind containment of the query's words (cut at spaces), all of them (`every`) or any.

    coverage: distinct words found; times: their occurrences, without overlaps of one word; phrase: 1 if the text holds the query as it is. With `k`, a task gives only its k best rows of a query, by phrase, coverage, times,
    shortness and id. Ids are whole numbers; null texts count as empty; a query without words finds nothing.
    """
    rows = queries.select(F.col("qid").cast("long").alias("qid"), F.lower("text").alias("q")).where("trim(q) <> ''")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))

    def one(asked: list) -> DataFrame:
        qids = np.array([r["qid"] for r in asked], np.int64)
        words = [list(dict.fromkeys(w for w in r["q"].split(" ") if w)) for r in asked]
        patterns = list(dict.fromkeys([*(w for ws in words for w in ws), *(r["q"] for r in asked)]))
        number = {p: i for i, p in enumerate(patterns)}
        flat = np.array([number[w] for ws in words for w in ws], np.int64)
        begin = np.append(0, np.cumsum([len(ws) for ws in words]))[:-1]
        size, whole = np.array([len(ws) for ws in words]), np.array([number[r["q"]] for r in asked])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, best = build(patterns), {}

            def batch_of(found: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=[c.split()[0] for c in SUBSTRINGS.split(", ")])

            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    count = times(automaton, text)
                    n = np.zeros(len(patterns), np.int64)
                    n[list(count)] = list(count.values())
                    coverage = np.add.reduceat((n[flat] > 0).astype(np.int64), begin)
                    total = np.add.reduceat(n[flat], begin)
                    for i in np.flatnonzero(coverage == size if every else coverage > 0).tolist():
                        row = (int(qids[i]), doc, int(coverage[i]), int(total[i]), int(n[whole[i]] > 0), len(text))
                        if k is None:
                            out.append(row)
                        else:
                            key = (row[4], row[2], row[3], -row[5], -doc)
                            heap = best.setdefault(i, [])
                            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (key, row))
                if out:
                    yield batch_of(out)
            if best:
                yield batch_of([row for heap in best.values() for _, row in heap])

        return texts.mapInArrow(run, SUBSTRINGS)

    found = [b.collect() for b in blocks(rows, "qid", "q", block)]  # a block at a time, of bounded size
    found = [one(asked) for asked in found if asked]
    return _union(found) if found else docs.sparkSession.createDataFrame([], SUBSTRINGS)


def best_substrings(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc, rank by phrase, coverage, occurrences, shortness and id."""
    order = Window.partitionBy("qid").orderBy(F.desc("phrase"), F.desc("coverage"), F.desc("times"), "length", "doc")
    return substrings(docs, queries, every=False, k=k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc", "rank")


# What no payload may hold. Sign of a path of a user's own files; words of the store, in any case.
PATHS = ("C:\\Users\\", "C:/Users/", "/home/", "/Users/")
STORE = ("sqlite", "manifest")
AUDIT = "id {0}, input_chars long, forbidden array<string>, absolute_path_absent boolean, api_key_absent boolean, sqlite_absent boolean, manifest_absent boolean"
VIOLATIONS = "id {0}, kind string, pattern string, times long"


def _audited(payloads: DataFrame, sentinels: DataFrame, keys: Sequence[str], block: int) -> list[DataFrame]:
    """id, kind, pattern, times for each block of sentinels; paths, keys and words of the store go with the first. A row of kind `size` for each payload, with its length."""
    kind = payloads.schema["id"].dataType.simpleString()
    frames = []
    for number, rows in enumerate(blocks(sentinels.select(F.col("name").cast("string").alias("name"), "text").where("text <> ''"), "name", "text", block)):
        own = [("sentinel", r["name"], r["text"]) for r in rows.collect()]
        exact = own + ([("path", p, p) for p in PATHS] + [("key", "", key) for key in keys if key] if number == 0 else [])
        blind = [("store", w, w) for w in STORE] if number == 0 else []

        def run(batches: Iterator[pa.RecordBatch], exact=exact, blind=blind, number=number) -> Iterator[pa.RecordBatch]:
            found = [(build([p for _, _, p in some]), some, fold) for some, fold in ((exact, False), (blind, True))]
            for batch in batches:
                out = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if number == 0:
                        out.append((i, "size", "", len(text)))
                    for automaton, some, fold in found:
                        if automaton:
                            folded = text.casefold() if fold else text
                            out += [(i, some[p][0], some[p][1], n) for p, n in times(automaton, folded).items()]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(x) for x in columns[1:])], names=["id", "kind", "pattern", "times"])

        frames.append(payloads.mapInArrow(run, VIOLATIONS.format(kind)))
    return frames


def payload_violations(payloads: DataFrame, sentinels: DataFrame, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """id, kind (sentinel, path, key, store), pattern (the sentinel's name; empty for a key, which is never shown), times. `payloads`: id, text; `sentinels`: name, text (distinct texts)."""
    rows = payloads.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return _union(_audited(rows, sentinels, keys, block)).where("kind <> 'size'")


def payload_audit(payloads: DataFrame, sentinels: DataFrame, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """id, input_chars, forbidden (names of sentinels that the payload holds, in order), and what is absent: absolute paths, keys, words of the store. One row for each id; texts of one id count as one payload."""
    rows = payloads.select("id", F.coalesce("text", F.lit("")).alias("text"))
    told = _union(_audited(rows, sentinels, keys, block))
    absent = lambda kind, pattern=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if pattern is None else F.col("pattern") == pattern)) == 0
    return told.groupBy("id").agg(
        F.sum(F.when(F.col("kind") == "size", F.col("times"))).alias("input_chars"), F.array_sort(F.collect_set(F.when(F.col("kind") == "sentinel", F.col("pattern")))).alias("forbidden"),
        absent("path").alias("absolute_path_absent"), absent("key").alias("api_key_absent"), *(absent("store", w).alias(f"{w}_absent") for w in STORE),
    )
