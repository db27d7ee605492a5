"""Postings by ranges of documents, and search over them: BM25 with bounds by range, all terms, phrases.

A range holds up to RANGE documents of one input partition. A row of postings is a term in a range: the documents' places in the range, frequencies, lengths and positions, and the largest
frequency and smallest length, which bound the score that the term can add there. The row of the empty term lists all documents of the range. Inverting needs no shuffle: ranges are cut from the rows as they stream by.

A search joins the query terms with the postings, brings a range's rows for a block of queries together, and works on arrays. BM25 skips a query in a range whose bound stays below
the query's k-th best score so far in the task, so that no score has to be worked out there. Terms and weights are broadcast only below a counted size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.session import materialise

K1, B, FLOOR = 1.2, 0.75, 1e-6
RANGE, RANGE_TOKENS = 1024, 1 << 21
QUERY_BLOCK = 128  # queries of a block, about
BROADCAST_ROWS = 200_000
POSTINGS = "range long, term string, at array<int>, tf array<int>, dl array<int>, positions array<int>, tf_max int, dl_min int, docs array<{0}>"
DOCUMENTS = ""  # the term of the rows that list documents


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *columns: str) -> DataFrame:
    """range, at, doc, dl (tokens), ts (the tokens) and `columns`. Ranges are of one partition of `docs`; a plan that runs twice may number them differently, so everything is made from one run."""
    at = F.monotonically_increasing_id()
    rows = docs.select(at.alias("__at"), F.col(id_col).alias("doc"), X.tokens(F.col(text_col)).alias("ts"), *columns)
    return rows.select(F.expr(f"__at div {RANGE}").alias("range"), F.expr(f"int(__at % {RANGE})").alias("at"), "doc", F.size("ts").alias("dl"), "ts", *columns)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, pa.int32()))


def inverted(rows: DataFrame, positions: bool = True) -> DataFrame:
    """POSTINGS of `placed` rows, in the order in which they stand. Of a range of many tokens, a term can have several rows."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            rng, at, dl = (table.column(i).to_numpy() for i in range(3))
            cut = np.append(np.flatnonzero(np.append(True, rng[1:] != rng[:-1])), len(rng))
            doc = table.column(4).combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), doc)
            none = pa.nulls(len(cut) - 1, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(rng[cut[:-1]]), pa.array([DOCUMENTS] * (len(cut) - 1)), _lists(at, cut[1:]), none, _lists(dl, cut[1:]), none, *[pa.nulls(len(cut) - 1, pa.int32())] * 2, ids], names=names)
            tokens = pa.concat_arrays([c.flatten() for c in table.column(3).chunks])
            if not len(tokens):
                return
            terms = tokens.dictionary_encode()
            code, row = terms.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(dl)), dl)
            place = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
            _, part = np.unique(rng, return_inverse=True)
            order = np.lexsort((place, row, code, part[row]))
            code, row, place = code[order], row[order], place[order]
            new = np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))
            entry = np.flatnonzero(new)  # a term in a document
            tf = np.diff(np.append(entry, len(code)))
            code, row = code[entry], row[entry]
            heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[row[1:]] != part[row[:-1]])))
            ends = np.append(heads[1:], len(code))
            last = np.append(entry[heads[1:]], len(place))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rng[row[heads]]), terms.dictionary.take(pa.array(code[heads])), _lists(at[row], ends), _lists(tf, ends), _lists(dl[row], ends),
                    _lists(place, last) if positions else pa.nulls(len(heads), pa.list_(pa.int32())),
                    pa.array(np.maximum.reduceat(tf, heads).astype(np.int32)), pa.array(np.minimum.reduceat(dl[row], heads).astype(np.int32)), pa.nulls(len(heads), ids.type),
                ],
                names=names,
            )

        names, size = [c.split()[0] for c in POSTINGS.split(", ")], 0
        for batch in batches:
            for k in range(0, batch.num_rows, RANGE):
                some = batch.slice(k, RANGE)
                held.append(some)
                size += len(some.column(3).flatten())
                if size >= RANGE_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return rows.select("range", "at", "dl", "ts", "doc").mapInArrow(run, POSTINGS.format(kind))


def documents(postings: DataFrame) -> DataFrame:
    """range, at, doc, dl: of all documents, those without tokens too."""
    rows = postings.where(F.col("term") == DOCUMENTS).select("range", F.explode(F.arrays_zip("at", F.col("docs").alias("doc"), "dl")).alias("d"))
    return rows.select("range", "d.at", "d.doc", "d.dl")


def query_terms(queries: DataFrame, id_col: str = "qid", text_col: str = "text") -> DataFrame:
    """qid, term, qtf, place: a query's terms; repeated ones once for each place, with their number in qtf."""
    rows = queries.select(F.col(id_col).alias("qid"), F.posexplode(X.tokens(F.col(text_col))).alias("place", "term"))
    return rows.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"), F.array_sort(F.collect_list("place")).alias("places"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def wanted(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the query terms, and the rows of the documents."""
    every = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([(DOCUMENTS,)], "term string"))
    return postings.join(_few(materialise(every, "terms")), "term")


def met(postings: DataFrame, uses: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`run` over a stream of (block, range, term, at, tf, dl, positions, tf_max, dl_min, uses) in order of block and range. `uses`: block, term, uses (bounded by the block's queries)."""
    rows = postings.join(_few(materialise(uses, "term-uses")), "term")
    rows = rows.select("block", "range", "term", "at", "tf", "dl", "positions", "tf_max", "dl_min", "uses")
    return rows.repartition("block", "range").sortWithinPartitions("block", "range").mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """The rows of each (block, range)."""
    now, held = None, []
    for batch in batches:
        block, rng = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (rng[1:] != rng[:-1])) + 1), len(block)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if (block[a], rng[a]) != now:
                if held:
                    yield now, held
                now, held = (block[a], rng[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _blocks(terms: DataFrame, value: Column) -> DataFrame:
    """block, term, uses: queries are dealt into blocks by a hash."""
    n = max(1, -(-terms.select("qid").distinct().count() // QUERY_BLOCK))
    rows = terms.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n)))
    return rows.groupBy("block", "term").agg(F.collect_list(F.struct("qid", value.alias("w"))).alias("uses"))


def frequencies(found: DataFrame) -> DataFrame:
    """term, df: in how many documents it stands."""
    return found.where(F.col("term") != DOCUMENTS).groupBy("term").agg(F.sum(F.size("at")).alias("df"))


def weights(terms: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """`terms` (qid, term, qtf) with w = qtf * idf; idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6."""
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(df, "term").select("qid", "term", (F.col("qtf") * F.when(idf <= 0, FLOOR).otherwise(idf)).alias("w"))


class Best:
    """The k best scores of each query of a block, as far as ranges have been seen."""

    def __init__(self, k: int | None) -> None:
        self.k, self.index, self.bar = k, {}, np.zeros(0)
        self.rows: list[list[tuple]] = []

    def number(self, queries: list) -> np.ndarray:
        for q in queries:
            if q not in self.index:
                self.index[q] = len(self.index)
                self.rows.append([])
        if len(self.bar) < len(self.index):
            self.bar = np.append(self.bar, np.full(len(self.index) - len(self.bar), -np.inf))
        return np.array([self.index[q] for q in queries], np.int64)

    def take(self, q: int, rng: int, at: np.ndarray, score: np.ndarray) -> None:
        if self.k is not None and len(score) > self.k:
            some = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])  # ties with the last one stay
            at, score = at[some], score[some]
        rows = self.rows[q]
        rows += zip(score.tolist(), [rng] * len(at), at.tolist(), strict=True)
        if self.k is not None and len(rows) >= self.k:
            kept = sorted((r[0] for r in rows), reverse=True)[self.k - 1]
            self.rows[q] = [r for r in rows if r[0] >= kept]
            self.bar[q] = kept

    def emit(self) -> tuple[list, ...]:
        qids, scores, rngs, ats = [], [], [], []
        for q, i in self.index.items():
            for score, rng, at in self.rows[i]:
                qids.append(q)
                scores.append(score)
                rngs.append(rng)
                ats.append(at)
        return qids, scores, rngs, ats


def scored(best: Best, rng: int, table: pa.Table, avgdl: float) -> int:
    """Scores the range's documents for the queries whose bound can still reach their k best; returns the number of queries that were skipped."""
    uses = table.column("uses").combine_chunks()
    qids = uses.values.field("qid").to_pylist()
    q = best.number(qids)
    owner = np.repeat(np.arange(len(table)), np.diff(uses.offsets.to_numpy()))
    w = uses.values.field("w").to_numpy()
    tf_max, dl_min = (table.column(c).to_numpy().astype(float) for c in ("tf_max", "dl_min"))
    most = tf_max * (K1 + 1) / (tf_max + K1 * (1 - B + B * dl_min / avgdl))
    bound = np.zeros(len(best.index))
    np.add.at(bound, q, w * most[owner])
    here = np.unique(q)
    live = here[bound[here] >= best.bar[here] - 2e-6]
    if len(live):
        column = np.full(len(best.index), -1)
        column[live] = np.arange(len(live))
        used = column[q] >= 0
        terms, owner_no = np.unique(owner[used], return_inverse=True)
        weight = np.zeros((len(terms), len(live)))
        np.add.at(weight, (owner_no, column[q[used]]), w[used])
        lists = [table.column(c).combine_chunks() for c in ("at", "tf", "dl")]
        size = np.diff(lists[0].offsets.to_numpy())
        at, tf, dl = (x.values.to_numpy() for x in lists)
        row = np.repeat(np.arange(len(table)), size)
        number = np.full(len(table), -1)
        number[terms] = np.arange(len(terms))
        mine = number[row] >= 0
        at, tf, dl, row = at[mine], tf[mine].astype(float), dl[mine], number[row[mine]]
        docs, place = np.unique(at, return_inverse=True)
        part = np.zeros((len(docs), len(terms)))
        part[place, row] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        total = np.round(part @ weight, 6)
        has = ((part > 0).astype(np.float32) @ (weight > 0).astype(np.float32)) > 0
        for i, own in enumerate(live):
            some = np.flatnonzero(has[:, i])
            best.take(int(own), rng, docs[some], total[some, i])
    return len(here) - len(live)


def bm25(postings: DataFrame, terms: DataFrame, k: int | None) -> DataFrame:
    """qid, doc, score, rank: smaller (more negative) scores first, ties by doc. `postings`: a table of those that are `wanted`, since they are read more than once."""
    stats = documents(postings).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    kind = terms.schema["qid"].dataType.simpleString()
    uses = _blocks(weights(terms, frequencies(postings), n), F.col("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, Best(k)

        def out() -> pa.RecordBatch:
            qids, scores, rngs, ats = best.emit()
            return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64() if kind == "bigint" else None), pa.array(scores, pa.float64()), pa.array(rngs, pa.int64()), pa.array(ats, pa.int32())], names=["qid", "score", "range", "at"])

        for (b, rng), held in groups(batches):
            if block is not None and (b != block or k is None):
                yield out()
                best = Best(k)
            block = b
            scored(best, int(rng), pa.Table.from_batches(held), avgdl)
        if best.index:
            yield out()

    found = met(postings, uses, run, f"qid {kind}, score double, range long, at int")
    found = found.join(documents(postings).select("range", "at", "doc"), ["range", "at"]).select("qid", "doc", (-F.col("score")).alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "doc")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _shared(table: pa.Table, answer: Callable) -> tuple[list, list, list]:
    """Answers, by query, over the rows that hold its terms. `answer` gets (uses' value, row numbers) of each term that is there."""
    uses = table.column("uses").combine_chunks()
    owner = np.repeat(np.arange(len(table)), np.diff(uses.offsets.to_numpy()))
    by: dict = {}  # of a query, the rows of each of its terms
    names = table.column("term").to_pylist()
    for q, w, row in zip(uses.values.field("qid").to_pylist(), uses.values.field("w").to_pylist(), owner.tolist(), strict=True):
        by.setdefault(q, {}).setdefault(names[row], (w, []))[1].append(row)
    qids, ats, times = [], [], []
    for q, rows in by.items():
        at, n = answer(list(rows.values()))
        qids += [q] * len(at)
        ats += at.tolist()
        times += n.tolist()
    return qids, ats, times


def _containing(postings: DataFrame, terms: DataFrame, value: Column, answer_of: Callable) -> DataFrame:
    kind = terms.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, rng), held in groups(batches):
            table = pa.Table.from_batches(held)
            qids, ats, times = _shared(table, answer_of(table))
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64() if kind == "bigint" else None), pa.array([int(rng)] * len(ats), pa.int64()), pa.array(ats, pa.int32()), pa.array(times, pa.int64())], names=["qid", "range", "at", "times"])

    found = met(postings, _blocks(terms, value), run, f"qid {kind}, range long, at int, times long")
    return found.join(documents(postings).select("range", "at", "doc"), ["range", "at"]).select("qid", "doc", "times")


def containing_all(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, doc: documents with every term of the query. In a range the term in fewest documents leads, and a range without one of the terms is left at once."""
    terms = terms.join(terms.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid")

    def answer_of(table: pa.Table) -> Callable:
        at = table.column("at").combine_chunks()
        ends, values = at.offsets.to_numpy(), at.values.to_numpy()

        def answer(rows: list) -> tuple[np.ndarray, np.ndarray]:
            none = np.zeros(0, np.int64)
            if len(rows) < rows[0][0]:
                return none, none
            lists = sorted((np.concatenate([values[ends[r] : ends[r + 1]] for r in some]) for _, some in rows), key=len)
            both = lists[0]
            for other in lists[1:]:
                both = both[np.isin(both, other, assume_unique=True)]
                if not len(both):
                    break
            return both, np.ones(len(both), np.int64)

        return answer

    return _containing(postings, terms, F.col("n"), answer_of).drop("times")


def _apart(starts: np.ndarray, gap: int) -> np.ndarray:
    """Those of the places (in order) that are counted from the left if each has to be `gap` or more behind the last one counted."""
    if len(starts) < 2 or (starts[1:] - starts[:-1]).min() >= gap:
        return starts
    kept, least = [], -1
    for start in starts.tolist():
        if start >= least:
            kept.append(start)
            least = start + gap
    return np.array(kept, np.int64)


def containing_phrase(postings: DataFrame, terms: DataFrame, apart: bool = False) -> DataFrame:
    """qid, doc, times: documents where the query's tokens stand side by side, by positions. Overlapping occurrences count each; with `apart`, occurrences are counted from the left, and one that follows the last
    one counted without a token between them is not."""
    terms = terms.join(terms.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid")

    def answer_of(table: pa.Table) -> Callable:
        at, tf, positions = (table.column(c).combine_chunks() for c in ("at", "tf", "positions"))
        ends, values, counts = at.offsets.to_numpy(), at.values.to_numpy().astype(np.int64), tf.values.to_numpy()
        first, place = positions.offsets.to_numpy(), positions.values.to_numpy().astype(np.int64)

        def answer(rows: list) -> tuple[np.ndarray, np.ndarray]:
            none = np.zeros(0, np.int64)
            if len(rows) < rows[0][0]["n"]:
                return none, none
            starts = None
            for w, some in sorted(rows, key=lambda x: sum(first[r + 1] - first[r] for r in x[1])):
                doc = np.concatenate([np.repeat(values[ends[r] : ends[r + 1]], counts[ends[r] : ends[r + 1]]) for r in some])
                here = np.concatenate([place[first[r] : first[r + 1]] for r in some])
                for p in w["places"]:
                    begin = (doc << 32 | here)[here >= p] - p
                    starts = begin if starts is None else starts[np.isin(starts, begin, assume_unique=True)]
                    if not len(starts):
                        return none, none
            if apart:
                starts = _apart(np.sort(starts), sum(len(w["places"]) for w, _ in rows) + 1)
            return np.unique(starts >> 32, return_counts=True)

        return answer

    return _containing(postings, terms, F.struct("n", "places"), answer_of)
