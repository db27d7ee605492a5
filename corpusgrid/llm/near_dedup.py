"""MinHash near-dedup with an LSH forest.

Documents of the same shingle set are one node. Each node has `trees` keys of `depth` MinHash values. Per tree the
keys are sorted (range partitions, external sort), so that nodes with long common prefixes are neighbours. A region is a run
of neighbours that share `least` values at least. A region of at most `region` nodes gives all its pairs; a larger one
is looked at a value deeper, part by part, until its parts are small or the key ends, and its neighbours stay
candidates at every depth, so that dense regions use long prefixes and sparse ones short prefixes. Parts that are still
large at full depth are copies in all but name: each of their nodes is paired with its neighbour and with the part's first node. Set
sizes and a 128-bit sketch (a bit of each MinHash value) drop pairs far below the threshold. Of the rest, parities of hashed shingles drop without loss nearly all
that are no links, before any full set is sent; what is left is confirmed on full shingle sets.
Components come from alternating star steps, each written to the shared folder.

What large regions may have missed is then settled exactly. Of their nodes, those that can have a link at all (three quarters of
whose shingles stand in another such node) and are in different components meet in blocks. There set sizes and
the parities of hashed shingles, whose differing bits never outnumber the differing shingles, rule out pairs without loss; the others are compared on
full sets, and only links that join components leave a block. Regions that the end of a block of sorted rows cuts are looked at in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm import hashing
from corpusgrid.llm.common import released, salted_join, small_batches
from corpusgrid.llm.tokens import slices
from corpusgrid.session import materialise

TREES, DEPTH, LEAST, REGION, WORDS, PERCENT = 32, 5, 2, 8, 5, 75
SKETCH, SKETCH_BITS = 128, 88  # of 128 bits, 112 agree on average at the threshold, and fewer than 88 once in 100 million pairs
BLOCK, BLOCK_SHINGLES, FEW, HELD = 2048, 1 << 18, 500_000, 1 << 16
PAIRS = 256  # of a home that are confirmed in one place
ODD_BITS = 2048  # parities that stand for a set while pairs are ruled out
TEXT_BYTES = 1 << 18  # of texts that are worked on at once: a slice takes about 80 times its size while its words are hashed
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, all in a row, and where each text's begin (with the end last)."""
    n = len(texts)
    data, begin = hashing.joined(texts, _LOWER)
    starts, _, words = hashing.words(data)
    first = np.searchsorted(starts, begin)
    doc = np.repeat(np.arange(n), np.diff(first))
    whole = hashing.windows(words, n_words)
    valid = doc[: len(whole)] == doc[n_words - 1 :] if len(doc) >= n_words else np.zeros(0, bool)
    values, owner = [whole[valid]], [doc[: len(whole)][valid]]
    for short in range(1, n_words):  # fewer words: the whole sequence
        own = np.flatnonzero(np.diff(first) == short)
        if len(own):
            values.append(hashing.windows(words, short)[first[own]])
            owner.append(own)
    value, own = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])) if len(value) else np.zeros(0, bool)
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(n + 1))


def signatures(values: np.ndarray, starts: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """count MinHash values (32 bits) of each set; sets must not be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(starts) - 1, count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts[:-1])
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def nodes(docs: DataFrame, trees: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """id, digest (of the text), n (set size), print (16 bytes that stand for the set; null if empty), keys (all trees' keys in a row), sketch (16 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, TEXT_BYTES):
                values, starts = shingles(texts.slice(a, b - a))
                size = np.diff(starts)
                some = np.flatnonzero(size)
                prints, keys, sketch = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if len(some):
                    heads = starts[:-1][some]
                    bounds = np.append(heads, len(values))
                    sig = signatures(values, bounds, max(trees * depth, SKETCH))
                    one = np.add.reduceat(hashing.mix(values), heads)
                    two = np.add.reduceat(hashing.mix(values ^ np.uint64(0x5851F42D4C957F2D)), heads)
                    pair = np.column_stack([one, two])
                    tree = sig[:, : trees * depth].astype(">u4")
                    bits = np.packbits((sig[:, :SKETCH] >> np.uint32(7) & np.uint32(1)).astype(np.uint8), axis=1)
                    for i, d in enumerate(some):
                        prints[d], keys[d], sketch[d] = pair[i].tobytes(), tree[i].tobytes(), bits[i].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size), *(pa.array(x, pa.binary()) for x in (prints, keys, sketch))], names=["id", "digest", "n", "print", "keys", "sketch"])

    rows = _texts(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    return rows.mapInArrow(lambda batches: released(run(batches)), "id long, digest long, n long, print binary, keys binary, sketch binary")


def regions(tree: np.ndarray, keys: np.ndarray, least: int, region: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs among rows sorted by tree and key."""
    n, depth = keys.shape
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    same = (tree[1:] == tree[:-1]) & np.ones(n - 1, bool)
    common = np.zeros(n - 1, int)
    for k in range(depth):
        same = same & (keys[1:, k] == keys[:-1, k])
        common += same
    near = np.flatnonzero(common >= least)
    left, right = [near], [near + 1]
    done = np.zeros(n, bool)  # rows whose region has been small enough
    for d in range(least, depth + 1):
        head = np.flatnonzero(np.append(True, common < d))
        size = np.diff(np.append(head, n))
        fits = (size > 2) & (size <= region) & ~done[head]
        for step in range(2, region):
            h, s = head[fits & (size > step)], size[fits & (size > step)]
            at = np.repeat(h - np.cumsum(s - step) + (s - step), s - step) + np.arange(int((s - step).sum()))
            left.append(at)
            right.append(at + step)
        done[np.repeat(head, size)[np.repeat(size <= region, size)]] = True
    large = (size > region) & ~done[head]
    h, s = head[large], size[large]
    at = np.repeat(h - np.cumsum(s - 2) + (s - 2), s - 2) + np.arange(int((s - 2).sum())) + 2
    left.append(np.repeat(h, s - 2))
    right.append(at)
    return np.concatenate(left), np.concatenate(right)


def unsettled(tree: np.ndarray, keys: np.ndarray, least: int, region: int) -> np.ndarray:
    """Places of the rows whose region is larger than `region`, or the first or last of these rows and so perhaps cut."""
    same = (tree[1:] == tree[:-1]) & (keys[1:, :least] == keys[:-1, :least]).all(axis=1)
    head = np.flatnonzero(np.append(True, ~same))
    size = np.diff(np.append(head, len(tree)))
    open_ = size > region
    open_[[0, -1]] = True
    return np.flatnonzero(np.repeat(open_, size))


def candidates(distinct: DataFrame, trees: int, depth: int, least: int, region: int, percent: int, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """a < b: pairs of node ids; tree, key, id, n: the members of regions not all of whose pairs are among them. A task holds about `held` rows at a time."""
    width = 4 * depth
    rows = distinct.select("id", F.col("n").cast("int").alias("n"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "keys")
    rows = rows.select("tree", F.substring("keys", F.col("tree") * width + 1, F.lit(width)).alias("key"), "id", "n", "sketch")
    rows = rows.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    names = ["a", "b", "tree", "key", "n"]

    def judged(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(got).combine_chunks()
        tree, ids, n = (table.column(c).to_numpy() for c in ("tree", "id", "n"))
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u4").reshape(-1, depth)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
        a, b = regions(tree, keys, least, region)
        fits = (100 * np.minimum(n[a], n[b]).astype(np.int64) >= percent * np.maximum(n[a], n[b]).astype(np.int64)) & (ids[a] != ids[b])
        a, b = a[fits], b[fits]
        ok = SKETCH - np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) >= SKETCH_BITS
        pairs = np.unique(np.sort(np.column_stack([ids[a][ok], ids[b][ok]]), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.binary()), pa.nulls(len(pairs), pa.int32())], names=names)
        left = unsettled(tree, keys, least, region)
        for k in range(0, len(left), 100_000):
            at = left[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.array(tree[at].astype(np.int32)), pa.array([keys[i, :least].tobytes() for i in at], pa.binary()), pa.array(n[at].astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            got.append(batch)
            size += batch.num_rows
            if size >= held:
                yield from judged(got)
                got, size = [], 0
        if size:
            yield from judged(got)

    found = materialise(rows.mapInArrow(lambda batches: released(run(batches)), "a long, b long, tree int, key binary, n int"), "candidates")
    return found.where("b is not null").select("a", "b").distinct(), found.where("b is null").select("tree", "key", F.col("a").alias("id"), "n")


def mixed(own: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, by: tuple[str, ...] = ("tree", "key")) -> DataFrame:
    """`by`, blocks of the regions whose nodes are in more than one component."""
    sizes = own.groupBy(*by).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("shingles") / block_shingles)).cast("long")
    return sizes.where("low < high").select(*by, blocks.alias("blocks"))


def homes(own: DataFrame) -> DataFrame:
    """home, id, root, n: regions that have the same smallest node are one. Trees find much the same regions again and again; so a node's set is sent once for all of them."""
    home = own.groupBy("tree", "key").agg(F.min("id").alias("home"))
    return salted_join(own, home, ["tree", "key"]).select("home", "id", "root", "n").distinct()


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """id, set of those that can have a link: enough of their shingles stand in another set too. Shingles are counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                values = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in values])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(ids)], names=["shingle", "id"])

    alone = sets.mapInArrow(lambda batches: released(run(batches)), "shingle long, id long").groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("id"))
    alone = alone.where("times = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    n = F.expr("octet_length(set) div 8")
    return sets.join(alone, "id", "left").where(100 * (n - F.coalesce("alone", F.lit(0))) >= percent * n).select("id", "set")


def parities(n: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A row of bits for each set: bit i is the parity of its shingles that hash to i. The bits in which two rows differ are at most as many
    as the shingles in which the sets differ."""
    size = 1 << int(np.clip(np.ceil(np.log2(4 * max(1.0, float(np.median(n))))), 8, 13))
    bits = np.zeros((len(n), size), np.uint8)
    np.add.at(bits.reshape(-1), np.repeat(np.arange(len(n)) * size, n) + (hashing.mix(values) & np.uint64(size - 1)).astype(np.int64), np.uint8(1))
    return np.packbits(bits & 1, axis=1).view(np.uint64)


def odd_bits(values: np.ndarray, starts: np.ndarray, size: int = ODD_BITS) -> np.ndarray:
    """The same for many sets in a row, always `size` bits, as rows of bytes."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = owner * size + (hashing.mix(values) & np.uint64(size - 1)).astype(np.int64)
    bits = np.bincount(at, minlength=(len(starts) - 1) * size).reshape(-1, size) & 1
    return np.packbits(bits.astype(np.uint8), axis=1)


def compare(alone: bool, mine: np.ndarray, ids: np.ndarray, root: np.ndarray, n: np.ndarray, values: np.ndarray, percent: int) -> np.ndarray:
    """Links among these sets (not alone: between those that are `mine` and the others) that join different roots; links that the ones before imply are left out."""
    left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(mine), np.flatnonzero(~mine))
    out: list[tuple[int, int]] = []
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    head, root = np.cumsum(n) - n, root.copy()
    words, codes = np.unique(values, return_inverse=True)
    has, odd = np.zeros(len(words), bool), parities(n, values)
    for a in left:
        fits = (root[right] != root[a]) & (100 * np.minimum(n[right], n[a]) >= percent * np.maximum(n[right], n[a]))
        if alone:
            fits &= right > a
        b = right[fits]
        if not len(b):
            continue
        differ = np.bitwise_count(odd[b] ^ odd[a]).sum(axis=1, dtype=np.int64)
        b = b[differ * (100 + percent) <= (100 - percent) * (n[b] + n[a])]
        if not len(b):
            continue
        has[codes[head[a] : head[a] + n[a]]] = True
        for k in range(0, len(b), 256):
            some = b[k : k + 256]
            size = n[some]
            start = np.cumsum(size) - size
            at = np.repeat(head[some] - start, size) + np.arange(int(size.sum()))
            both = np.add.reduceat(has[codes[at]].astype(np.int64), start)
            for x in some[100 * both >= percent * (n[a] + size - both)]:
                if root[x] != root[a]:
                    out.append((int(ids[a]), int(ids[x])))
                    root[root == root[x]] = root[a]
        has[codes[head[a] : head[a] + n[a]]] = False
    return np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1)


def open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root, n, regions (an array of tree and key): a row for each member, whatever the number of its regions, so that roots are joined once for each node."""
    own = members.groupBy("id").agg(F.first("n").alias("n"), F.collect_list(F.struct("tree", "key")).alias("regions"))
    own = own.join(roots.withColumnRenamed("node", "id"), "id", "left")
    return own.select("id", F.coalesce("root", "id").alias("root"), "n", "regions")


def across(members: DataFrame, roots: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str, block: int = BLOCK, places: DataFrame | None = None) -> DataFrame:
    """a < b: links that join the components of all of a region's members that are linked with one another.

    Regions of the same smallest member are put together, and cut into blocks of about `block` members or BLOCK_SHINGLES shingles by a hash of the id; every two blocks, and each
    with itself, are one piece of work.
    """
    region = ["tree", "key"]
    own = open_nodes(members, roots).withColumn("region", F.explode("regions"))
    own = materialise(own.select("region.*", "id", "root", "n"), "open-regions")
    own = materialise(salted_join(own, mixed(own), region).drop("blocks"), "mixed-regions")
    if own.isEmpty():
        return own.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = materialise(linkable(shingle_sets(docs, own.select("id").distinct(), id_col, text_col, places).select("id", "set"), percent), "linkable")
    own = materialise(homes(materialise(own.join(sets.select("id"), "id"), "linkable-members")), "homes")
    own = materialise(salted_join(own, mixed(own, block, by=("home",)), ["home"]), "mixed-homes").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    own = own.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    work = ["home", "one", "two"]
    own = own.select("home", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "id", "root", "set")
    own = own.repartition(*work).sortWithinPartitions(*work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            one, two, mine, ids, root = (table.column(c).to_numpy() for c in ("one", "two", "mine", "id", "root"))
            sets = table.column("set").to_pylist()
            n = np.array([len(x) // 8 for x in sets], np.int64)
            found = [compare(one[s] == two[s], mine[s:e] == one[s], ids[s:e], root[s:e], n[s:e], np.frombuffer(b"".join(sets[s:e]), np.uint64), percent) for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        rest: list[pa.RecordBatch] = []  # the piece of work that the batches so far have not ended
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest[-1:], batch])
            new = np.zeros(len(table) - 1, bool)
            for c in work:
                column = table.column(c)
                new |= pa.compute.not_equal(column.slice(1), column.slice(0, len(table) - 1)).to_numpy()
            new = np.flatnonzero(new) + 1 + (-len(rest[-1]) if rest else 0)
            new = new[new >= 0]
            if len(new):
                whole = pa.Table.from_batches([*rest, batch.slice(0, new[-1])])
                yield settle(whole, np.unique(np.append(0, new[:-1] + sum(map(len, rest)))))
                rest = []
            rest.append(batch.slice(new[-1] if len(new) else 0))
        if rest:
            yield settle(pa.Table.from_batches(rest), np.array([0]))

    return own.mapInArrow(lambda batches: released(run(batches)), "a long, b long").distinct()


def shingle_sets(docs: DataFrame, used: DataFrame, id_col: str, text_col: str, places: DataFrame | None = None) -> DataFrame:
    """id, set (its shingles in order), odd (their parities) of the rows whose id is in `used`. With `places` (id, doc, digest) an id stands for the text of that digest of row `doc`."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, TEXT_BYTES):
                values, starts = shingles(texts.slice(a, b - a))
                binary = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer(values)])
                odd = pa.array([x.tobytes() for x in odd_bits(values, starts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), binary, odd], names=["id", "set", "odd"])

    used = materialise(used, "used")
    number = used.count()
    hint = "broadcast" if number <= FEW else "merge"  # few: the texts need no exchange
    if places is None:
        own = _texts(docs, id_col, text_col).join(used.hint(hint), "id", "left_semi")
    else:
        wanted = used.join(places, "id").hint(hint)
        own = _texts(docs, id_col, text_col).select(F.col("id").alias("doc"), F.xxhash64("text").alias("digest"), "text").join(wanted, ["doc", "digest"]).select("id", "text")
    own = materialise(own.mapInArrow(lambda batches: released(sets(batches)), "id long, set binary, odd binary"), "shingle-sets")
    return own if own.count() == number else own.dropDuplicates(["id"])  # repeated rows


def together(pairs: DataFrame, size: int = PAIRS) -> DataFrame:
    """home, run, id, others: every pair stands once, as one of the `others` of its smaller id, in a run of its home that has both ids.

    A pair's home is the smallest of its ids' labels, an id's label the smallest id among it and its partners. So the pairs of copies of one another
    mostly have one home, to which a set is sent once for all of them. A home of more than `size` pairs is dealt over several runs.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    labels = ends.groupBy("id").agg(F.min("a").alias("label"))
    homed = materialise(salted_join(ends, labels, ["id"]).groupBy("a", "b").agg(F.min("label").alias("home")), "homed-pairs")
    runs = homed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / size).alias("runs"))
    homed = salted_join(homed, runs, ["home"]).withColumn("run", F.pmod(F.xxhash64("a", "b"), F.col("runs")))
    both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("other")))
    return homed.select("home", "run", F.explode(both).alias("end")).groupBy("home", "run", "end.id").agg(F.collect_list("end.other").alias("others"))


def possible(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that the parities in `own` (id, set, odd) do not rule out."""
    n = F.expr("octet_length(set) div 8")
    both = pairs
    for end in ("a", "b"):
        both = salted_join(both, own.select(F.col("id").alias(end), n.alias(f"n_{end}"), F.col("odd").alias(f"odd_{end}")), [end], counted=pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5)) if batch.num_rows else (np.zeros((0, 1), np.uint64),) * 2
            differ = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            fits = differ * (100 + percent) <= (100 - percent) * (batch.column(2).to_numpy() + batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(fits)) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(lambda batches: released(run(batches)), "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str, places: DataFrame | None = None) -> DataFrame:
    """Those of the pairs with 100 * intersection >= percent * union of their full sets. Sets are sent only for pairs that their parities do not rule out."""

    def linked(one: np.ndarray, two: np.ndarray) -> bool:
        short, long = sorted((one, two), key=len)
        if 100 * len(short) < percent * len(long):
            return False
        at = np.searchsorted(long, short)
        at[at == len(long)] = 0
        both = int((long[at] == short).sum())
        return 100 * both >= percent * (len(one) + len(two) - both)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, sets, asked = None, {}, []  # the run that is being read

        def links() -> list[tuple[int, int]]:
            return [(a, b) for a, others in asked for b in others if linked(sets[a], sets[b])]

        for batch in batches:
            out = []
            for i, (home, number, a, others) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if (home, number) != run:
                    out += links()
                    run, sets, asked = (home, number), {}, []
                sets[a] = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if others:
                    asked.append((a, others))
            yield batch_of(out)
        yield batch_of(links())

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = shingle_sets(docs, used, id_col, text_col, places)
    pairs = materialise(possible(pairs, own, percent), "possible-pairs")
    sent = salted_join(materialise(together(pairs), "pairs-together"), own, ["id"]).select("home", "run", "id", "others", "set")
    sent = sent.repartition("home", "run").sortWithinPartitions("home", "run")
    return sent.mapInArrow(lambda batches: released(check(batches)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: every linked node with the smallest node of its component, itself left out if it is that one.

    Large-star and small-star steps in turn, until the links no longer change. Minima are pre-aggregated before they are shuffled, and a hub's links are dealt over several tasks.
    """
    links = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        links = materialise(small.where("u <> v").distinct(), "links")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, region: int = REGION, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Null or empty text: an empty set, linked with nothing. A null id links with nothing and has a null component_id and
    kept true. Ids are integers and should name one document each: rows of one id and text get equal results, and where the texts differ
    each row gets the component of its own text. `text_digest` (xxhash64 of the text) tells such rows apart. The call runs the jobs up to the components.
    """
    with small_batches(docs.sparkSession):
        own = materialise(nodes(docs, trees, depth, id_col, text_col), "signatures")
        some = own.where("print is not null and id is not null")
        # one node for each distinct set; sums and minima are formed before the shuffle, whatever the number of copies
        groups = some.groupBy("print").agg(F.min(F.struct("id", "digest", "n", "keys", "sketch")).alias("first"))
        groups = materialise(groups.select(F.monotonically_increasing_id().alias("id"), "print", F.col("first.id").alias("doc"), "first.digest", "first.n", "first.keys", "first.sketch"), "nodes")
        places = groups.select("id", "doc", "digest")
        pairs, members = candidates(groups.select("id", "n", "keys", "sketch"), trees, depth, least, region, percent, held)
        links = materialise(confirmed(materialise(pairs, "pairs"), docs, percent, id_col, text_col, places), "confirmed")
        roots = components(links)
        links = materialise(across(members, roots, docs, percent, id_col, text_col, places=places), "links-across")
        if not links.isEmpty():
            roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = materialise(groups.select("print", "doc", F.col("id").alias("node")).join(roots, "node", "left").select("print", "doc", F.coalesce("root", "node").alias("root")), "roots")
    lowest = named.groupBy("root").agg(F.min("doc").alias("component"))  # the smallest document of a component
    named = salted_join(named, lowest, ["root"]).select("print", "component")
    out = salted_join(some.select("id", "digest", "n", "print"), named, ["print"]).select("id", "digest", "n", "component")
    empty = own.where("print is null or id is null").select("id", "digest", "n", F.col("id").alias("component"))
    out = out.unionByName(empty)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"), F.col("digest").alias("text_digest"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_digest")
