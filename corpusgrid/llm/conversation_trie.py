"""The prefix trie of conversations, as a burst trie.

A turn's id is a digest of role and text. A prefix is named by 128 bits put together from the ids and places of its turns, so that the children of a node are the names that its
members have one place further on. Equal conversations are one member with a weight.

All members begin in the container of the root. A container of more than `capacity` turns is burst by the next turn id: its node becomes a head of the trie, and its members fall into the containers
of the children. A round bursts some places at once, twice as many as the round before, and looks only at members whose container is still too large. What remains holds few
turns, or is one long member alone: containers are sorted by place, deepest first, and swept into nodes, level by level; a container of one member is a
chain, whose sums follow from the member's own words.

A node's subtree sums are known in a container. Those of a head come from its members: a node counts for the smallest conversation that has it, so that the distinct
words and leaves under a head are sums over its members, whatever the depth. No group of members, no conversation and no list of ids has to fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import read, salted_join, words
from corpusgrid.session import materialise

CAPACITY = 1024  # turns of a container
STEP = 4096  # turns of a conversation that are put together at once
CHUNK = 1 << 16  # ids of a node that are joined at once
ROOT = b"\0" * 16
NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, parent_conv_id long, top boolean"


def turn_ids(chats: DataFrame) -> DataFrame:
    """conv, turn, turn_id (128 bits of a digest of role and text), words; rows without a conversation id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return chats.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("turn_id"), F.size(words(text)).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """`turns` with `place`, from 1 within a conversation: by turn, null first; rows of equal turn follow one another by their digest.

    Rows are sorted over range partitions. Only the first conversation of a partition can have begun in an earlier one, so what is carried over is a row for each partition at most.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "turn_id"]
    rows = materialise(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "trie-sorted")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "part", "begin", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return rows.join(runs, ["conv", "part"]).select("conv", (F.col("at") - F.col("begin") + F.col("before") + 1).alias("place"), "turn_id", "words")


def _name(x: Column, y: Column) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (x, y))))


def paths(turns: DataFrame) -> DataFrame:
    """conv, place, node (name of the prefix that ends there), parent, words (of the turn), upto (words of the prefix)."""
    term = [F.xxhash64("turn_id", "place").alias("x"), F.xxhash64("place", "turn_id").alias("y")]
    rows = materialise(turns.select("conv", "place", "words", *term, F.expr("(place - 1) div " + str(STEP)).alias("step")), "trie-terms")
    sums = [F.bit_xor("x").alias("x0"), F.bit_xor("y").alias("y0"), F.sum("words").alias("words0")]
    ahead = Window.partitionBy("conv").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv", "step").agg(*sums)
    runs = runs.select("conv", "step", F.bit_xor("x0").over(ahead).alias("x0"), F.bit_xor("y0").over(ahead).alias("y0"), F.sum("words0").over(ahead).alias("words0")).where("step > 0")
    so_far = Window.partitionBy("conv", "step").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.bit_xor("x").over(so_far).alias("xs"), F.bit_xor("y").over(so_far).alias("ys"), F.sum("words").over(so_far).alias("upto"))
    rows = rows.join(runs, ["conv", "step"], "left")
    x, y = (F.col(c).bitwiseXOR(F.coalesce(f"{c[0]}0", F.lit(0))) for c in ("xs", "ys"))
    rows = rows.select("conv", "place", "words", (F.col("upto") + F.coalesce("words0", F.lit(0))).alias("upto"), "x", "y", x.alias("xs"), y.alias("ys"))
    return rows.select("conv", "place", _name(F.col("xs"), F.col("ys")).alias("node"), _name(F.col("xs").bitwiseXOR(F.col("x")), F.col("ys").bitwiseXOR(F.col("y"))).alias("parent"), "words", "upto")


def burst(members: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, rows of members at heads, containers: the place of each member's last head, and the container behind it)."""
    heads, at_heads, closed = [], [], []
    places, window = 2, members.where("place <= 2")
    while True:
        window = materialise(window, "trie-window")
        sums = [F.count(F.lit(1)).alias("members"), F.sum(F.col("n") - F.col("place") + 1).alias("turns"), F.sum("weight").alias("n_convs"), F.min("conv").alias("smallest")]
        counts = window.groupBy("node").agg(*sums, F.min("parent").alias("parent"), F.min("place").alias("depth"), F.min("words").alias("words"))
        large = materialise(counts.where((F.col("turns") > capacity) & (F.col("members") > 1)), "trie-heads")
        told = materialise(salted_join(window, large.select("node", "smallest"), ["node"], "left"), "trie-told")
        head = F.col("smallest").isNotNull()
        by = told.groupBy("conv").agg(F.max(F.when(head, F.col("place"))).alias("last"), F.min_by("node", F.when(~head, F.col("place"))).alias("container"), F.max("place").alias("seen"), F.min("place").alias("from"), F.max("n").alias("n"))
        by = materialise(by.withColumn("last", F.coalesce("last", F.col("from") - 1)), "trie-places")
        heads.append(large)
        at_heads.append(told.where(head))
        goes_on = (F.col("last") == F.col("seen")) & (F.col("seen") < F.col("n"))
        closed.append(by.where((F.col("last") < F.col("seen"))).select("conv", "last", "container"))
        still = by.where(goes_on).select("conv", "seen")
        if still.isEmpty():
            break
        places *= 2
        window = salted_join(members, still, ["conv"]).where((F.col("place") > F.col("seen")) & (F.col("place") <= F.col("seen") + places)).drop("seen")

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return union(heads), union(at_heads), union(closed)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows come sorted by container, place (deepest first) and node. Two levels of one container are held."""
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.bool_()]
    out: list[list] = []
    now, level, node = None, None, None
    below: dict[bytes, list] = {}  # children, leaves and saved words that the level below has given to a node
    waiting: dict[bytes, list] = {}  # finished nodes, by parent, until the parent's smallest conversation is known

    def finish() -> None:
        name, parent, depth, smallest, convs, own = node
        children, leaves, saved = below.pop(name, (0, 0, 0))
        leaves, saved = leaves or 1, saved + (convs - 1) * own
        for child in waiting.pop(name, ()):
            out.append([*child, smallest, False])
        up = below.setdefault(parent, [0, 0, 0])
        up[0], up[1], up[2] = up[0] + 1, up[1] + leaves, up[2] + saved
        waiting.setdefault(parent, []).append([name, parent, depth, smallest, convs, children, leaves, saved, own])

    def close() -> None:
        finish()
        for tops in waiting.values():
            out.extend([*top, None, True] for top in tops)
        below.clear()
        waiting.clear()

    for batch in batches:
        for container, name, parent, place, conv, weight, own in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if container != now:
                if node:
                    close()
                now, level, node = container, place, [name, parent, place, conv, 0, own]
            elif name != node[0]:
                finish()
                level, node = place, [name, parent, place, conv, 0, own]
            node[3] = min(node[3], conv)
            node[4] += weight
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
    if node:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids of the conversations that end at the node, in ascending order, joined by commas. Ids are joined in pieces where they are sorted; then pieces go by in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, node, held = TaskContext.get().partitionId(), 0, None, []
        out: list[tuple] = []
        for batch in batches:
            for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != node or len(held) == CHUNK:
                    if held:
                        out.append((node, part, number, ",".join(held)))
                    number, node, held = number + 1, name, []
                held.append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["node", "part", "number", "ids"])
                out.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip((node, part, number, ",".join(held)), strict=True)], names=["node", "part", "number", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == node:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["node", "ends_sha256"])
                out.clear()
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    rows = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    rows = materialise(rows.mapInArrow(pieces, "node binary, part long, number long, ids string"), "trie-ends")
    return rows.repartition("node").sortWithinPartitions("node", "part", "number").select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The nodes of the conversations `ids` (conv, distinct), whose turns are `turns` (conv, place from 1 on, turn_id, words); columns as of `prefix_trie`."""
    known = materialise(paths(turns), "trie-paths")
    last = known.groupBy("conv").agg(F.max_by(F.struct("node", "place", "upto"), "place").alias("end")).select("conv", "end.*")
    ends = ids.join(last, "conv", "left").select("conv", F.coalesce("node", F.lit(ROOT)).alias("node"), F.coalesce("place", F.lit(0)).alias("n"), F.coalesce("upto", F.lit(0)).alias("total"))
    ends = materialise(ends, "trie-convs")
    root = ends.agg(F.min("conv").alias("smallest"), F.count(F.lit(1)).alias("n_convs")).first()
    same = ends.groupBy("node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"), F.min("n").alias("n"), F.min("total").alias("total"))
    same = materialise(same.drop("node"), "trie-distinct")
    members = materialise(salted_join(known, same, ["conv"]), "trie-members")
    heads, at_heads, closed = burst(members, capacity)
    sizes = closed.groupBy("container").agg(F.count(F.lit(1)).alias("size"))
    rest = materialise(salted_join(members, closed.join(sizes, "container"), ["conv"]).where("place > last"), "trie-rest")
    left = F.col("total") - F.col("upto") + F.col("words")
    chain = rest.where("size = 1").select(
        "node", "parent", F.col("place").alias("depth"), F.col("conv").alias("conv_id"), F.col("weight").alias("n_convs"), (F.col("place") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * left).alias("saved_tokens"), "words", F.when(F.col("place") > F.col("last") + 1, F.col("conv")).alias("parent_conv_id"), (F.col("place") == F.col("last") + 1).alias("top"),
    )
    shared = rest.where("size > 1").select("container", "node", "parent", "place", "conv", "weight", "words")
    shared = shared.repartition("container").sortWithinPartitions("container", F.desc("place"), "node").mapInArrow(sweep, NODE)
    below = materialise(chain.unionByName(shared), "trie-below")
    inner = heads.select("node", "parent", "depth", F.col("smallest").alias("conv_id"), "n_convs", "words")
    owned = below.select("conv_id", "words", (F.col("n_children") == 0).cast("long").alias("leaf")).unionByName(inner.select("conv_id", "words", F.lit(0).cast("long").alias("leaf")))
    owned = owned.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("words").alias("own"), F.sum("leaf").alias("leaf"))
    top = F.lit(0).cast("long")
    passing = at_heads.select("conv", "node", "words", "upto", "weight", "total", "smallest").unionByName(same.select("conv", F.lit(ROOT).alias("node"), top.alias("words"), top.alias("upto"), "weight", "total", F.lit(root["smallest"]).cast("long").alias("smallest")))
    passing = salted_join(materialise(passing, "trie-passing"), materialise(owned, "trie-owned"), ["conv"], "left")
    distinct = F.when(F.col("smallest") == F.col("conv"), left).otherwise(F.coalesce("own", F.lit(0)))
    sums = passing.groupBy("node").agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), (F.sum(F.col("weight") * left) - F.sum(distinct)).alias("saved_tokens"))
    base = ends.sparkSession.createDataFrame([(ROOT, None, 0, root["smallest"], root["n_convs"], 0)] if root["n_convs"] else [], "node binary, parent binary, depth long, conv_id long, n_convs long, words long")
    inner = materialise(inner.unionByName(base), "trie-inner")
    tops = below.where("top").select("parent").unionByName(inner.select("parent")).where("parent is not null")
    children = tops.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = inner.join(sums, "node").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    inner = materialise(inner.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1))), "trie-inner-sums")
    columns = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    under = materialise(below.where("top").select(*columns).unionByName(inner.where("parent is not null").select(*columns)), "trie-under")
    under = salted_join(under, inner.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), ["parent"])
    top_row = inner.where("parent is null").select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))
    nodes = below.where("not top").select(*columns, "parent_conv_id").unionByName(under).unionByName(top_row)
    nodes = nodes.join(end_digests(ends), "node", "left")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def prefix_trie(chats: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """node, parent (names, 16 bytes), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct run of first turns.

    `chats` has conv_id (whole numbers), turn, role and text. Null roles and texts count as empty; rows without a conversation id are left out; a null turn comes first; rows of equal turn follow one another
    by their digest, and repeated rows are turns of their own. Other columns are not looked at. Nothing comes of an empty table.
    """
    turns = materialise(numbered(turn_ids(chats)), "trie-turns")
    return trie(turns, turns.select("conv").distinct(), capacity)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of the contract: the first h turns of conversation c - c % 20, then c's own behind its first h, with h = crc32(c) % 4; and all ids."""
    h = (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    base = F.col("conv") - F.expr("pmod(conv, 20)")
    first = turns.where((F.col("place") <= 3) & (base == F.col("conv"))).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "turn_id", "words"))).alias("firsts"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns")).select("conv", base.alias("base"), h.alias("h"))
    convs = convs.join(first, "base", "left").select("conv", F.slice(F.coalesce("firsts", F.array().cast("array<struct<place:bigint,turn_id:binary,words:bigint>>")), F.lit(1), F.col("h")).alias("taken"))
    convs = materialise(convs, "trie-heads-of")
    borrowed = convs.select("conv", F.explode("taken").alias("t")).select("conv", "t.place", "t.turn_id", "t.words")
    own = materialise(turns.where(F.col("place") > h), "trie-own")
    own = salted_join(own, convs.select("conv", F.size("taken").alias("k")), ["conv"])
    own = own.select("conv", (F.col("place") - h + F.col("k")).alias("place"), "turn_id", "words")
    return borrowed.unionByName(own), convs.select("conv")


def query(spark, sf_dir: str) -> DataFrame:
    turns = materialise(numbered(turn_ids(read(spark, sf_dir, "conversations"))), "trie-turns")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return trie(*rebuilt(turns)).select(*(F.col(c).cast("long") for c in columns), "ends_sha256")
