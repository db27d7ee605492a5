r"""Chat formatting over a prefix tree.

A turn is written `<|im_start|>role\ntext<|im_end|>\n`, as token ids. Conversations that share their first turns share the nodes of
those turns: a node is named by a 128-bit hash of all turns up to its own, so that the tree is the distinct names and no subtree
has to meet in one task. The stream holds every node once, depth first. A node carries the position id of its first token in its conversations and the
interval of the stream that it fills; a conversation carries the intervals of the stream that are its turns, which are few, as turns between two branchings
stand side by side. What a node attends to besides itself are the intervals of its owner, a conversation that has it, up to the node (`ancestors`).

Names of prefixes come from a running hash that can be put together from parts, so a conversation of any length is cut over range partitions.
Depth-first order is the order of conversations by their branchings: where a node has several children, the child's name decides; a node belongs to the first
conversation that has it. A conversation's key holds one name for each branching on its way. Rows that share a node or a conversation are dealt over several tasks.

Control strings inside texts get a backslash: `<|` becomes `<\|`, `<\|` becomes `<\\|` and so on, so that they cannot be taken for marks and
can be read back. In roles backslashes and line feeds are escaped too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import salted_join
from corpusgrid.session import materialise

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_BASE, _MASK = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (1 << 64) - 1
NODE = ["conv", "place"]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def write_turn(role: str | None, text: str | None) -> str:
    role = escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))
    return f"{START}{role}\n{escape(text or '')}{END}\n"


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn: start and end of the text as it stands in `formatted`."""
    out, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(turn[1]))
        out.append((role, unescape(turn[2]), turn.start(2), turn.end(2)))
        at = turn.end()
    return out


class Prefix:
    """What is known of a run of turns: their number, tokens and hash. The run of two runs can be worked out from theirs."""

    __slots__ = ("n", "one", "tokens", "two")

    def __init__(self, n: int = 0, tokens: int = 0, one: int = 0, two: int = 0) -> None:
        self.n, self.tokens, self.one, self.two = n, tokens, one, two

    def then(self, other: Prefix) -> Prefix:
        powers = (pow(b, other.n, 1 << 64) for b in _BASE)
        one, two = ((a * p + b) & _MASK for a, p, b in zip((self.one, self.two), powers, (other.one, other.two), strict=True))
        return Prefix(self.n + other.n, self.tokens + other.tokens, one, two)

    def name(self) -> bytes:
        """A node's name; turns before it are not all equal for two nodes of one name but by a collision of 128 bits."""
        return hashlib.blake2b(b"%d %d %d" % (self.n, self.one, self.two), digest_size=16).digest()


def one_turn(segment: str, tokens: int) -> Prefix:
    digest = hashlib.blake2b(segment.encode(), digest_size=16).digest()
    return Prefix(1, tokens, int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"))


def turns(chats: DataFrame, tokenizer: str) -> DataFrame:
    """conv, place, node, parent, start (tokens before the turn), length, ids: a row for each turn.

    Rows are sorted by conversation and turn over range partitions. Each task works out the prefixes within its rows and the run of its last conversation;
    these, one row for each task, are put together on the driver, and what stands before each task's first conversation is added.
    """
    rows = chats.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv", "turn", F.xxhash64("role", "text"), "role", "text"]
    rows = rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    state = "n long, tokens long, one decimal(20,0), two decimal(20,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        from pyspark import TaskContext

        from corpusgrid.llm.tokens import encoder

        part, enc, now, prefix, first = TaskContext.get().partitionId(), encoder(tokenizer), None, Prefix(), True
        kind = pa.decimal128(20, 0)
        for batch in batches:
            segments = [write_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ids, at = enc.encode(pa.array(segments, pa.string()))
            out: list[list] = [[] for _ in range(9)]
            for i, (conv, segment) in enumerate(zip(batch.column(0).to_pylist(), segments, strict=True)):
                if (conv,) != now:
                    first, now, prefix = now is None, (conv,), Prefix()
                prefix = prefix.then(one_turn(segment, int(at[i + 1] - at[i])))
                for column, value in zip(out, (part, first, conv, prefix.n, prefix.tokens, Decimal(prefix.one), Decimal(prefix.two), int(at[i + 1] - at[i]), ids[at[i] : at[i + 1]].tobytes()), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), kind, kind, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["part", "first", "conv", "n", "tokens", "one", "two", "length", "ids"])

    known = materialise(rows.mapInArrow(run, f"part long, first boolean, conv string, {state}, length long, ids binary"), "chat-runs")
    where = F.struct(F.col("conv").isNotNull().alias("some"), "conv")  # as the rows are sorted: null first
    ends = known.groupBy("part").agg(F.max_by(F.struct("n", "tokens", "one", "two"), F.struct(F.col("conv").isNotNull(), "conv", "n")).alias("run"), F.min(where).alias("head"), F.max(where).alias("last"))
    carry, before = [], None  # the last conversation of the tasks so far, and its run
    for r in ends.orderBy("part").collect():  # a row for each task
        own = Prefix(r["run"]["n"], r["run"]["tokens"], int(r["run"]["one"]), int(r["run"]["two"]))
        head, tail = (r["head"]["conv"],), (r["last"]["conv"],)
        held = before[1] if before and before[0] == head else Prefix()
        carry.append((r["part"], held.n, held.tokens, str(held.one), str(held.two)))
        before = (tail, held.then(own) if tail == head else own)
    held = chats.sparkSession.createDataFrame(carry, "part long, n0 long, tokens0 long, one0 string, two0 string")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for first, n, tokens, one, two, length, n0, tokens0, one0, two0 in zip(*(f[c] for c in ("first", "n", "tokens", "one", "two", "length", "n0", "tokens0", "one0", "two0")), strict=True):
                own = Prefix(int(n), int(tokens), int(one), int(two))
                whole = Prefix(int(n0), int(tokens0), int(one0), int(two0)).then(own) if first and n0 else own
                out.append((whole.n - 1, whole.name(), whole.tokens - length))
            yield pd.DataFrame({"conv": f["conv"], "place": [x[0] for x in out], "node": [x[1] for x in out], "start": [x[2] for x in out], "length": f["length"], "ids": f["ids"]})

    done = known.join(F.broadcast(held), "part").mapInPandas(finish, "conv string, place long, node binary, start long, length long, ids binary")
    return materialise(done, "chat-turns")


def format_chats(chats: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(tree, conversations).

    Tree: node, place (depth), owner (rank of the first conversation that has the node), start (position id of its first token), offset (place in the stream), length (both in
    tokens), ids (little-endian 32-bit token ids). Conversations: conv_id, rank, spans: the stream intervals [begin, end) of its turns, in order, each with its owner.

    Rows without a conversation id form one conversation. Null roles and texts count as empty; repeated
    rows are turns of their own; rows of equal turn follow one another by role and text. Nothing comes of an empty table.
    """
    members = turns(chats, tokenizer).withColumn("conv", F.coalesce(F.concat(F.lit("+"), "conv"), F.lit("-")))
    places = materialise(members.select("conv", "place", "node"), "chat-places")
    parent = places.select("conv", (F.col("place") + 1).alias("place"), F.col("node").alias("parent"))
    # each node once, with its parent; a conversation's own rows are found by conversation and place, which no other row shares
    chain = materialise(places.join(parent, NODE, "left"), "chat-chain")
    nodes = materialise(chain.groupBy("node").agg(F.min("parent").alias("parent"), F.min("place").alias("place")), "chat-nodes")
    branching = nodes.groupBy(F.coalesce("parent", F.lit(b"")).alias("parent")).agg(F.count(F.lit(1)).alias("children")).where("children > 1").drop("children")
    children = salted_join(materialise(nodes.select(F.coalesce("parent", F.lit(b"")).alias("parent"), "node"), "chat-children"), branching, ["parent"]).select("node")
    turning = salted_join(places, materialise(children, "chat-branches"), ["node"])
    keys = turning.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("way"))
    whole = places.groupBy("conv").agg(F.max("place").alias("depth")).join(keys, "conv", "left")
    way = F.aggregate(F.coalesce("way", F.array().cast("array<struct<place:bigint,node:binary>>")), F.lit(b""), lambda a, x: F.concat(a, x["node"]))
    ranked = whole.select("conv", way.alias("key"), "depth").repartitionByRange("key", "depth", "conv").sortWithinPartitions("key", "depth", "conv")
    ranks = materialise(ranked.select("conv", F.monotonically_increasing_id().alias("rank")), "chat-ranks")
    owned = materialise(salted_join(places, ranks, ["conv"]), "chat-owned")
    owners = owned.groupBy("node").agg(F.min("rank").alias("owner"))
    first = members.groupBy("node").agg(*(F.first(c).alias(c) for c in ("place", "start", "length", "ids")))
    ordered = first.join(owners, "node").repartitionByRange("owner", "place").sortWithinPartitions("owner", "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            frame["offset"] = at + frame["length"].cumsum() - frame["length"]
            at += int(frame["length"].sum())
            yield frame.assign(part=part)

    placed = materialise(ordered.mapInPandas(run, "node binary, place long, start long, length long, ids binary, owner long, offset long, part long"), "chat-stream")
    parts = placed.groupBy("part").agg(F.sum("length").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))  # a row for each partition
    tree = placed.join(F.broadcast(parts), "part").withColumn("offset", F.col("offset") + F.col("before")).select("node", "place", "owner", "start", "offset", "length", "ids")
    stops = tree.select("node", "owner", "offset", (F.col("offset") + F.col("length")).alias("end"))
    runs = salted_join(owned, stops, ["node"]).groupBy("conv", "rank", "owner").agg(F.min("offset").alias("begin"), F.max("end").alias("end"))
    spans = runs.groupBy("conv", "rank").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "owner"))).alias("spans"))  # one for each branching on the way
    conv_id = F.when(F.col("conv") != "-", F.substring("conv", F.lit(2), F.length("conv")).cast("long"))
    return tree, materialise(spans.select(conv_id.alias("conv_id"), "rank", "spans"), "chat-spans")


def ancestors(tree: DataFrame, conversations: DataFrame) -> DataFrame:
    """node, ancestors: the intervals [begin, end) of the stream that a node attends to besides itself, from the root on."""
    own = conversations.select(F.col("rank").alias("owner"), "spans")
    joined = salted_join(tree.select("node", "owner", "offset"), own, ["owner"])
    before = F.filter("spans", lambda s: s["begin"] < F.col("offset"))
    return joined.select("node", F.transform(before, lambda s: F.struct(s["begin"].alias("begin"), F.least(s["end"], F.col("offset")).alias("end"))).alias("ancestors"))


def digests(tree: DataFrame, conversations: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted conversations say, read back from the stream by their intervals, in the order of the position ids.

    A conversation's turns stream by in one task, since a digest of all its text is asked for; nothing but the digests' states is held.
    """
    spans = materialise(conversations.select("conv_id", F.explode("spans").alias("s")).select("conv_id", "s.owner", "s.begin", "s.end"), "chat-reads")
    stream = tree.select("owner", "offset", "start", "ids")
    counts = spans.groupBy("owner").agg(F.count(F.lit(1)).alias("reads"))
    share = 256  # more readers than that of one owner's turns are dealt over several tasks
    runs = counts.select("owner", F.ceil(F.col("reads") / share).cast("int").alias("runs"))
    stream = stream.join(runs, "owner").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")
    spans = spans.join(runs, "owner").withColumn("run", F.coalesce(F.pmod(F.xxhash64("conv_id"), F.col("runs")), F.lit(0)).cast("int")).drop("runs")
    read = spans.join(stream, ["owner", "run"]).where("offset >= begin and offset < end").select("conv_id", "start", "ids")
    read = read.repartition("conv_id").sortWithinPartitions("conv_id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusgrid.llm.tokens import encoder

        enc, now, state = encoder(tokenizer), None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row(conv, n: int, said, chars: int, loss, total: int) -> list:
            return [conv, n, said.hexdigest(), chars, loss.hexdigest(), total]

        for batch in batches:
            done = []
            for conv, start, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (conv,) != now:
                    if now:
                        done.append(row(now[0], *state[:-1]))
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if start != state[5]:
                    raise ValueError(f"conversation {conv}: position {start} instead of {state[5]}")
                formatted = enc.decode(ids)
                ((role, text, _, _),) = read_turns(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == TRAINED:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += len(ids) // 4
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(now[0], *state[:-1]), kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return read.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], chats.schema)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(*format_chats(chats.unionByName(extra), path), path)
