"""The prefix trie of conversations against a brute-force version, with containers of several sizes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpusgrid.llm import conversation_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, node string, conv int, place int, words array<string>"


def brute(convs):
    """convs: id -> list of (role, text)."""
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * words
    out = []
    for node, who in members.items():
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, key, role, text))
    return {c: [r[3:] for r in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, ["w"]) for r in rows], SCHEMA).repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def chats(seed, n=60):
    rng = random.Random(seed)
    rows, long = [], [("user" if i % 2 else "assistant", f"turn {i} of a long one") for i in range(40)]
    for c in rng.sample(range(300), n):
        kind = rng.random()
        if kind < 0.3:
            turns = long[: rng.randint(1, 40)] + [("user", rng.choice("xy"))] * rng.randint(0, 2)
        elif kind < 0.5:
            turns = long[:7]
        else:
            turns = [(rng.choice(["user", "system"]), rng.choice(["a", "a b", "", "c c c"])) for _ in range(rng.randint(1, 5))]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "capacity"), [(1, 1), (2, 30), (3, 10_000)])
def test_capacities(spark, seed, capacity, monkeypatch):
    monkeypatch.setattr(conversation_trie, "STEP", 8)
    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    rows = chats(seed)
    got = result(conversation_trie.prefix_trie(frame(spark, rows), capacity))
    assert got == brute(in_order(rows))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (2, None, "", ""), (2, 0, "user", "a b"), (3, 5, "user", "a b"), (3, 5, "user", "a b"), (3, 5, "user", None), (None, 1, "user", "lost"), (4, 1, "u", "ser:x"), (5, 1, "us", "er:x"), (20, 1, "user", "ñ é日 " * 2000), (21, 2, "user", "ñ é日 " * 2000)]
    got = result(conversation_trie.prefix_trie(frame(spark, rows), 2))
    assert got == brute(in_order(rows))
    turns = conversation_trie.numbered(conversation_trie.turn_ids(frame(spark, rows)))
    assert result(conversation_trie.trie(*conversation_trie.rebuilt(turns))) == brute(rebuilt(in_order(rows)))
    assert result(conversation_trie.prefix_trie(frame(spark, []))) == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(conversation_trie.query(spark, sf)) == brute(rebuilt(in_order(rows)))
