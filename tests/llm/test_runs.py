"""Periodic runs against a brute-force version, on planted, random and odd texts."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgrid.llm import hashing, run_detection

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, times=4, least=6):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q) and not any(a <= s and e <= b and q % p == 0 for a, b, p in out):
                out.append((s, e, q))
    return sorted((s, e - s, q) for s, e, q in out)


def ours(docs):
    data, begin = hashing.joined(pa.array([" ".join(d) for d in docs], pa.string()), np.arange(256, dtype=np.uint8))
    starts, _, hashes = hashing.words(data)
    first = np.searchsorted(starts, begin)
    s, e, p = run_detection.find_runs(hashes, first)
    at = np.searchsorted(s, first)
    return [[(int(s[i] - first[d]), int(e[i] - s[i]), int(p[i])) for i in range(at[d], at[d + 1])] for d in range(len(docs))]


PIECE = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=6), max_size=8))
def test_random_texts(docs):
    docs = [[w for words, times, cut in d for w in (words * times)[: max(1, len(words) * times - cut)]] for d in docs]
    assert ours(docs) == [brute(d) for d in docs]


def test_runs_inside_repeated_passages_come_from_the_grammar(monkeypatch):
    passage = [f"p{i}" for i in range(40)] + ["x", "y", "z"] * 5 + [f"q{i}" for i in range(40)]
    doc = [*passage, "one", *passage, "two", *passage]
    want = brute(doc)
    assert len(want) == 3 and ours([doc]) == [want]
    grammar = run_detection.Grammar

    class OnlyFirst(grammar):  # the same grammar, whose nonterminals do not know their other places
        def __init__(self, *a):
            super().__init__(*a)
            self.place, self.of = self.begin, np.arange(len(self.begin) + 1)

    monkeypatch.setattr(run_detection, "Grammar", OnlyFirst)
    assert ours([doc]) == [want[:1]]


def test_grammar_derives_the_text():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 4, 3000).astype(np.uint64)
    doc = np.repeat([0, 1, 2], 1000)
    g = run_detection.Grammar(hashing.mix(words * np.uint64(4) + doc.astype(np.uint64)), doc)
    for k in range(len(g.begin)):
        size = g.end[k] - g.begin[k]
        for place in g.place[g.of[k] : g.of[k + 1]]:
            assert doc[place] == doc[g.begin[k]] and (words[place : place + size] == words[g.begin[k] : g.end[k]]).all()


def test_long_periods():
    block = [f"w{i}" for i in range(5000)]
    doc = ["head", *block * 4, *block[:17], "tail"]
    assert ours([doc]) == [[(1, 20_017, 5000)]]
    assert ours([["a"] * 100_000]) == [[(0, 100_000, 1)]]


def expected(rows):
    out = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = brute(words)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        out.setdefault(doc_id, []).append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest))
    return out


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = run_detection.query(spark, sf).collect()
    assert sum(map(len, want.values())) == len(got) and sum(r.n_runs > 0 for r in got) > 5
    for r in got:
        assert tuple(r)[1:] in want[r.doc_id]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y x y x y x y"), (None, None), (5, "one"), (6, "ñ é日 " * 9), (10, "a b " * 700), (7, "\n".join(["same line here"] * 30)), (8, "A a A a A a A a A\x1fa")]


def test_odd_rows(spark):
    rows = [(i, t, "r", [1], 7) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words array<int>, start int").repartition(3)
    got = run_detection.digest(run_detection.periodic_runs(run_detection.planted(docs))).collect()
    want = expected(ODD)
    assert sorted(str((r.doc_id, *tuple(r)[1:])) for r in got) == sorted(str((k, *v)) for k, vs in want.items() for v in vs)
    assert run_detection.digest(run_detection.periodic_runs(docs.where("false"))).collect() == []
    with pytest.raises(ValueError):
        run_detection.find_runs(np.zeros(3, np.uint64), np.array([0, 3]), times=2)
