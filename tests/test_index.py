"""Postings by ranges, the stored index, snapshots, automata and hybrid search."""

import math
import random
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusgrid.operators import automaton, hybrid, inverted, lexical
from corpusgrid.operators.stored import StoredIndex
from corpusgrid.session import shared_dir
from corpusgrid.sources.snapshots import Conflict, Snapshots

WORDS = [f"w{i}" for i in range(12)] + ["the"] * 6


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.choice([0, 3, 8, 30])))) for i in range(n)] + [(n, None), (n + 1, "…"), (n + 2, "Été w1")]


def brute_bm25(docs, query, k):
    ts = {i: re.findall(r"[^\W_]+", (t or "").lower().replace("é", "e")) for i, t in docs}
    n, avg = len(ts), sum(map(len, ts.values())) / len(ts)
    q, out = Counter(query.split()), {}
    for i, words in ts.items():
        tf = Counter(words)
        score = 0.0
        for w, c in q.items():
            df = sum(w in set(x) for x in ts.values())
            idf = math.log((n - df + 0.5) / (df + 0.5)) if df else 0
            score += c * max(idf, 1e-6) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / avg)) if tf[w] else 0
        if any(tf[w] for w in q):
            out[i] = -round(score, 6)
    return [(i, s) for i, s in sorted(out.items(), key=lambda x: (x[1], x[0]))][:k]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


QUERIES = [(1, "w1 w2 the"), (2, "w3"), (3, "the the"), (4, "w5 w6 w7 w5"), (5, "absent"), (6, "")]


@pytest.mark.parametrize(("ranges", "tokens", "block"), [(4, 1 << 21, 128), (1024, 40, 2)])
def test_searches_by_ranges(spark, monkeypatch, ranges, tokens, block):
    monkeypatch.setattr(inverted, "RANGE", ranges)
    monkeypatch.setattr(inverted, "RANGE_TOKENS", tokens)
    monkeypatch.setattr(inverted, "QUERY_BLOCK", block)
    docs = corpus(150, 3)
    df, q = frame(spark, docs), spark.createDataFrame(QUERIES, "qid long, text string")
    for k in (2, None):
        got = {}
        for r in sorted(lexical.bm25(df, q, k, query_id="qid").collect(), key=lambda r: (r.qid, r.rank)):
            got.setdefault(r.qid, []).append((r.doc, r.score))
        assert {i: [(d, pytest.approx(s, abs=2e-6)) for d, s in brute_bm25(docs, t, k)] for i, t in QUERIES if brute_bm25(docs, t, k)} == got
    sets = {i: set((t or "").split()) for i, t in docs}
    want = {(i, d) for i, t in QUERIES for d, s in sets.items() if t and set(t.split()) <= s}
    assert {(r.qid, r.doc) for r in lexical.all_terms(df, q, 1000).collect()} == want
    want = {}
    for i, t in QUERIES:
        p = t.split()
        for d, text in docs:
            ts = (text or "").split()
            n = sum(ts[j : j + len(p)] == p for j in range(len(ts) - len(p) + 1)) if p else 0
            if n:
                want[i, d] = n
    assert {(r.qid, r.doc): r.times for r in lexical.phrase(df, q).collect()} == want


def test_bounds_skip_ranges():
    """A range whose bound is below the k-th score is not scored, and nothing is lost by it."""
    def table(tf):
        return pa.table({"term": ["a"], "at": [[0, 1]], "tf": [[tf, tf]], "dl": [[10, 10]], "tf_max": pa.array([tf], pa.int32()), "dl_min": pa.array([10], pa.int32()), "uses": pa.array([[{"qid": 7, "w": 2.0}]])})

    best = inverted.Best(1)
    assert inverted.scored(best, 0, table(5), 10.0) == 0
    assert inverted.scored(best, 1, table(1), 10.0) == 1
    assert inverted.scored(best, 2, table(5), 10.0) == 0
    assert [r[1:] for r in best.rows[0]] == [(0, 0), (0, 1), (2, 0), (2, 1)]


def index(spark, **more):
    return StoredIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", **more)


def rows(df):
    return sorted((r.qid, r.doc, round(r.score, 6), r.rank) for r in df.collect())


def test_stored_index_equals_a_new_one(spark, monkeypatch):
    monkeypatch.setattr(inverted, "RANGE", 8)
    q = spark.createDataFrame(QUERIES, "qid long, text string")
    docs = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in corpus(120, 5)]
    schema = "doc_id long, text string, source string"
    ix = index(spark, buckets=4)
    assert ix.search(q) is None and ix.state().first().documents == 0
    assert ix.upsert(spark.createDataFrame(docs, schema).repartition(3)) == 1
    assert ix.upsert(spark.createDataFrame(docs, schema).repartition(2)) == 1  # nothing has changed: no new version
    edited = [(i, (t or "") + " w3 new" if i % 5 == 0 else t, s) for i, t, s in docs if s == "s1" and i % 7] + [(900, "w3 w3 new", "s1")]
    assert ix.upsert(spark.createDataFrame(edited, schema)) == 2
    assert ix.remove("s2") == 3 and ix.remove(None) == 4 and ix.remove("s2") == 4
    now = edited + [d for d in docs if d[2] in ("s0", "s3")]
    fresh = frame(spark, [d[:2] for d in now])
    for _ in range(2):
        assert rows(ix.search(q)) == rows(lexical.bm25(fresh, q, 10, query_id="qid"))
        assert sorted(map(tuple, ix.phrases(q).select("qid", "doc", "times").collect())) == sorted(map(tuple, lexical.phrase(fresh, q).select("qid", "doc", "times").collect()))
        assert sorted(map(tuple, ix.all_terms(q).select("qid", "doc", "rank").collect())) == sorted(map(tuple, lexical.all_terms(fresh, q).select("qid", "doc", "rank").collect()))
        assert ix.state().first().documents == len(now)
        assert ix.compact() == 5  # then the same from one segment
    moved = [(i, t, "s9") for i, t, s in edited[:3]]
    ix.upsert(spark.createDataFrame(moved, schema))  # a document that another source now has
    assert {r.doc: r.source for r in ix.documents().collect() if r.doc in {d[0] for d in moved}} == {d[0]: "s9" for d in moved}


def test_searches_read_no_texts_and_few_buckets(spark):
    ix = index(spark)
    ix.upsert(spark.createDataFrame([(i, f"alpha{i} beta", "s") for i in range(40)], "doc_id long, text string, source string"))
    found, terms = ix._found(spark.createDataFrame([(1, "alpha3")], "qid long, text string"), "qid")
    assert {r.term for r in found.select("term").distinct().collect()} == {"alpha3", inverted.DOCUMENTS}


def test_snapshots(spark):
    s = Snapshots(spark, f"{shared_dir(spark)}/snap-{uuid.uuid4().hex}")
    empty = s.current()
    assert empty.number == 0 and s.read(empty, "t") is None
    lost = s.write(spark.range(5), "t")  # a writer that fails before its commit
    one = s.commit(empty, {"t": [s.write(spark.range(2), "t")]}, {"note": "é"})
    with pytest.raises(Conflict):
        s.commit(empty, {"t": [lost]})
    assert s.current() == one and s.read(one, "t").count() == 2 and one.facts == {"note": "é"}
    two = s.commit(one, {"t": [*one.tables["t"], s.write(spark.range(3), "t")]})
    assert s.read(two, "t").count() == 5 and s.read(s.at(1), "t").count() == 2
    s.commit(two, {"t": two.tables["t"][1:]})
    assert s.vacuum(keep=1) == 2 and s.versions() == [3] and s.read(s.current(), "t").count() == 3


def test_substrings_of_many_queries(spark):
    """More queries than one block, against plain containment."""
    docs = [(1, "Aa aaa b\nabc"), (2, None), (3, "xyz " * 50)]
    queries = [(i, f"q{i}") for i in range(10_001)] + [(20_000, "aa b"), (20_001, "aa zz"), (20_002, "xyz xyz"), (20_003, " "), (20_004, "")]
    q = spark.createDataFrame(queries, "qid long, text string")
    got = {(r.qid, r.doc): tuple(r)[2:] for r in automaton.substrings(frame(spark, docs), q, every=False).collect()}
    assert got == {(20_000, 1): (2, 4, 1, 12), (20_001, 1): (1, 2, 0, 12), (20_002, 3): (1, 50, 1, 200)}
    every = automaton.substrings(frame(spark, docs), q, every=True).collect()
    assert {(r.qid, r.doc) for r in every} == {(20_000, 1), (20_002, 3)}
    assert [tuple(r) for r in automaton.best_substrings(frame(spark, docs), q.where("qid = 20000"), 1).collect()] == [(20_000, 1, 1)]


def test_payload_audit(spark):
    payloads = spark.createDataFrame([(1, "see /home/x and SQLite, key sk-1"), (2, "the secret passage. the secret passage."), (3, None), (4, "nothing")], "id long, text string")
    sentinels = spark.createDataFrame([("a", "secret passage"), ("b", "passage. the"), ("c", ""), ("d", "absent")], "name string, text string")
    got = {r.id: r for r in automaton.payload_audit(payloads, sentinels, ["sk-1", ""], block=1).collect()}
    assert [(got[1].absolute_path_absent, got[1].api_key_absent, got[1].sqlite_absent, got[1].manifest_absent, got[1].forbidden)] == [(False, False, False, True, [])]
    assert got[2].forbidden == ["a", "b"] and got[2].absolute_path_absent and got[3].input_chars == 0 and got[4].input_chars == 7
    rows = {tuple(r) for r in automaton.payload_violations(payloads, sentinels, ["sk-1"]).collect()}
    assert rows == {(1, "path", "/home/", 1), (1, "store", "sqlite", 1), (1, "key", "", 1), (2, "sentinel", "a", 2), (2, "sentinel", "b", 1)}


def test_hybrid_modes_and_statuses(spark):
    passages = spark.createDataFrame([(1, "a", "Methods", "heat stress of cells"), (2, "a", "Results", "cells died"), (3, "b", "Methods", "unrelated words"), (4, "b", "References", "heat heat")], "passage_id long, source_file string, section string, text string")
    v = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.9, 0.1], 4: [1.0, 0.0]}
    vectors = spark.createDataFrame(list(v.items()), "passage_id long, vector array<double>")
    asked = spark.createDataFrame([(1, "heat", "hybrid", [1.0, 0.0]), (2, "heat", "lexical", [1.0, 0.0]), (3, "heat", "hybrid", [0.0, 0.0]), (4, "heat", "hybrid", None), (5, "heat", None, None), (6, "", "Hybrid ", [0.0, 1.0])], "qid long, text string, mode string, vector array<double>")
    run = lambda state, vs=vectors, **kw: hybrid.hybrid_search(passages, asked, vs, state, dimension=2, **kw).collect()
    got = run("READY")
    by = lambda rows, q: [r.passage_id for r in sorted(rows, key=lambda r: r.rank) if r.qid == q]
    assert by(got, 1) == [1, 3, 2] and by(got, 2) == by(got, 3) == by(got, 4) == by(got, 5) == [1] and by(got, 6) == [2, 3, 1]
    assert {r.qid: (r.mode, r.semantic_status) for r in got} == {1: ("hybrid", "available"), 2: ("lexical", "disabled"), 3: ("lexical", "error"), 4: ("lexical", "error"), 5: ("lexical", "disabled"), 6: ("hybrid", "available")}
    first = next(r for r in got if r.qid == 1 and r.rank == 1)
    assert first.sources == "lexical,semantic" and first.semantic_score == 1.0 and first.lexical_score < 0 and first.fused_score == round(2 / 61, 9)
    for state, vs, status in (("EMPTY", vectors, "not_indexed"), (None, vectors, "unavailable"), ("READY", None, "unavailable")):
        rows = [r for r in run(state, vs) if r.qid == 1]
        assert [(r.passage_id, r.mode, r.semantic_status, bool(r.warning)) for r in rows] == [(1, "lexical", status, True)]
    assert by(run("READY", sections=["Results"]), 1) == [2] and by(run("PARTIAL", references=True), 1)[:2] == [1, 4]
    assert np.isclose(sum(r.fused_score for r in got if r.qid == 6), sum(1 / (60 + i) for i in (1, 2, 3)), atol=1e-6)


def test_phrases_apart(spark):
    """Occurrences that share a space, or overlap, as the SQL of the phrase queries counts them."""
    texts = [(1, "a b a b a b"), (2, "a a a a a a a a"), (3, "a b c a b"), (4, "a b a b c a b a b"), (5, "c")]
    asked = [(1, "a b"), (2, "a a"), (3, "c"), (4, "a")]
    want = {}
    for q, p in asked:
        for d, t in texts:
            s = f" {t} "
            n = (len(s) - len(s.replace(f" {p} ", " "))) // (len(p) + 1)
            if n:
                want[q, d] = n
    df, q = frame(spark, texts), spark.createDataFrame(asked, "qid long, text string")
    assert {(r.qid, r.doc): r.times for r in lexical.phrase(df, q, apart=True).collect()} == want
    ix = index(spark, buckets=4)
    ix.upsert(df.selectExpr("doc_id", "text", "'s' source"))
    assert {(r.qid, r.doc): r.times for r in ix.phrases(q, apart=True).collect()} == want
