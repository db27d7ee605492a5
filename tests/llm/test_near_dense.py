"""Dense regions: documents of one template with few edits. Every link counts, so no row may have a wrong component."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import shingle_set

from corpusgrid.llm import near_dedup


def template(seed, n_docs, n_words, low, high):
    """One text of distinct words; each document replaces `low` to `high` of them by words of its own."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_docs):
        words = [f"w{k}" for k in range(n_words)]
        for p in rng.choice(n_words, rng.integers(low, high + 1), replace=False):
            words[p] = f"x{i}-{p}"
        out.append((i, " ".join(words)))
    return out


def components(rows, percent=75):
    """Smallest id reachable, by all pairs on full sets."""
    sets = [shingle_set(t) for _, t in rows]
    df = Counter(x for s in sets for x in s)
    column = {x: k for k, x in enumerate(x for x, n in df.items() if n > 1)}
    m = np.zeros((len(rows), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[x] for x in s if x in column]] = 1
    both = (m @ m.T).round().astype(np.int64)
    n = np.array([len(s) for s in sets])
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) | np.eye(len(n), dtype=bool)
    least = np.array([i for i, _ in rows])
    while True:
        new = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == least).all():
            return dict(zip((i for i, _ in rows), least.tolist(), strict=True))
        least = new


@pytest.mark.parametrize(("n_docs", "n_words", "low", "high"), [(1500, 100, 1, 2), (3000, 120, 2, 3), (2000, 120, 3, 3), (3000, 200, 4, 5)])
def test_template(spark, n_docs, n_words, low, high):
    rows = template(5, n_docs, n_words, low, high)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_dedup(df, held=20_000).collect()
    want = components(rows)
    assert len(got) == n_docs and sum(r.component_id != want[r.doc_id] for r in got) == 0


def test_shared_passage(spark):
    """A passage that all documents share links none of them, and leaves the few real links."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1200):
        own = [f"y{i - i % 4 if i % 4 < 2 else i}-{k}" for k in range(60)]
        own[0] = f"z{i}"
        rows.append((i, " ".join([f"p{k}" for k in range(55)] + own)))
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(4)
    want = components(rows)
    assert sum(i != c for i, c in want.items()) == 300
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df).collect()} == want


def test_linkable(spark):
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, 9]), (3, [1, 2, 7, 8]), (4, [])]
    df = spark.createDataFrame([(i, np.array(s, np.int64).tobytes()) for i, s in rows], "id long, set binary")
    assert sorted(r.id for r in near_dedup.linkable(df, 75).collect()) == [1, 2, 4]


def test_homes(spark):
    """A node that many trees put with the same others is sent once, and every two nodes of a region stay together."""
    rng = np.random.default_rng(8)
    regions = [(tree, key, [int(x) for x in rng.choice(np.arange(key * 20, key * 20 + 20), rng.integers(2, 19), replace=False)]) for tree in range(32) for key in range(5)]
    rows = [(tree, bytes([key]), i, i % 7, 9) for tree, key, ids in regions for i in ids]
    got = near_dedup.homes(spark.createDataFrame(rows, "tree int, key binary, id long, root long, n int")).collect()
    of = defaultdict(set)
    for r in got:
        of[r.home].add(r.id)
    assert all(set(ids) <= of[min(ids)] for _, _, ids in regions) and all((r.root, r.n) == (r.id % 7, 9) for r in got)
    assert len(got) == sum(map(len, of.values())) < len(rows) / 2


def test_together(spark):
    """Every pair stands once, with both ids in its run; a node of a small cluster is sent once for all its pairs; no run is large."""
    rng = np.random.default_rng(9)
    clusters = [rng.permutation(np.arange(k * 100, k * 100 + 20)).tolist() for k in range(30)]
    pairs = {(min(a, b), max(a, b)) for ids in clusters for a in ids for b in ids if a != b}
    pairs |= {(90_000, 90_001 + i) for i in range(3000)} | {(80_000 + i, 89_999) for i in range(3000)}  # a hub of smaller ids, one of larger ones
    rows = near_dedup.together(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    runs = defaultdict(list)
    for r in rows:
        runs[r.home, r.run].append(r)
    assert sorted((r.id, b) for r in rows for b in r.others) == sorted(pairs)
    for own in runs.values():
        ids = [r.id for r in own]
        assert len(set(ids)) == len(ids) and {b for r in own for b in r.others} <= set(ids)
        assert sum(len(r.others) for r in own) < 2 * near_dedup.PAIRS
    assert sorted(r.id for r in rows if r.id < 80_000) == sorted(i for ids in clusters for i in ids)
    assert len(rows) < 600 + 6000 + 60


def test_open_nodes(spark):
    """Roots are joined with one row for each node, however many regions of however many trees hold it."""
    members = [(tree, b"k", i, 9) for tree in range(32) for i in range(300)]
    got = near_dedup.open_nodes(spark.createDataFrame(members, "tree int, key binary, id long, n int"), spark.createDataFrame([(i, 1) for i in range(2, 200)], "node long, root long")).collect()
    assert sorted((r.id, r.root, r.n) for r in got) == [(i, 1 if 2 <= i < 200 else i, 9) for i in range(300)]
    assert all(sorted(x.tree for x in r.regions) == list(range(32)) for r in got)


def test_confirmed_sends_few_sets(spark, monkeypatch):
    """Pairs that are no links are ruled out by parities, without loss; full sets go only with the others."""
    rng = np.random.default_rng(10)
    rows = []
    for i in range(120):
        words = [f"w{i % 6}-{k}" for k in range(300)]
        for p in rng.choice(300, rng.integers(0, 16), replace=False):
            words[p] = f"x{i}-{p}"
        rows.append((i, " ".join(words)))
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(a, b) for a in range(120) for b in range(a + 1, 120) if a % 6 == b % 6]
    links = [(a, b) for a, b in pairs if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    kept = []
    materialise = near_dedup.materialise

    def seen(df, name):
        out = materialise(df, name)
        if name == "possible-pairs":
            kept.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(near_dedup, "materialise", seen)
    got = near_dedup.confirmed(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "doc_id long, text string"), 75, "doc_id", "text").collect()
    assert sorted((r.a, r.b) for r in got) == links and set(links) <= set(kept)
    assert len(links) < len(pairs) / 2 and len(kept) < len(links) + (len(pairs) - len(links)) / 4


@pytest.mark.parametrize("alone", [True, False])
def test_compare(alone):
    """Parities rule out no link, whatever the sizes."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[: (n := rng.integers(1, 400))], rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(40)]
        n = np.array([len(s) for s in sets])
        mine = rng.random(40) < 0.5
        found = near_dedup.compare(alone, mine, np.arange(40), np.arange(40), n, np.concatenate(sets), 75)
        links = [(a, b) for a in range(40) for b in range(a + 1, 40) if (alone or mine[a] != mine[b]) and 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))]
        assert {tuple(x) for x in found.tolist()} <= set(links)
        assert closure(found.tolist()) == closure(links)


def closure(links):
    of = defaultdict(set)
    for a, b in links:
        whole = of[a] | of[b] | {a, b}
        for x in whole:
            of[x] = whole
    return {x: min(s) for x, s in of.items()}
