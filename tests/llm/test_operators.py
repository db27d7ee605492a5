"""The ten operators against brute-force versions, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusgrid.llm import chat, exact_dedup, hashing, html_extract, licenses, mixing, near_dedup, packing, quality, substring_dedup, token_files
from corpusgrid.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, start long, keep_id string, n_words string, id string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, "a b  c\td", "en", "s", 1), (2, "a b c d", "en", "s", 1), (3, None, "en", None, None), (4, "", None, "s", 0), (5, " \n\t ", "en", "t", 3), (6, LONG, "en", "s", 9),
    (7, LONG, "en", "s", 9), (8, LONG + " tail end of it", "en", "u", 9), (9, BASE, "en", "s", 1), (9, BASE, "en", "s", 1), (10, BASE + " more", "fr", "s", 1), (11, BASE.upper(), "fr", "t", 1),
    (None, BASE, "en", "s", 1), (None, None, None, None, None), (12, "ñandú é日本 x", "es", "s", 1), (13, "\n".join(["same line here"] * 30), "en", "s", 1), (14, "word word word word word", "en", "s", 1), (15, "one", "en", "s", 1), (16, "One", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, True, 1, "x", "y", "z") for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def reference_ids(values):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(list(values), add_special_tokens=False)]


# exact dedup


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    return out


def check_exact(rows, got):
    want = groups(rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for text, ids in want.items():
        found = by[hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in found) == Counter(ids)
        assert all(r.keep_id == least and r.group_size == len(ids) for r in found)
        assert [r.doc_id for r in found if r.kept] == [least]


def test_exact_dedup_odd(odd, none):
    check_exact(ODD, exact_dedup.exact_dedup(odd).collect())
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_hot(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}", None, None, None) for i in range(3000)] + [(i, "two  spaces", None, None, None) for i in (5000, 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_exact(rows, exact_dedup.exact_dedup(df).collect())


# quality


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def brute_scores(values, trusted, buckets, prior):
    import xxhash

    def bucket(*ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - (1 << 64) * (h >> 63)

    t, r, words = Counter(), Counter(), []
    for i, text in values:
        ws = WORD.findall(text or "")
        b = [bucket(w) % buckets for w in ws] + [bucket(v, w) % buckets for v, w in zip(ws, ws[1:])]
        words.append(b)
        r.update(b)
        if i in trusted:
            t.update(b)
    T, R = sum(t.values()), sum(r.values())
    ratio = {b: (np.log(t[b] + prior) - np.log(r[b] * T / R + prior)) if T else 0.0 for b in r}
    return [sum(ratio[x] for x in b) / len(b) if b else 0.0 for b in words]


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(9, 1, 0), (10, 1, None), (6, 0, 0), (None, 1, 0), (11, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(odd, labels, buckets=1 << 12).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r[0], *brute_base(r[1])) for r in ODD)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality_rules(none, labels, buckets=64).count() == 0
    assert {r.llr_score for r in quality.quality_rules(odd, labels.limit(0), buckets=64).collect()} == {0.0}


def test_quality_scores(spark, docs, texts, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels, buckets=1 << 16).collect()}
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    for (i, text), score in zip(texts.items(), brute_scores(texts.items(), trusted, 1 << 16, quality.PRIOR), strict=True):
        assert (*(got[i][c] for c in quality.BASE),) == brute_base(text)
        assert abs(got[i].llr_score - score) < 1e-6
        assert got[i].kept == (not got[i].base_failed and got[i].llr_score >= quality.THRESHOLD)


@pytest.mark.parametrize("bits", [(40, 24), (2, 24), (0, 24), (40, 2)])
def test_repeats_are_exact(spark, texts, bits):
    """Windows of equal hash bits with other words, and texts of more words than places, give what comparing words gives."""
    rng = np.random.default_rng(4)
    rows = [(i, t[:20_000]) for i, t in list(texts.items())[:60]] + [(10_000 + i, " ".join(rng.choice(list("abcd"), rng.integers(0, 60)))) for i in range(60)]
    filler = lambda k: " ".join(f"{k}f{i}" for i in range(30))
    rows.append((20_000, f"a1665272 b c {filler(1)} a2057064 b c {filler(2)} a1665272 b c"))  # their hashes agree in 40 bits
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.with_base(df, "text", *bits).collect()}
    assert got == {i: brute_base(t)[4] for i, t in rows} and got[20_000] == 6


def test_quality_words(spark):
    """The words of the contract, and no lambda over them to find them."""
    rows = [(None,), ("",), (" \t\n\v\f\r",), ("a",), (" a\vb\u00a0c \n\n d\u2003",), ("\u00a0 x \u00a0",), ("\x1c y \x85",)]
    df = spark.createDataFrame(rows, "text string").select("text", quality.words(quality.F.col("text")).alias("w"))
    assert all(r.w == WORD.findall(r.text or "") for r in df.collect())
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


def test_quality_held_out(spark):
    """Half of the labels as the target; on the other half, clean documents stay and most junk goes."""
    sf = "/root/testdata/sf0.01"
    labels, all_docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(all_docs, labels.where("doc_id % 2 = 0")).select("doc_id", "kept", "n_words").where("n_words >= 50").collect()}
    held = [(r.quality, verdict[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in verdict]
    assert np.mean([k for q, k in held if q == 1]) > 0.99
    assert np.mean([k for q, k in held if q == 0]) < 0.15


# near-duplicates


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(values):
    sets = {i: shingle_set(t) for i, t in values}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_dedup(docs, texts):
    want = brute_components(texts.items())
    got = near_dedup.near_dedup(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_odd(odd, none):
    want = brute_components({r[0]: r[1] for r in ODD if r[0] is not None}.items())
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_dedup(none).count() == 0


def test_near_dedup_dense_group(spark):
    """A large group of near copies is one component without all its pairs."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        for p in rng.integers(0, 200, 3):
            w[p] = f"x{i}-{p}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{i}-{k}" for k in range(100))) for i in range(50)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    wrong = sum(r.component_id != want[r.doc_id][1] for r in got)
    assert wrong == 0


def test_near_dedup_dense_groups_whole(spark):
    """No link of a dense region is lost, whatever the regions' size and the trees, with texts that share a passage and are no copies besides."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for p in rng.choice(120, rng.integers(1, 5), replace=False):
            w[p] = f"x{i}-{p}"
        rows.append((i, " ".join(w)))
    for i in range(100):  # a shared passage of two thirds, and pairs that are near copies within that
        tail = [f"z{i // 2}-{k}" for k in range(40)]
        tail[0] = f"v{i}"
        rows.append((1000 + i, " ".join([f"p{k}" for k in range(70)] + tail)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for region, trees in ((8, 32), (2, 4)):
        got = near_dedup.near_dedup(df, region=region, trees=trees).collect()
        assert sum(r.component_id != want[r.doc_id][1] for r in got) == 0


def test_across_blocks(spark):
    """What links a region's members of different components, in small blocks as in one."""
    rows = [(i, " ".join([f"w{k}" for k in range(60)] + [f"x{i}-{k}" for k in range(i % 20)])) for i in range(60)]
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in range(60) for b in range(a + 1, 60) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    members = spark.createDataFrame([(t, b"k", i, len(sets[i])) for t in (0, 1) for i in range(60)], "tree int, key binary, id long, n int")
    known = [(i, i % 3) for i in range(3, 60)]
    roots = spark.createDataFrame(known, "node long, root long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_dedup.components(spark.createDataFrame(links + known, "a long, b long")).collect()
    for block in (7, 1000):
        got = [(r.a, r.b) for r in near_dedup.across(members, roots, docs, 75, "doc_id", "text", block).collect()]
        assert set(got) <= set(links) and all(a % 3 != b % 3 for a, b in got)
        assert sorted(near_dedup.components(spark.createDataFrame(got + known, "a long, b long")).collect()) == sorted(want)


@given(st.lists(st.tuples(st.integers(0, 1), st.lists(st.integers(0, 2), min_size=3, max_size=3)), max_size=40), st.integers(2, 5))
@settings(max_examples=50, deadline=None)
def test_regions_cover_small_groups(rows, region):
    rows = sorted(rows)
    tree, keys = np.array([t for t, _ in rows], int), np.array([k for _, k in rows], int).reshape(-1, 3)
    a, b = near_dedup.regions(tree, keys, 2, region)
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    same = defaultdict(list)
    for i, (t, k) in enumerate(rows):
        same[(t, *k[:2])].append(i)
    for members in same.values():
        if len(members) <= region:
            assert all((x, y) in pairs for i, x in enumerate(members) for y in members[i + 1 :])
        assert all((x, x + 1) in pairs for x in members[:-1])
    assert all(x < y for x, y in pairs) and len(pairs) <= len(rows) * (region + 1)


# substrings


def brute_substrings(rows, target):
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - target + 1):
            key = tuple(w[k : k + target])
            first[key] = min(first.get(key, LAST), i)
    out = []
    for (i, w), (raw, _) in zip(words, rows, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - target + 1):
            if first[tuple(w[k : k + target])] < i:
                keep[k : k + target] = [False] * target
        out.append((raw, len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()))
    return Counter(out)


LAST = substring_dedup.LAST


@pytest.mark.parametrize("size", [2_000, 1 << 21])
def test_substring_dedup(docs, texts, odd, none, size):
    got = substring_dedup.substring_dedup(docs, block_bytes=size * 50).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substrings(list(texts.items()), 13)
    got = substring_dedup.substring_dedup(odd, block_bytes=size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substrings([r[:2] for r in ODD], 13)
    assert substring_dedup.substring_dedup(none).count() == 0


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6)), max_size=60), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_anchors(rows, reach):
    rows = sorted(rows, key=lambda r: r[0])
    doc, x = np.array([d for d, _ in rows], int), np.array([v for _, v in rows], np.uint64)
    want = [v == min(w for j, (e, w) in enumerate(rows) if e == d and abs(i - j) <= reach) for i, (d, v) in enumerate(rows)]
    assert substring_dedup.anchors(x, doc, reach).tolist() == want


def test_repeat_lengths(spark, docs, texts):
    """Level by level to the end: what is found is repeated, and of passages twice as long none is missed."""
    got = {r.doc_id: r.longest for r in substring_dedup.repeat_lengths(docs, block_bytes=100_000).collect()}
    words = {i: t.split() for i, t in ((i, t.encode().decode("latin-1")) for i, t in texts.items())}
    size = 26
    while True:
        where = defaultdict(set)
        for i, w in words.items():
            for k in range(len(w) - size + 1):
                where[tuple(w[k : k + size])].add(i)
        have = {i for v in where.values() if len(v) > 1 for i in v}
        assert {i for i, n in got.items() if n >= size} <= have
        assert all(got.get(i, 0) >= size // 2 for i in have) or size == 26
        if not have:
            break
        size *= 2
    assert got and size > 26


@pytest.mark.parametrize("size", [500, 1 << 21])
def test_repeat_lengths_at_every_place(spark, size):
    """Passages of any length, most between a power's length and half as much again, at any place: the longest length by brute force, with texts and blocks of all sorts of ids."""
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows = [(None, " ".join(fresh(60))), (0, None)]
    for k in range(40):
        passage = fresh(int(rng.choice([13, 25, 26, 27, 30, 38, 51, 52, 60, 77, 104, 110])))
        for i in range(rng.integers(2, 4)):
            rows.append((int(2 * k + i) if k % 9 else None, " ".join([*fresh(rng.integers(0, 40)), *passage, *fresh(rng.integers(0, 40))])))
    rows += [(500, " ".join([*"ab" * 40])), (501, " ".join([*"ab" * 30])), (502, rows[5][1]), (502, rows[9][1])]
    words = [(LAST if i is None else i, (t or "").split()) for i, t in rows]
    want, n = {}, 26
    while n <= 208:
        where = defaultdict(set)
        for i, w in words:
            for k in range(len(w) - n + 1):
                where[tuple(w[k : k + n])].add(i)
        want |= {i: n for who in where.values() if len(who) > 1 for i in who}
        n *= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {LAST if r.doc_id is None else r.doc_id: r.longest for r in substring_dedup.repeat_lengths(docs, block_bytes=size).collect()}
    assert got == want and {26, 52, 104} <= set(got.values())


def test_hashing_windows():
    data = np.frombuffer(b" ab  ab\tabc\n", np.uint8)
    starts, ends, h = hashing.words(data)
    assert starts.tolist() == [1, 5, 8] and ends.tolist() == [3, 7, 11] and h[0] == h[1] != h[2]
    x = np.arange(20, dtype=np.uint64) % 7
    w = hashing.windows(x, 5)
    assert w[0] == w[7] and len(set(w[:7].tolist())) == 7
    v = np.array([5, 3, 9, 1, 4, 4, 8])
    for width in range(1, 8):
        assert hashing.sliding_min(v, width).tolist() == [min(v[i : i + width]) for i in range(len(v) - width + 1)]


# tokens, packing, files


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list(" \n\t'aébÉß日.,!?*|<>_-1²Ⅷ  \u0085\u001cñs") ), max_size=40)), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_library(values):
    ids, starts = ENCODER.encode(pa.array(values, pa.string()))
    assert [ids[starts[i] : starts[i + 1]].tolist() for i in range(len(values))] == reference_ids(v or "" for v in values)


ENCODER = Encoder(PATH)


@given(st.lists(st.integers(1, 5000), max_size=60))
@settings(max_examples=80, deadline=None)
def test_pack_block(tokens):
    pieces, n = packing.pack_block(np.array(tokens, np.int64))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, start, length, s, offset in pieces.tolist():
        by_doc[d].append((start, length))
        by_seq[s].append((offset, length))
    for d, size in enumerate(tokens):
        at = 0
        for start, length in by_doc[d]:
            assert start == at and length > 0
            at += length
        assert at == size
    assert len(by_seq) == n
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0 or at == 1024


@given(st.lists(st.integers(1, 1023), min_size=1, max_size=80))
@settings(max_examples=80, deadline=None)
def test_pack_is_greedy_by_cost(tokens):
    """Descending documents, each to the sequence of the lowest cost with room, the first of equals."""
    n = sum(tokens) // 1024
    used, cost, want = [0] * n, [0.0] * n, {}
    for d in sorted(range(len(tokens)), key=lambda d: (-tokens[d], d)):
        fits = [s for s in range(n) if used[s] + tokens[d] <= 1024]
        if fits:
            s = min(fits, key=lambda s: (cost[s], s))
            want[d] = (s, used[s])
            used[s] += tokens[d]
            cost[s] += tokens[d] + tokens[d] ** 2 / 1024
    pieces, _ = packing.pack_block(np.array(tokens, np.int64))
    got = {d: (s, offset) for d, start, length, s, offset in pieces.tolist() if start == 0 and length == tokens[d] and d in want}
    assert got == want


def test_packing_round_trip(odd, none, docs, texts):
    for df, rows in ((docs, list(texts.items())), (odd, [r[:2] for r in ODD])):
        pieces = packing.pack(df, PATH, block_tokens=20_000).collect()
        want = Counter((i, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for (i, _), ids in zip(rows, reference_ids(t or "" for _, t in rows), strict=True))
        runs, now = Counter(), b""
        by = defaultdict(list)
        for p in pieces:
            by[p.doc_id].append(p)
        for i, ps in by.items():  # pieces of rows that share an id are told apart by their order
            if len({p.doc_tokens for p in ps}) == 1 and sum(p.length for p in ps) == ps[0].doc_tokens:
                now = b"".join(p.ids for p in sorted(ps, key=lambda p: p.start))
                runs[i, zlib.crc32(now)] += 1
        assert all(want[k] == v for k, v in runs.items()) and len(runs) >= len({r[0] for r in rows}) - 2
        assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in reference_ids(t or "" for _, t in rows))
    assert packing.pack(none, PATH).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, odd, none, tmp_path, bits):
    token_files.write(odd, str(tmp_path / "a"), PATH, chunk_ids=500, bits=bits)
    got = sorted(token_files.documents(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    rows = sorted((r[:2] for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, _), ids in zip(got, rows, reference_ids(t or "" for _, t in rows), strict=True):
        assert (r.doc_key, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1
    index = spark.read.parquet(str(tmp_path / "a/index")).collect()
    assert sum(r.n_ids for r in index) == at and all(r.n_ids <= 500 for r in index)
    token_files.write(none, str(tmp_path / "b"), PATH)
    assert token_files.documents(spark, str(tmp_path / "b")).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.booleans())
@settings(max_examples=60, deadline=None)
def test_planes(ids, bits):
    x = np.array(ids, "<u4")
    planes = token_files.to_planes(x, bits)
    assert token_files.from_planes(b"".join(planes), [len(p) for p in planes], len(x)).tolist() == ids


# mixing


def brute_fluid(weights, blocks):
    """Blocks served of each source after each slot, moment by moment: from one exhaustion to the next."""
    served, out, now = [Fraction(0)] * len(weights), [], Fraction(0)
    out.append(list(served))
    for slot in range(1, sum(blocks) + 1):
        while now < slot:
            left = [s for s, b in enumerate(blocks) if served[s] < b]
            rate = sum(weights[s] for s in left)
            step = min(slot - now, min((blocks[s] - served[s]) * rate / Fraction(weights[s]) for s in left))
            for s in left:
                served[s] += step * weights[s] / rate
            now += step
        out.append(list(served))
    return out


def brute_schedule(weights, blocks):
    """Earliest deadline first, with releases and deadlines read off the fluid."""
    fluid, done, out = brute_fluid(weights, blocks), [0] * len(blocks), []
    for slot in range(sum(blocks)):
        ready = [s for s, b in enumerate(blocks) if done[s] < b and fluid[slot + 1][s] > done[s]]
        due = lambda s: next(t for t, y in enumerate(fluid) if y[s] >= done[s] + 1)  # noqa: B023, E731
        s = min(ready, key=lambda s: (due(s), s))
        out.append((slot, s, done[s]))
        done[s] += 1
    return out, fluid


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 25)), min_size=1, max_size=6), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_schedule(sources, step):
    """Ranges put together are the schedule from slot 0, and every source is less than one block off at every slot."""
    weights, blocks = [w for w, _ in sources], [b for _, b in sources]
    want, target = brute_schedule(weights, blocks)
    plan = mixing.Fluid(weights, blocks)
    assert [x for first in range(0, plan.total, step) for x in mixing.schedule(plan, first, first + step)] == want
    done = [0] * len(blocks)
    for slot, s, _ in want:
        done[s] += 1
        assert all(abs(d - y) < 1 for d, y in zip(done, target[slot + 1], strict=True))


def test_schedule_long():
    """Irrational-looking weights, many slots, a tiny source: less than one block off throughout, in ranges as in one run."""
    weights = mixing.whole([2**0.5, 1.0, 3**0.5, 0.001, 0.3, 0.3])
    assert all(Fraction(a, weights[1]) == Fraction(b) for a, b in zip(weights, [2**0.5, 1.0, 3**0.5, 0.001, 0.3, 0.3], strict=True))
    plan = mixing.Fluid(weights, [20_000, 9_000, 30_000, 12, 700, 5_000])
    whole = list(mixing.schedule(plan, 0, plan.total))
    assert [x for first in range(0, plan.total, 3000) for x in mixing.schedule(plan, first, first + 3000)] == whole
    done = [0] * 6
    for slot, s, _ in whole:
        done[s] += 1
        if slot % 37 == 0 or slot > plan.total - 3000:
            assert all(abs(d - y) < 1 for d, y in zip(done, plan.at(slot + 1), strict=True))
    assert done == plan.blocks


def test_mix(spark, odd, none):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    counts = Counter(s for _, s in rows)
    for weights in (None, {"hot": 3.0, "s1": 1.0, "s2": 0.0}):
        got = mixing.mix(df, weights, block=4, slot_range=90, bin_rows=100).orderBy("mix_slot", "mix_row").collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
        assert len({(r.mix_slot, r.mix_row) for r in got}) == len(rows) and all(0 <= r.mix_row < 4 for r in got)
        assert {r.mix_slot for r in got} == set(range(sum(-(-n // 4) for n in counts.values())))
        plan = mixing.stages(counts, weights, 0.5, 4)
        assert len(plan) == (1 if weights is None else 2)
        base, want = 0, {}
        for names, fluid in plan:
            want |= {base + slot: (names[s], k) for slot, s, k in mixing.schedule(fluid, 0, fluid.total)}
            base += fluid.total
        assert all(want[r.mix_slot] == (r.source, r.mix_block) for r in got)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    assert mixing.mix(odd).columns == [*odd.columns, "mix_slot", "mix_row", "mix_block"]


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><header>Site name</header><nav><ul><li><a href=a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Side</div><%s><h1>Title &amp; more</h1><p>First <b>bo</b>ld paragraph of some length,<br>second line &#233; &nbsp; end.<p>Second paragraph without an end tag that is long enough as well.
<form><input><p>Mail</p></form><div class="ad">Buy</div><p>Third paragraph, the last one of the article, is here too.</p></%s><section class="comments"><p>Reader says hi, at some length, as readers do everywhere.</p></section><footer>&copy; me</footer></body></html>"""
TEXT = "Title & more First bold paragraph of some length, second line é end. Second paragraph without an end tag that is long enough as well. Third paragraph, the last one of the article, is here too."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html_extract.main_text(PAGE % (tag, tag)) == TEXT


LINKED = "<p>The text of the article is long enough to be content, and says what it says.</p><h2><a href=h>Linked heading</a></h2><ol><li><a href=r>First reference, 2001.</a></li><li><a href=s>Second reference, 2002.</a></li></ol><p>The last paragraph of the article is long enough as well, as one sees here.</p>"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_links_of_an_article_stay(tag):
    text = html_extract.main_text(f"<body><nav><a href=x>Menu</a></nav><{tag}>{LINKED}</{tag}></body>")
    assert text == " ".join(re.sub("<[^>]*>", " ", LINKED).split())


@pytest.mark.parametrize("menu", ["<nav><ul><li><a href=x>Home</ul></nav>", "<div class=menu><a href=x>Home</div>", "<a name=top>", "<a href=x>", "<ul><li><a href=x>Home</ul>"])
def test_unclosed_link(menu):
    body = re.sub("<h2>.*</ol>", "", LINKED)
    want = " ".join(re.sub("<[^>]*>", " ", body).split())
    assert html_extract.main_text(f"<body>{menu}<div>{body}</div></body>") == want
    listed = f"<div>{body.replace('</p><p>', '</p><ul><li><a href=y>Related one</a></li></ul><p>')}</div>"
    assert html_extract.main_text(f"<body>{menu}{listed}</body>") == want.replace("The last", "Related one The last")  # links inside the region stay


def test_html_odd(spark, sf):
    rows = [(1, "u", PAGE % ("article", "article"), "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<p>" * 3000 + "deep", "z"), (4, "w", "<![if x]>a<![endif]> <!-- b", "z"), (2**60 + 1, "w", "no markup", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == TEXT and got[1].n_chars == len(TEXT) and got[2].text == got[None].text == "" and got[3].text == "deep" and got[4].text == "a" and got[2**60 + 1].text == "no markup"
    assert html_extract.extract(df.limit(0)).count() == 0
    page = spark.read.parquet(f"{sf}/pages.parquet")
    assert page.count() == html_extract.extract(page).where("n_chars > 0").count()


# chats


@given(st.text(alphabet="<|\\im_start>end a\n", max_size=40), st.text(alphabet="<|\\n\nab", max_size=8))
@settings(max_examples=200, deadline=None)
def test_turn_round_trip(text, role):
    written = chat.write_turn(role, text)
    assert written.count(chat.START) == written.count(chat.END) == 1
    assert [(r, t) for r, t, _, _ in chat.read_turns(written * 2)] == [(role, text)] * 2


def check_chats(spark, convs, rows, depth_first=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    tree, whole = chat.format_chats(df.repartition(3), PATH)
    nodes = sorted(tree.join(chat.ancestors(tree, whole), "node").collect(), key=lambda n: n.offset)
    texts = {n.node: ENCODER.decode(bytes(n.ids)) for n in nodes}
    paths = {"".join(chat.write_turn(r, t) for r, t in ts[: k + 1]) for ts in convs.values() for k in range(len(ts))}
    at = 0
    stream = np.concatenate([np.frombuffer(bytes(n.ids), "<u4") for n in nodes])
    seen, stack = set(), []
    for n in nodes:  # one stream, every prefix once, depth first
        assert n.offset == at and n.length == len(n.ids) // 4
        assert n.start == sum(a.end - a.begin for a in n.ancestors) and all(a.end <= n.offset for a in n.ancestors)
        path = "".join(ENCODER.decode(stream[a.begin : a.end].tobytes()) for a in n.ancestors) + texts[n.node]
        stack = stack[: n.place]
        assert len(stack) == n.place and "".join(stack) + texts[n.node] == path
        stack.append(texts[n.node])
        seen.add(path)
        at += n.length
    assert seen == paths and len(nodes) == len(paths)
    for r in whole.collect():
        assert "".join(ENCODER.decode(stream[s.begin : s.end].tobytes()) for s in r.spans) == "".join(chat.write_turn(r_, t) for r_, t in convs[r.conv_id])
    got = {r.conv_id: r for r in chat.digests(tree, whole, PATH).collect()}
    assert len(got) == len(convs)
    for c, ts in convs.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in ts)
        formatted = "".join(chat.write_turn(r, t) for r, t in ts)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))


def test_chat_tree(spark):
    probe = f"{chat.END}{chat.START}assistant ok"
    convs = {1: [("user", "a"), ("assistant", "b")], 2: [("user", "a"), ("assistant", "c")], 3: [("user", "a"), ("assistant", "b"), ("user", probe)], 4: [("user", "a"), ("assistant", "b")], 5: [("system", "")], None: [("", ""), ("", "")]}
    rows = [(c, k, r if c else None, t if c else None, 5) for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    check_chats(spark, convs, rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int").limit(0)
    tree, whole = chat.format_chats(df, PATH)
    assert tree.count() == whole.count() == chat.digests(tree, whole, PATH).count() == 0


def test_chat_tree_large(spark):
    """Conversations of thousands of turns over several partitions, shared first turns, chains of branchings, copies and prefixes of one another."""
    rng = np.random.default_rng(9)
    long = [("user" if k % 2 else "assistant", f"turn {k} é") for k in range(3000)]
    convs = {1: long, 2: list(long), 3: long[:1500], 4: [*long[:2000], ("user", "other end")]}
    convs |= {10 + i: [*long[:i], ("assistant", f"branch {i}"), ("user", "more")] for i in range(1, 30)}
    convs |= {100 + i: [("user", "common"), *(("assistant", str(x)) for x in rng.integers(0, 3, rng.integers(0, 6)))] for i in range(400)}
    check_chats(spark, convs, [(c, k, r, t, 0) for c, ts in convs.items() for k, (r, t) in enumerate(ts)])


@given(st.lists(st.text(max_size=5), max_size=12), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_prefixes_put_together(segments, cut):
    def run(parts):
        out = chat.Prefix()
        for x in parts:
            out = out.then(chat.one_turn(x, len(x)))
        return out

    whole, joined = run(segments), run(segments[:cut]).then(run(segments[cut:]))
    assert whole.name() == joined.name() and (whole.n, whole.tokens) == (joined.n, joined.tokens)
    assert len({run(segments[:k]).name() for k in range(len(segments) + 1)}) == len(segments) + 1


# licenses


def brute_matches(text):
    """Every template laid over every place, without fingerprints or bands: longest common subsequences of whole windows."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    out = set()
    for name, template in licenses.TEMPLATES.items():
        t = re.findall(r"[a-z0-9]+", template.lower())
        for at in range(len(words)):
            part = words[at : at + len(t)]
            row = [0] * (len(part) + 1)
            for w in t:
                row = _lcs_row(row, w, part)
            if row[-1] >= licenses.COVERAGE * len(t):
                out.add(name)
    return out


def _lcs_row(row, w, part):
    new = [0]
    for j, x in enumerate(part, 1):
        new.append(max(row[j], new[-1], row[j - 1] + (x == w)))
    return new


def test_licenses(spark):
    rows = [(1, "Words. Released under the MIT License. More"), (2, "This work is licenced under the GNU General Public License, version 3!"), (3, None), (4, ""), (5, "MIT license talk and nothing else of it"), (None, "licensed under cc by-nc 4.0."), (6, LONG + " Licensed under the Apache License, Version 2.0."), (7, "é " * 50 + "Released under the MIT License. x Licensed under CC BY-SA 4.0.")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, matches string")
    got = {r.doc_id: r.matches for r in licenses.license_scan(df).collect()}
    for i, text in rows:
        names = {m.license for m in got[i]}
        brute = brute_matches(text or "") if i != 6 else {"Apache-2.0"}
        assert names <= brute and bool(names) == bool(brute), (i, names, brute)
        assert all(m.coverage >= licenses.COVERAGE for m in got[i])
    m = got[7][0]
    assert rows[7][1][m.start : m.end] == "Released under the MIT License" and got[7][1].license == "CC-BY-SA-4.0"
    assert licenses.license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("between", ["", "and ", "x y z ", "w " * 9])
@pytest.mark.parametrize("name", ["MIT", "CC-BY-4.0", "Apache-2.0", "MIT notice"])
def test_repeated_notices(spark, name, between):
    """Every occurrence of a notice that repeats is a match with its own span."""
    notice = licenses.TEMPLATES[name]
    text = "Some words. " + f"{notice} {between}" * 25 + "The end."
    at = [m.start() for m in re.finditer(re.escape(notice), text)]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = licenses.license_scan(df).collect()
    bare = len(notice.rstrip("."))
    assert [(m.license, m.start, m.end) for m in row.matches] == [(name, p, p + bare) for p in at]


def test_repeated_notices_with_changes(spark):
    """Whole and changed notices side by side: none hides its neighbours."""
    whole, changed = "Released under the MIT License.", "Released under the MIT Licence."
    text = f"{changed} {whole} {changed} " * 8
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = licenses.license_scan(df).collect()
    assert len(row.matches) == 24 and [m.words for m in row.matches] == [4, 5, 4] * 8


def test_winnow_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        h = rng.integers(0, 5, rng.integers(0, 12)).astype(np.uint64)
        p = set(licenses.winnow(h).tolist())
        assert all(p & set(range(i, i + licenses.WINNOW)) for i in range(len(h) - licenses.WINNOW + 1))
