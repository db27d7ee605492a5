"""The URL filter: given rules by brute force, mined rules by counting, held-out accuracy, and odd rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusgrid.llm import url_filter as U

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "v") for r in rows], "page_id long, url string, id int, verdict string").repartition(3)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, tokens string")


ODD = ["http://net/", "http://a.net/x", "http://xnet/", "http://example.net/en/1", "http://A.EXAMPLE.net/en/", "http://example.net/EN/", "https://example.com/de", "https://example.com/de/x?y#z", "x://org/fr/", "http://É.Org/fr/a", None, "", "no scheme", "http://", "://", "http://a.net?q=/en/", "http://a.net#/x", "a://b://net/", "http://example.net:80/en/", "http://x.org/" + "long/" * 3000, "http://" + "a." * 3000 + "com/\n/de/"]


def test_given_rules(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://a.net/"), (3, ODD[3])]
    got = U.url_filter(pages(spark, rows), labels(spark, []))
    want = [(i, *split(u), rule(*split(u))[0], rule(*split(u))[1] or "allow") for i, u in rows]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)
    assert U.url_filter(pages(spark, []), labels(spark, [(1, 0, 0)])).collect() == []


def planted(n, seed):
    rng, rows, marks = random.Random(seed), [], []
    for i in range(n):
        host, lang = rng.choice(["pills-shop", "news", "blog", "wiki"]), rng.choice(["en", "es"])
        rows.append((i, f"https://www.{host}.example.com/{lang}/{rng.randrange(99)}" + rng.choice(["", "?ref=x", "#top"])))
        bad = rng.random() < (0.95 if host == "pills-shop" and lang == "es" else 0.03)
        marks.append((i, int(not bad), rng.choice([0, None])) if rng.random() < 0.5 else (i, 1, int(bad)))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = planted(3000, 1)
    got = {r.page_id: r for r in U.url_filter(pages(spark, rows), labels(spark, marks[:1500])).collect()}
    right = sum((got[i].verdict == "block") == (q == 0 or t == 1) for i, q, t in marks[1500:])
    assert right / 1500 > 0.95
    blocked = [r for r in got.values() if r.verdict == "block"]
    assert blocked and all(r.confidence >= 0.6 and set(r.mined) >= {"path:es"} for r in blocked)


@pytest.mark.parametrize("small", [0, 50_000])
def test_mined_rules_by_counting(spark, small, monkeypatch):
    monkeypatch.setattr(U, "SMALL", small)
    rows, marks = planted(400, 2)
    host, path = U.host_and_path(F.col("url"))
    known = pages(spark, rows).select(F.col("page_id").alias("id"), U.tokens(F.col("url"), host, path).alias("tokens"))
    bad = {i: q == 0 or t == 1 for i, q, t in marks}
    sets = {r.id: set(r.tokens) for r in known.collect()}
    each = labels(spark, marks).select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    mined = U.mine(known.join(each, "id"), min_support=0.01, min_count=5, items=99)
    got = {tuple(r.rule): (r.n, round(r.confidence, 9)) for r in mined.collect()}
    counts = {}
    for k in range(1, 4):
        for combo in itertools.combinations(sorted(set().union(*sets.values())), k):
            having = [bad[i] for i, s in sets.items() if s.issuperset(combo)]
            if len(having) >= 5 and sum(having) >= 5 and sum(having) / len(having) >= 0.6:
                counts[combo] = (len(having), sum(having) / len(having))
    want = {c: (n, round(p, 9)) for c, (n, p) in counts.items() if not any(counts.get(c[:j] + c[j + 1 :], (0, 0))[1] >= p for j in range(len(c)))}
    assert {c: v for c, v in got.items() if len(c) < 4} == want
    best = {r.id: r.best for r in U.match(known, mined).collect()}
    for i, s in sets.items():
        fits = [(p, n, list(c)) for c, (n, p) in ((tuple(r.rule), (r.n, r.confidence)) for r in mined.collect()) if s.issuperset(c)] if i % 40 == 0 else None
        if fits is not None:
            assert (tuple(best[i]) if i in best else None) == (max(fits) if fits else None)


@pytest.mark.parametrize("items", [2, 8])
def test_tokens_beyond_the_first_count(spark, items):
    """What a rule counts does not depend on how many tokens a page has, nor on how FP-growth gets them."""
    rng = random.Random(3)
    rows = []
    for i in range(400):  # 9 tokens that say much, another that says something, and one that stands wherever the last stands
        marks = [f"m{k}" for k in range(9) if rng.random() < 0.5]
        weak = ["x", "y"] if rng.random() < 0.3 else []
        rows.append((i, [*marks, *weak, "all"], rng.random() < (0.75 if weak else 0.1 + 0.05 * len(marks))))
    known = spark.createDataFrame(rows, "id long, tokens array<string>, bad boolean")
    got = {tuple(r.rule): (r.n, round(r.confidence, 9)) for r in U.mine(known, min_support=0.01, min_count=15, items=items).collect()}
    sets, counts = [(set(t), b) for _, t, b in rows], {}
    for k in range(1, 6):
        for combo in itertools.combinations(sorted({"all", "x", "y", *(f"m{k}" for k in range(9))}), k):
            having = [b for s, b in sets if s.issuperset(combo)]
            if sum(having) >= 15 and sum(having) / len(having) >= 0.6:
                counts[combo] = (len(having), round(sum(having) / len(having), 9))
    want = {c: v for c, v in counts.items() if not any(counts.get(c[:j] + c[j + 1 :], (0, 0))[1] >= v[1] for j in range(len(c)))}
    assert {c: v for c, v in got.items() if len(c) < 6} == want and ("x",) in want and ("y",) in want
    assert any(len(c) > 1 for c in want)


def test_labels_teach_only_where_they_say_something(spark):
    rows = [(i, f"http://bad.com/{i}") for i in range(60)] + [(None, "http://bad.com/x")] * 3
    marks = [(i, 0, 0) for i in range(30)] + [(i, None, None) for i in range(60)] + [(i, 1, 0) for i in range(30)] + [(None, 0, 1)] * 5
    got = U.url_filter(pages(spark, rows), labels(spark, marks))
    assert got.where("verdict = 'block'").count() == 0  # all labelled pages are bad: nothing tells them from others
    got = U.url_filter(pages(spark, [*rows, *((100 + i, f"http://fine.org/{i}") for i in range(60))]), labels(spark, [*marks, *((100 + i, 1, 0) for i in range(60))]))
    assert {r.host: r["count"] for r in got.where("verdict = 'block'").groupBy("host").count().collect()} == {"bad.com": 63}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    got = U.query(spark, sf).collect()
    for r in got:
        if r.rule:
            assert r.verdict == rule(r.host, r.path)[1]
    assert sorted(tuple(r)[:4] for r in got) == sorted((i, *split(u), rule(*split(u))[0]) for i, u in rows)
