"""Greedy folds over documents that fill many partitions, against plain loops; the page cutter against the Column functions."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.operators import folds, structure


@pytest.fixture
def many(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("seed", "limit", "joint", "sizes"), [(1, 50, 1, range(1, 30)), (2, 100, 0, [10]), (3, 7, 0, range(0, 20)), (4, 1000, 1, range(1, 5))])
def test_sums(many, seed, limit, joint, sizes):
    rng = random.Random(seed)
    rows, want = [], {}
    for doc, n in (("a", 700), ("b", 3), ("c", 0), ("d", 250), ("e", 1)):
        group, total, open_, label = 0, 0, False, None
        for i in range(n):
            size = rng.choice(list(sizes))
            new_label = label if label and rng.random() < 0.95 else rng.choice("xyz")
            if open_ and new_label == label and total + joint + size <= limit:
                total += joint + size
            else:
                group, total = group + 1, size
            open_, label = True, new_label
            rows.append((doc, i, size, label))
            want[doc, i] = group
    rng.shuffle(rows)
    df = many.createDataFrame(rows, "doc string, i long, n long, label string")
    got = folds.grouped(df, "doc", ["i"], F.col("n"), folds.Sums(limit, joint), label=F.col("label"))
    assert {(r.doc, r.i): r.group for r in got.collect()} == want
    assert folds.grouped(df.limit(0), "doc", ["i"], F.col("n"), folds.Sums(limit)).collect() == []


def plain_chunks(pages, size, overlap):
    out = []
    for number, text in pages:
        if not text.strip(" "):
            continue
        if len(text) > size:
            step, n = size - overlap, -(-(len(text) - size) // (size - overlap))
            for i in range(n + 1):
                lead = out[-1][0][-overlap:] + "\n" if out and i == 0 else ""
                out.append([lead + text[i * step : i * step + size], number, number, True])
        elif out and not out[-1][3] and len(out[-1][0]) + 1 + len(text) <= size:
            out[-1][0] += "\n" + text
            out[-1][2] = number
        elif out and not out[-1][3]:
            out.append([out[-1][0][-overlap:] + "\n" + text, max(number - 1, 1), number, False])
        else:
            out.append([text, number, number, False])
    return [(i, *c[:3]) for i, c in enumerate(out, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks(many, seed):
    rng = random.Random(seed)
    docs = {d: [(p, "".join(rng.choices("ab c", k=rng.choice([0, 1, 3, 9, 28, 55, 130])))) for p in range(1, n + 1)] for d, n in (("a", 400), ("b", 2), ("c", 60))}
    df = many.createDataFrame([(d, p, t) for d, pages in docs.items() for p, t in pages], "source_file string, page_number long, text string")
    got = {}
    for r in structure.chunks(df, 60, 12).collect():
        got.setdefault(r.source_file, []).append((r.chunk, r.text, r.page_start, r.page_end))
    assert {d: sorted(v) for d, v in got.items()} == {d: plain_chunks(pages, 60, 12) for d, pages in docs.items()}


def test_one_document_of_many_pages(many):
    """A document of 100 000 pages is folded in pieces of its partitions."""
    df = many.range(1, 100_001, 1, 12).select(F.lit("one").alias("source_file"), F.col("id").alias("page_number"), F.concat(F.lit("Page text number "), F.col("id"), F.lit(".")).alias("text"))
    out = structure.passages(df, 400).cache()
    n = out.agg(F.max("ordinal").alias("n"), F.count(F.lit(1)).alias("c"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars"), F.sum(F.expr("page_end - page_start + 1")).alias("pages")).first()
    total = sum(len(f"Page text number {i}.") for i in range(1, 100_001))
    assert n.n == n.c and n.longest <= 400 and n.pages == 100_000 and n.chars == total + 100_000 - n.c
    assert out.where("length(text) < 370").count() <= 1
    out.unpersist()


def test_headings_of_strings_and_columns_agree(spark):
    lines = ["Methods", "2) Methods", "3.1 Results ", "IV. Discussion", "## Abstract ##", "Funding: none", "Authors’ contributions", "funding", "Fundings", "Method s", "", "x", "1. 方法", "III) References\t", " Introduction ", "conclusion" + " " * 90, "12 Background", "Acknowledgements and more"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", X.collapse(F.col("x")).alias("c"))
    for r in df.select("x", "c", X.heading(F.col("c")).alias("h")).collect():
        assert (X.collapsed(r.x), X.heading_of(r.c)) == (r.c, r.h), r.x


def test_sections_agree_with_the_window_over_lines(many):
    rng = random.Random(7)
    words = ["Methods", "Results", "Funding", "", "one line", "another  line", "1. Discussion"]
    df = many.createDataFrame([(f"d{i % 5}", i, "\n".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(1, 120)], "source_file string, page_number long, text string")
    lines = structure.carried(structure.page_lines(df)).where("section is not null and section <> 'excluded' and line <> ''")
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r.page_number, r.line_no)):
        s = want.setdefault((r.source_file, r.section), [None, [], r.page_number, r.page_number])
        s[3] = r.page_number
        if r.kind is None:
            s[1].append(r.line)
        elif s[0] is None:
            s[0] = r.line
    got = {(r.source_file, r.section): [r.title, r.text, r.page_start, r.page_end] for r in structure.sections(df).collect()}
    assert got == {k: [t, "\n".join(b), a, z] for k, (t, b, a, z) in want.items()}
