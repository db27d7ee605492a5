"""Operators on small rows: structure, facts, search, evidence, batches, sources, sinks and streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.functions.unicode import nfc, nfkc
from corpusgrid.operators import batch, evidence, facts, lexical, structure, vector
from corpusgrid.sources import ingest, sinks
from corpusgrid.streaming import ingest as streaming


def pages(spark, *texts):
    return spark.createDataFrame([("a.pdf", i, t) for i, t in enumerate(texts, 1)], "source_file string, page_number long, text string")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("line", "kind"), [("1. Introduction", "introduction"), ("2. Methods", "methods"), ("II) Results", "results"), ("# Abstract", "abstract"), ("The results were discussed.", None), ("Funding", "excluded"), ("Authors’ contributions: AB", "excluded"), ("摘要", "abstract"), ("References", "references"), ("Fundings", None)])
def test_heading(spark, line, kind):
    assert one(spark, X.heading(F.col("l")), l=line) == kind


def test_sections(spark):
    rows = {r.section: r for r in structure.sections(pages(spark, "front\nAbstract\na1\n\na2\nMethods\nm1", "m2\nFunding\ngone\nMethods\nm3\nConclusion\nc1")).collect()}
    assert rows["abstract"].text == "a1\na2" and rows["methods"].text == "m1\nm2\nm3" and (rows["methods"].page_start, rows["methods"].page_end) == (1, 2)
    assert set(rows) == {"abstract", "methods", "conclusion"}


def test_units_and_passages(spark):
    p = pages(spark, "Methods\nThe study one.\nmore\n\nsecond part.", "third part.\nResults\nfound it.")
    got = sorted((r.page_number, r.unit, r.section, r.text) for r in structure.units(p).collect())
    assert [(s, t) for _, _, s, t in got] == [("Methods", "The study one. more"), ("Methods", "second part."), ("Methods", "third part."), ("Results", "found it.")]
    out = structure.passages(p, 200).orderBy("ordinal").collect()
    assert [(r.section, r.page_start, r.page_end) for r in out] == [("Methods", 1, 2), ("Results", 2, 2)] and all(len(r.passage_id) == 32 for r in out)
    long = structure.passages(pages(spark, "Results\n" + " ".join(f"Sentence number {i} says something." for i in range(80)) + " " + "x" * 700), 300).collect()
    assert len(long) > 5 and all(len(r.text) <= 300 for r in long)
    with pytest.raises(ValueError):
        structure.passages(p, 100)


def test_chunks(spark):
    out = structure.long_page_parts(pages(spark, "x" * 250), 100, 20).orderBy("part").collect()
    assert [len(r.text) for r in out] == [100, 100, 90]
    got = structure.chunks(pages(spark, "a" * 70, "b" * 70, " "), 100, 10).orderBy("chunk").collect()
    assert [(r.page_start, r.page_end) for r in got] == [(1, 1), (1, 2)] and got[1].text == "a" * 10 + "\n" + "b" * 70


def test_budget_groups(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 5, 3, 20, 1])], "k string, at long, s int")
    assert [r.group for r in structure.budget_groups(df, "k", "at", F.col("s"), 10).orderBy("at").collect()] == [0, 0, 1, 2, 3]


def test_facts(spark):
    text = "Research article one p = 0.01. The study in-\ncluded 20 participants. We used a model fit. It i ncreased. R2 = 0.9 was observed with model fit. Stored at 4 °C for two weeks. Table 2 shows p < .05 here."
    got = {(r.category, r.quote, r.source_type) for r in facts.facts(pages(spark, text)).collect()}
    cats = {c for c, _, _ in got}
    assert {"sample_size", "research_method", "major_result", "temperature", "time", "p_value"} <= cats
    assert ("major_result", "It increased.", "heading") not in got and any(q == "It increased." for _, q, _ in got)
    assert not any("Research article" in q for _, q, _ in got) and ("p_value", "Table 2 shows p < .05 here.", "possible_table") in got
    assert sum(c == "research_method" for c, _, _ in got) == 1


def test_fact_sections_and_location(spark):
    p = pages(spark, "Methods\nWe used 20 participants.\nend of", "page two.\nResults\nIt increased.", "It increased.")
    found = facts.in_sections(facts.facts(p), structure.sections(p)).collect()
    assert {(r.category, r.section) for r in found} >= {("sample_size", "methods"), ("major_result", "results")}
    q = spark.createDataFrame([("a.pdf", x) for x in ("We used 20 participants.", "end of page two.", "It increased.", "none")], "source_file string, quote string")
    assert {r.quote: (r.status, r.page_number) for r in facts.located(q, p).collect()} == {"We used 20 participants.": ("exact", 1), "end of page two.": ("cross_page", 1), "It increased.": ("ambiguous", 2), "none": ("unmatched", None)}


def test_bm25_is_fts5(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = "that thand ering la"
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table d using fts5(text)")
    db.executemany("insert into d(rowid, text) values (?, ?)", [(r.doc_id + 1, r.text) for r in docs.collect()])
    want = {i - 1: s for i, s in db.execute("select rowid, bm25(d) from d where d match ?", (" OR ".join(words.split()),))}
    q = spark.createDataFrame([(1, words)], "item_id long, text string")
    got = {r.doc: r.score for r in lexical.bm25(docs, q, None).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in got) < 2e-6


def test_statistical(spark):
    p = pages(spark, "p = 0.003", "P<0.05", "p-value", "p = 0.003", "p值", "alpha")
    assert lexical.statistical(p, "p value").count() == 5 and lexical.statistical(p, "p = 0.003").count() == 2
    assert X.statistical_pattern("alpha") is None


def test_filters(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert [df.where(X.value_filter(F.col("s"), v)).count() for v in (None, [], [" "], ["a ", "a"])] == [2, 0, 0, 1]
    assert X.section_names(["background", "method", " Other ", "Methods"]) == ["Introduction", "Methods", "Other"]


def test_text_functions(spark):
    assert one(spark, X.collapse(F.col("t")), t=" a   b\n") == "a b"
    assert one(spark, X.bounded(F.col("t"), 40), t="x" * 100 + "y" * 100) == "x" * 13 + X.MARKER + "y" * (40 - len(X.MARKER) - 13)
    assert one(spark, X.bounded(F.col("t"), 10), t="x" * 100) == "x" * 10
    assert one(spark, X.question_terms(F.col("t")), t="Does heating reduce the tested samples of 抗体稳定?") == sorted(["thermal", "reduc", "test", "sampl", "抗体稳定"])
    assert one(spark, X.flat_list(F.array(F.lit("a"), F.lit("中"))), t="") == "a；中" and one(spark, X.flat_list(F.array().cast("array<string>")), t="") == X.NOT_FOUND
    assert one(spark, X.safe_stem(F.col("t")), t="__a / b:中文?.pdf") == "a_b_中文_pdf"
    assert one(spark, X.occurrences(F.col("t"), F.lit("aa")), t="aaaa aa") == 3
    assert one(spark, nfkc(F.col("t")), t="ｐ²") == "p2" and one(spark, nfc(F.col("t")), t="é") == "é"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, None), (6, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = vector.cosine_topk(v, v.where("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (6, 1.0)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "P1", 1), (1, "P2", 2), (1, "P3", 3), (1, "P0", 0)], "qid long, p string, rank int")
    b = spark.createDataFrame([(1, "P3", 1), (1, "P2", 2), (1, "P4", 3)], "qid long, p string, rank int")
    out = vector.fuse(a, b, ["qid", "p"]).orderBy("rank").collect()
    assert [r.p for r in out] == ["P3", "P2", "P1", "P4"] and out[1].sources == "lexical,semantic"
    allowed = spark.createDataFrame([(1, "P4")], "qid long, p string")
    assert [r.p for r in vector.fuse(a, b, ["qid", "p"], allowed).collect()] == ["P4"]


def test_hybrid(spark):
    a = spark.createDataFrame([(1, "P1", 1), (1, "P2", 2), (1, "P9", 31)], "qid long, p string, rank int")
    b = spark.createDataFrame([(1, "P2", 1), (1, "P4", 2)], "qid long, p string, rank int")
    out, status = vector.hybrid(a, b, ["qid", "p"])
    assert [r.p for r in out.orderBy("rank").collect()] == ["P2", "P1"] and status == "available"
    for semantic, said in ((None, "unavailable"), (b.limit(0), "empty")):
        out, status = vector.hybrid(a, semantic, ["qid", "p"])
        assert [r.p for r in out.orderBy("rank").collect()] == ["P1", "P2"] and status == said


def test_cosine_groups(spark):
    """Many small groups give the brute-force result, ties by id; odd vectors take no part."""
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(900, [0.0] * 4), (901, None), (902, [float("nan")] * 4), (903, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector.cosine_topk(v, v.where("vec_id % 7 = 0"), 5, group_rows=20).collect()
    unit = {i: x / np.linalg.norm(x) for i, x in enumerate(m) if x.any()}
    want = {}
    for q in unit:
        if q % 7 == 0:
            ranked = sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in unit))[:5]
            want[q] = [i for _, i in ranked]
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.qid, []).append(r.vec_id)
    assert by == want
    assert vector.cosine_topk(v, v.limit(0), 5).count() == 0 and vector.cosine_topk(v.limit(0), v, 5).count() == 0


def test_metrics_without_results(spark):
    ranked = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 10, 4)], "qid long, item long, rank int")
    rel = spark.createDataFrame([(1, 10), (2, 10), (1, 12)], "qid long, item long")
    per = {r.qid: r for r in vector.metrics(ranked, rel).collect()}
    assert len(per) == 2 and per[1].mrr == 0.5 and per[2].mrr == per[2].ndcg == per[2].recall_at_5 == 0.0
    assert abs(per[1].ndcg - (1 / 1.584962500721156) / (1 + 1 / 1.584962500721156)) < 1e-12


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2)], "qid long, item string, rank int")
    rel = spark.createDataFrame([(1, "a"), (2, "d")], "qid long, item string")
    per = {r.qid: r for r in vector.metrics(ranked, rel).collect()}
    assert (per[1].recall_at_1, per[2].recall_at_1, per[2].recall_at_3) == (1.0, 0.0, 1.0) and (per[1].mrr + per[2].mrr) / 2 == 0.75


def test_evidence(spark):
    r = spark.createDataFrame([(1, i % 9, i, "t" * 1500 if i else "") for i in range(12)], "qid long, doc long, rank long, text string")
    out = evidence.pack(r).orderBy("rank").collect()
    assert [x.evidence_id for x in out] == [f"E{i}" for i in range(1, 8)] and [x.char_limit for x in out] == [1200] * 6 + [800] and all(len(x.text) <= x.char_limit for x in out)
    q = spark.createDataFrame([(1, "Which thermal stability tests?"), (2, "short")], "qid long, question string")
    t = spark.createDataFrame([(1, "thermal nothing")], "qid long, text string")
    assert {x.qid: x.passed for x in evidence.gate(t, q).collect()} == {1: False, 2: True}
    packs = spark.createDataFrame([(1, "E1"), (1, "E2")], "qid long, evidence_id string")
    c = spark.createDataFrame([(1, 1, "ok", ["E2", "E1", "E2"]), (1, 2, "bad", ["E1", "E9"]), (1, 3, "none", []), (1, 4, " ", ["E1"]), (1, 5, "null", None), (2, 6, "no pack", ["E1"])], "qid long, claim long, text string, evidence_ids array<string>")
    checked = evidence.claims_checked(c, packs)
    assert {x.claim: (x.cited, x.warning) for x in checked.collect()} == {1: (["E1", "E2"], None), 2: (None, "UNKNOWN_EVIDENCE_ID"), 3: (None, "MISSING_CITATION"), 4: (None, "INVALID_CLAIM"), 5: (None, "MISSING_CITATION"), 6: (None, "UNKNOWN_EVIDENCE_ID")}
    assert {x.qid: x.status for x in evidence.answers(checked).collect()} == {1: "supported", 2: "validation_failed"}


def test_batches(spark):
    inputs = spark.createDataFrame([("i1", b"x"), ("i2", b"x"), ("i3", b"y"), ("i4", None)], "input_id string, content binary")
    rows = {r.input_id: r for r in batch.identified(inputs, "input_id", "content").collect()}
    assert rows["i2"].duplicate_of == "i1" and rows["i1"].duplicate_of is None and rows["i4"].document_id == "doc_unreadable_i4"
    docs = spark.createDataFrame([(f"d{i}", i) for i in range(5)], "document_id string, position int")
    done = spark.createDataFrame([("d0", "completed"), ("d1", "failed"), ("d2", "pending")], "document_id string, status string")
    assert [r.document_id for r in batch.pending(docs, done, 2).collect()] == ["d2", "d3"]
    target = spark.createDataFrame([("s", "1", "old"), ("t", "2", "keep")], "source string, id string, text string")
    new = spark.createDataFrame([("s", "3", "new"), ("s", "4", "")], "source string, id string, text string")
    assert sorted(r.id for r in batch.upsert(target, new, "source", ["id", "text"]).collect()) == ["2", "3"]
    p = pages(spark, "one", "two")
    first = batch.changed_sources(p, spark.createDataFrame([], "source_file string, digest string"))
    assert first.count() == 1 and batch.changed_sources(p, first).count() == 0 and batch.changed_sources(pages(spark, "one", "2"), first).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("page one\f\fpage three")
    (tmp_path / "in/sub/b.txt").write_text(" \f ")
    rows = ingest.pages(ingest.files(spark, str(tmp_path / "in"), "*.txt")).collect()
    assert sorted((r.page_number, r.is_empty) for r in rows if r.error is None) == [(1, False), (2, True), (3, False)] and [r.error for r in rows if r.error] == ["no text"]

    def broken(_: bytes) -> list[str]:
        raise OSError

    assert {r.error for r in ingest.pages(ingest.files(spark, str(tmp_path / "in")), broken).collect()} == {"OSError"}
    (tmp_path / "x.json").write_text('{"a": 1}\n{bad\n')
    good, bad = ingest.json_rows(spark, str(tmp_path / "x.json"), spark.createDataFrame([], "a int").schema)
    assert good.count() == 1 and bad.count() == 1
    data = {"passages": [{"passage_id": "p", "text": "t", "section": "s"}] * 2, "queries": [{"query_id": "q", "category": "c", "query": "?", "relevant_passage_ids": ["z"], "primary_relevant_passage_id": "p"}]}
    (tmp_path / "b.json").write_text(json.dumps(data))
    assert {r.problem for r in ingest.benchmark(spark, str(tmp_path / "b.json"))[2].collect()} == {"repeated passage", "unknown passage", "primary not relevant"}
    df = spark.createDataFrame([("a**b**", True, ["x", "y"], None)], "t string, f boolean, l array<string>, n int")
    assert tuple(sinks.flattened(df).first()) == ("ab", "是", "x; y", X.NOT_FOUND)
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    sinks.write_manifest({"v": 1}, str(tmp_path / "m.json"))
    with pytest.raises(TypeError):
        sinks.write_manifest({"v": object()}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"v": 1} and len(list(tmp_path.glob("*.tmp"))) == 0


def test_streams(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    docs.where("doc_id < 50").write.parquet(source)
    shape = lambda df: df.withColumn("n", F.length("text"))
    streaming.follow(spark, source, docs.schema, target, check, shape, "doc_id").awaitTermination()
    docs.where("doc_id between 40 and 79").write.mode("append").parquet(source)
    streaming.follow(spark, source, docs.schema, target, check, shape, "doc_id").awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == list(range(80))
    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ev")).schema).parquet(str(tmp_path / "ev"))
    counts = streaming.windowed_counts(streaming.first_seen(events, ["event_id"], "ts", "10 days"), "ts", "1 day", None, "event_type")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_facts_of_ascii_sentences(spark):
    """Sentences read in Arrow batches give what the patterns give in the JVM, which reads the others."""
    import random

    from pyspark.sql import functions as F

    from corpusgrid.operators import facts

    words = "The study included 20 participants subjects, n = 14 were randomized to the drug and placebo group two arms at -3.5 C stored for 12 weeks. 5 mg/mL dose of 3 mg/kg p < 0.05 P=.01 95% CI: 1.2-3.4 mean +/- 2 model fitting r 2 R square used measured significant increased retained! Double-blind control group limited by replication? We conclude demonstrated i ncreased p attern t o s upport Open access Table 3 Methods µM ± 4 ° naïve ſtable Kelvin ́ 。 \t \n \r\n \x1c  ".split(" ")
    draw = random.Random(5)
    rows = [(f"d{i % 7}", i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 25)))) for i in range(400)] + [("x", 1, None), ("x", 2, "")]
    p = spark.createDataFrame(rows, "source_file string, page_number long, text string").repartition(3)
    one, two = (sorted(map(tuple, facts.facts(p, rules).collect())) for rules in (None, dict(facts.RULES)))
    assert one == two and len({r[3] for r in one}) > 10
    kept = facts.facts(p, None, "n") if "n" in p.columns else facts.facts(p.withColumn("n", F.lit(1)), None, "n")
    assert kept.count() == len(one) and kept.columns[-1] == "n"


def test_facts_are_worked_out_once(spark):
    """Placing facts in sections, or on raw pages, reads the pages' facts once."""
    from corpusgrid.operators import facts, quotes

    p = spark.createDataFrame([("a", 1, "Methods\nWe used 20 participants.\nResults\nIt increased. It increased."), ("a", 2, "Results\nIt increased.")], "source_file string, page_number long, text string")
    sections = spark.createDataFrame([("a", "methods", "Methods", "We used 20 participants.", 1, 1), ("a", "results", "Results", "It increased.", 2, 2)], "source_file string, section string, title string, text string, page_start long, page_end long")
    for df in (facts.in_sections(facts.facts(p), sections), quotes.raw_facts(p)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("cut(") == 1, plan
    got = {(r.quote, r.page_number, r.section) for r in facts.in_sections(facts.facts(p), sections).collect()}
    assert {s for q, _, s in got if q == "It increased."} == {"results"} and len(got) > 2
