"""Routed search, the incremental index, and what a report shows."""

import pytest
from pyspark.sql import functions as F

from corpusgrid.operators import batch, index, report, search

PASSAGES = [
    ("p1", "a.pdf", "Results", "The effect was large (p < 0.05) and p < 0.051 elsewhere."),
    ("p2", "a.pdf", "Methods", "We report the p-value of each test."),
    ("p3", "b.pdf", "References", "Effect sizes, p < 0.05."),
    ("p4", "b.pdf", "Results", "Large effect. The effect was small; large effect large effect."),
    ("p5", None, None, None),
]


@pytest.fixture
def passages(spark):
    return spark.createDataFrame(PASSAGES, "passage_id string, source_file string, section string, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.passage_id)
    return out


def test_filters(passages):
    ids = lambda *a, **k: [r.passage_id for r in search.passages(passages, *a, **k).orderBy("passage_id").collect()]
    assert ids() == ["p1", "p2", "p4"]
    assert ids(references=True) == ["p1", "p2", "p3", "p4", "p5"]
    assert ids(["b.pdf"]) == ["p4"] and ids([]) == [] and ids(sections=["methods"]) == ["p2"]


def test_routes(spark, passages):
    asked = queries(spark, " ", "p < 0.05", "p value", '"large effect"', "small effect", None, "p<.05", '"effect large small"')
    got = found(search.search(passages, asked))
    assert got == {1: ["p1"], 2: ["p2", "p1"], 3: ["p4"], 4: ["p4", "p1"]}
    assert found(search.search(passages, asked, limit=0))[2] == ["p2"]
    assert found(search.search(passages, asked, references=True))[1] == ["p1", "p3"]  # p1 holds the query twice
    assert found(search.search(passages.limit(0), asked)) == {}


def test_phrase_counts(spark, passages):
    hits = search.phrases(passages, queries(spark, '"effect"', '"effect was"', '"large effect large effect"', '"effect large"')).collect()
    assert {(r.qid, r.passage_id) for r in hits} == {(0, "p1"), (0, "p3"), (0, "p4"), (1, "p1"), (1, "p4"), (2, "p4"), (3, "p4")}


def test_index(spark):
    passages = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None), ("d", "bad")], "passage_id string, text string")
    cache = spark.createDataFrame([], "passage_id string, encoder string, text_hash string, dimension int, vector array<float>")
    name = index.fingerprint(dimension=2, version="1")
    assert name == index.fingerprint(version="1", dimension=2) != index.fingerprint(version="2", dimension=2)
    vector = F.when(F.col("text") == "bad", F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.length("text").cast("double")))
    encode = lambda rows: rows.select("passage_id", vector.alias("vector"))
    cache, stats = index.build(passages, cache, encode, name, 2)
    assert index.state(stats).first().asDict() == {"total": 4, "cached": 0, "encoded": 3, "failed": 1, "state": "PARTIAL"}
    changed = passages.withColumn("text", F.when(F.col("passage_id") == "a", "new").otherwise(F.col("text"))).where("passage_id <> 'd'")
    cache, stats = index.build(changed, cache, encode, name, 2)
    assert index.state(stats).first().asDict() == {"total": 3, "cached": 2, "encoded": 1, "failed": 0, "state": "READY"}
    assert cache.count() == 3
    assert index.state(index.build(passages.limit(0), cache, encode, name, 2)[1]).first().state == "EMPTY"
    with pytest.raises(ValueError):
        index.cleared(cache)
    assert index.cleared(cache, confirm=True).count() == 0


@pytest.mark.parametrize(("text", "want"), [("", True), (None, True), ("Keywords: a", True), ("See a@b.org.", True), ("Department, of x", True), ("The trial ended.", False)])
def test_non_content(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(report.non_content(F.col("t")).alias("x")).first().x is want


def test_keys_and_tokens(spark):
    row = spark.range(1).select(
        report.sentence_key(F.lit("Methods We measured ； x 。")).alias("one"), report.sentence_key(F.lit("we measured;x.")).alias("two"),
        report.protected_tokens(F.lit("p < 0.05, 12 mg/kg and 5%")).alias("tokens"),
        report.preserved(F.lit("12 weeks"), F.lit("nach 12 Weeks")).alias("yes"), report.preserved(F.lit("12 weeks"), F.lit(None)).alias("no"),
    ).first()
    assert row.one == row.two
    assert row.tokens == ["0.05", "12", "12mg/kg", "5", "5%", "p<0.05"]
    assert row.yes and not row.no


def test_pickers(spark):
    rows = spark.createDataFrame(
        [("d", "discussion", 1, "A limitation is the small sample."), ("d", "discussion", 2, "Results are preliminary."), ("d", "discussion", 3, "A limitation is the small sample."), ("d", "conclusion", 4, "The model showed improvement."), ("d", "conclusion", 5, "Is it so?"), ("e", "abstract", 1, "Nothing here.")],
        "document_id string, section string, position int, text string",
    )
    limits = report.limitations(rows)
    assert [(r.document_id, r.text) for r in limits.orderBy("rank").collect()] == [("d", "A limitation is the small sample."), ("d", "Results are preliminary.")]
    assert {r.document_id: r.text for r in report.conclusions(rows, limits).collect()} == {"d": "The model showed improvement.", "e": "Nothing here."}
    assert report.conclusions(rows.limit(0), limits).count() == 0


def test_samples_and_evidence(spark):
    facts = spark.createDataFrame(
        [("d", 1, "sample_size", 1, None, "We enrolled 40 patients,"), ("d", 2, "sample_size", 1, None, "n = 20 each"), ("d", 3, "other", 1, None, "x"), ("d", 4, "sample_size", 2, True, "n = 3"), ("e", 1, "sample_size", 1, None, None)],
        "document_id string, position int, category string, page int, table boolean, text string",
    )
    assert [tuple(r) for r in report.sample_sizes(facts).collect()] == [("d", "40 patients; n = 20")]
    rows = spark.createDataFrame([("d", 1, "results", "a", "q1", [1]), ("d", 2, "results", "b", "q1", [1]), ("d", 3, "results", "a", "q1", [1]), ("d", 4, "References", "a", "q2", [1]), ("d", 5, None, None, "q3", None)], "document_id string, position int, section string, category string, quote string, pages array<int>")
    assert [(r.quote, r.categories) for r in report.merged_evidence(rows).orderBy("rank").collect()] == [("q1", ["a", "b"]), ("q3", [None])]


def test_segments(spark):
    pages = spark.createDataFrame([("a", 1, "one\n two\n\nSome Heading\nthree\nfour."), ("b", 1, None)], "source_file string, page_number int, text string")
    got = report.segments(pages, ["source_file", "page_number"]).orderBy("source_file", "segment").collect()
    assert [(r.source_file, r.segment, r.text) for r in got] == [("a", 1, "one two"), ("a", 2, "Some Heading"), ("a", 3, "three four.")]


def test_batch_outcome(spark):
    inputs = spark.createDataFrame([("i1", "a", None), ("i2", "a", "i1"), ("i3", "b", None), ("i4", "c", None)], "input_id string, document_id string, duplicate_of string")
    documents = spark.createDataFrame([("a", "completed"), ("b", "failed")], "document_id string, status string")
    rows = batch.statuses(inputs, documents)
    assert {r.input_id: r.status for r in rows.collect()} == {"i1": "completed", "i2": "duplicate", "i3": "failed", "i4": "pending"}
    assert batch.outcome(rows, documents).first().asDict() == {"inputs": 4, "duplicates": 1, "skipped": 0, "documents": 2, "completed": 1, "failed": 1, "status": "completed_with_errors"}
    assert batch.outcome(rows.limit(0), documents.limit(0)).first().status == "completed"


def test_text_is_collapsed_once(spark):
    """A text is collapsed once for all marks of what is no content."""
    from corpusgrid.operators import report

    rows = spark.createDataFrame([("The effect was large.",), (" ",), (None,), ("Keywords: a",), ("A, University, x",), ("See doi.org/1",), ("Ünï  café institute, Paris",)], "text string")
    df = rows.where(~report.non_content(rows["text"]))
    assert [r[0] for r in df.collect()] == ["The effect was large."]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1


def test_search_keeps_what_it_can_show(spark, monkeypatch):
    """Ranked lists are cut at the limit and what the filters can take away, with the same results."""
    from corpusgrid.operators import lexical

    rows = spark.createDataFrame([(i, "s", "References" if i % 4 == 0 else "Methods", "heat " * (i % 5 + 1) + f"word{i % 3} " * (i % 7)) for i in range(60)], "passage_id long, source_file string, section string, text string")
    asked = spark.createDataFrame([(1, "heat word1"), (2, "word2"), (3, "none")], "qid long, text string")
    took, whole = [], lexical.bm25
    monkeypatch.setattr(lexical, "bm25", lambda d, q, k, *rest: took.append(k) or whole(d, q, k, *rest))
    cut = sorted(map(tuple, search.search(rows, asked, 4).collect()))
    monkeypatch.setattr(lexical, "bm25", lambda d, q, k, *rest: whole(d, q, None, *rest))
    assert cut == sorted(map(tuple, search.search(rows, asked, 4).collect())) and len(cut) == 8
    assert took == [4 + 15]
