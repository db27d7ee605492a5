"""The pipeline stage by stage against brute-force versions."""

import corpus_pipeline as P
from test_operators import brute_components, groups

from corpusgrid.llm import mixing, quality
from corpusgrid.session import materialise


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    (_, rules), (_, exact), (_, near), (_, mixed), (_, packed) = P.STAGES
    one = materialise(rules(spark, docs, sf), "t1")
    verdict = quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert one.columns == columns and set(ids(one)) == {r.doc_id for r in verdict.select("doc_id", "kept").collect() if r.kept}
    two = materialise(exact(spark, one, sf), "t2")
    assert two.columns == columns and set(ids(two)) == {min(v) for v in groups(ids(one).items()).values()}
    three = materialise(near(spark, two, sf), "t3")
    assert three.columns == columns and set(ids(three)) == {root for _, root in brute_components(ids(two).items()).values()}
    four = materialise(mixed(spark, three, sf), "t4")
    order = [r.doc_id for r in mixing.mix(three).orderBy("mix_slot", "mix_row").select("doc_id").collect()]
    assert four.columns == columns and sorted(order) == sorted(ids(four))
    rank = {d: i for i, d in enumerate(order)}
    files = four.repartition(7)  # whatever the files, sequences follow the mixed order
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    five = packed(spark, files, sf).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {}
    for r in five:
        tasks.setdefault(r.sequence_id >> 36, set()).add(rank[r.doc_id])
    assert len(tasks) > 1 and [x for t in sorted(tasks) for x in sorted(tasks[t])] == list(range(len(order)))
    assert {r.doc_id for r in five} == set(order)
    assert {r.doc_id for r in P.run(spark, sf).collect()} == set(order)


def test_odd_rows(spark, sf):
    """Nulls in any column, repeated rows and ids, and columns of clashing names go through all stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars").select(*docs.columns))
    odd = odd.unionByName(docs.limit(1).selectExpr("doc_id", "cast(null as string) text", "lang", "source", "n_chars").select(*docs.columns))
    odd = materialise(odd.selectExpr("*", "1 kept", "2 keep_id", "3 mix_slot", "'x' component_id", "4 n_words"), "odd")
    for _, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, odd, sf), "odd")
        assert out.columns == odd.columns and 0 < out.count() <= odd.count()
        odd = out
    assert P.STAGES[-1][1](spark, odd, sf).count() > 0


def test_rows_that_share_an_id(spark, sf):
    """Only the near copy goes, whatever shares its id."""
    words = [f"word{i}" for i in range(60)]
    a, near_a, b = " ".join(words), " ".join([*words, "more"]), " ".join(f"other{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, "s", "x"), (5, near_a, "s", "y"), (5, b, "s", "z"), (7, "short text", "s", None), (None, near_a, "s", "n")], "doc_id long, text string, source string, component_id string")
    docs = materialise(docs, "t-shared")
    got = P.near(spark, docs, sf).collect()
    assert sorted(tuple(r) for r in got if r.doc_id) == [(1, a, "s", "x"), (5, b, "s", "z"), (7, "short text", "s", None)] and len(got) == 4


def test_clashing_columns_keep_their_values(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = materialise(docs.selectExpr("*", "doc_id + 1 kept", "'k' keep_id", "doc_id * 3 mix_slot", "'x' component_id", "array(doc_id) n_words", "doc_id text_digest", "7 id"), "t-clash")
    for _, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, odd, sf), "t-clash")
        assert out.columns == odd.columns and out.dtypes == odd.dtypes and 0 < out.count() <= odd.count()
        assert out.where("kept <> doc_id + 1 or keep_id <> 'k' or mix_slot <> doc_id * 3 or component_id <> 'x' or n_words[0] <> doc_id or text_digest <> doc_id or id <> 7").count() == 0
        odd = out


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = docs if out.columns != docs.columns else out
