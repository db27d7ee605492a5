"""Failure codes and categories, inherited fields, positional joins and batch scope."""

import uuid

from pyspark.sql import functions as F

from corpusgrid.operators import failures, ranks
from corpusgrid.operators.scope import ScopedStore, batches
from corpusgrid.session import shared_dir


def test_failures(spark):
    rows = [
        ("c1", None, "x", "c1", "UNKNOWN_PROVIDER_ERROR"), (None, None, "达到 硬上限 now", "hard_request_limit", "UNKNOWN_PROVIDER_ERROR"), ("", None, "JSON 顶层 wrong", "invalid_json", "MALFORMED_PROVIDER_RESPONSE"), (None, 401, "no", "provider_request_error", "AUTH_ERROR"),
        ("rate_limit", 503, None, "rate_limit", "RATE_LIMIT"), (None, 418, "output_limit_reached", "output_limit_reached", "PROVIDER_4XX"), (None, 700, "Unreachable", "provider_request_error", "CONNECTION_ERROR"), (None, 500, "", "provider_request_error", "PROVIDER_5XX"), (None, None, None, "provider_request_error", "UNKNOWN_PROVIDER_ERROR"),
    ]
    df = spark.createDataFrame(rows, "code string, status int, message string, want string, category string")
    for r in df.select("*", failures.failure_code(F.col("code"), F.col("message")).alias("got"), failures.error_category(F.col("code"), F.col("status"), F.col("message")).alias("kind")).collect():
        assert (r.got, r.kind) == (r.want, r.category), r
    one = spark.createDataFrame([("Bearer abc, api_key=xyz; mine is s3cret",)], "m string")
    assert one.select(failures.sanitized(F.col("m"), "s3cret").alias("m")).first().m == "Bearer [已脱敏], api_key=[已脱敏]; mine is [已脱敏]"
    calls = spark.createDataFrame([(1, "timeout", None, None, None, None, None, None), (2, None, None, None, None, "", False, None), (3, None, None, None, None, "{", False, None), (4, None, None, None, None, "{}", True, ["INVALID_CLAIM", "X"]), (5, None, None, None, None, "{}", True, [])], "id int, error string, code string, status int, kind string, content string, parsed boolean, warnings array<string>")
    assert [(r.stage, r.outcome) for r in failures.trace(calls).orderBy("id").collect()] == [("request", "TIMEOUT"), ("parse", "EMPTY_RESPONSE"), ("parse", "INVALID_JSON"), ("validate", "INVALID_SCHEMA"), ("done", "VALID")]


def test_inherited(spark):
    final = spark.createDataFrame([(1, "", None, [], 7), (2, "own", ["x"], ["y"], None), (3, None, None, None, 1)], "k int, a string, b array<string>, c array<string>, inherited int").drop("inherited")
    parts = spark.createDataFrame([(1, 2, "late", ["l"], None), (1, 1, "", ["first"], []), (1, 3, "later", [], ["c"]), (2, 1, "no", ["no"], ["no"])], "k int, at int, a string, b array<string>, c array<string>")
    got = {r.k: (r.a, r.b, r.c, r.inherited) for r in failures.inherited(final, parts, "k", "at", ["a", "b", "c"]).collect()}
    assert got == {1: ("late", ["first"], ["c"], ["a", "b", "c"]), 2: ("own", ["x"], ["y"], []), 3: (None, None, None, [])}


def test_positional(spark):
    rows = spark.createDataFrame([(1, "a", "r1"), (2, "b", "r2"), (3, "a", "r3"), (4, None, "r4")], "at int, id string, v string").repartition(3)
    papers = spark.createDataFrame([(10, "a"), (20, "z"), (30, None), (40, "b"), (50, "q")], "at int, id string").repartition(2)
    got = [(r.id, r.row and r.row.v, r.matched) for r in ranks.positional(rows, papers, "id", "at", "at").orderBy("at").collect()]
    assert got == [("a", "r3", "key"), ("z", "r2", "position"), (None, "r3", "position"), ("b", "r2", "key"), ("q", None, None)]


def test_scope_reads_only_its_batches(spark):
    store = ScopedStore(spark, f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}")
    rows = [(b, f"{b}{i}", f"s{i % 2}", "Methods", f"text {i}") for b in ("b1", "b2", "b3") for i in range(4)] + [(None, "x", "s", "m", "t")]
    df = spark.createDataFrame(rows, "batch_id string, passage_id string, source_file string, section string, text string")
    asked = lambda known: known.select(F.lit(1).cast("long").alias("context_id"), "batch_id", "digest")
    contexts = asked(batches(df).where("batch_id in ('b1', 'b2')"))
    assert [r.state for r in store.states(contexts).collect()] == ["missing"] * 2 and store.passages(contexts).count() == 0
    assert store.put(df) == 1
    found = store.passages(contexts)
    assert sorted(r.passage_id for r in found.collect()) == [f"b{b}{i}" for b in (1, 2) for i in range(4)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    store.put(df.where("batch_id = 'b2' and passage_id <> 'b20'"))
    assert {r.batch_id: r.state for r in store.states(contexts).collect()} == {"b1": "present", "b2": "stale"}
    assert {r.batch_id for r in store.passages(contexts).collect()} == {"b1"}
    again = asked(batches(df.where("batch_id = 'b2' and passage_id <> 'b20'")))
    assert sorted(r.passage_id for r in store.passages(again).collect()) == ["b21", "b22", "b23"]  # from its last version alone
