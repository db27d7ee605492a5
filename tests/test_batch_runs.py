"""Batches that are paused, killed and resumed; ranks in huge groups."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpusgrid.operators import batch, ranks, runs
from corpusgrid.session import shared_dir


def fresh(spark):
    return runs.BatchRun(spark, f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, content string").repartition(3)


ROWS = [(i, f"file{i % 4}" if i != 7 else None, None if i == 9 else f"text {i % 13}" + (" bad" if i % 6 == 0 else "")) for i in range(40)]


def extract(docs):
    """Fails for texts with `bad`, says nothing of one, and gives another twice."""
    said = docs.where("content <> 'text 5'").select("document_id", F.upper("content").alias("result"), F.when(F.contains("content", F.lit("bad")), "bad").alias("error"))
    return said.unionByName(docs.where("content = 'text 4'").select("document_id", F.lit("second").alias("result"), F.lit("late").alias("error")))


def opened(spark, rows):
    run = fresh(spark)
    run.open(frame(spark, rows), F.col("name"), F.col("content"), "id")
    return run


def picture(run):
    docs = {r.document_id: (r.position, r.name, r.status, r.error, r.result, r.n_inputs) for r in run.documents().collect()}
    return docs, sorted((r.position, r.alias, r.status, r.duplicate_of is not None) for r in run.inputs().collect()), tuple(run.state().first())


def test_killed_and_resumed_equals_uninterrupted(spark):
    whole = opened(spark, ROWS)
    assert whole.run(extract) == "completed_with_errors"
    want = picture(whole)
    run = opened(spark, ROWS)
    assert run.run(extract, pause_after=5) == "paused" and run.state().first().status == "paused"
    assert run.documents().where("status <> 'pending'").count() == 5
    first = sorted(r.position for r in run.documents().where("status <> 'pending'").collect())
    assert first == sorted(p for p, *_ in want[0].values())[:5]  # by position
    assert run.run(extract, pause_after=0) == "paused"

    def dies(docs):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        run.run(dies)

    def dies_late(docs):  # after the first wave
        dies_late.calls += 1
        if dies_late.calls > 1:
            raise RuntimeError("killed")
        return extract(docs)

    dies_late.calls = 0
    with pytest.raises(RuntimeError):
        run.run(dies_late, wave=4)
    assert run.documents().where("status <> 'pending'").count() == 9
    again = runs.BatchRun(spark, run.store.folder)
    assert again.run(extract, wave=7) == "completed_with_errors"
    assert picture(again) == want
    calls = []
    assert again.run(lambda d: calls.append(1) or extract(d)) == "completed_with_errors" and not calls  # nothing is left to do


def test_other_inputs_keep_ids_and_results(spark):
    run = opened(spark, [r for r in ROWS if r[0] % 10 != 3])
    run.run(extract, pause_after=6)
    before = {r.alias: r.input_id for r in run.inputs().collect()}
    done = {r.document_id: r.result for r in run.documents().where("status <> 'pending'").collect()}
    run.open(frame(spark, ROWS), F.col("name"), F.col("content"), "id")
    after = {r.alias: r.input_id for r in run.inputs().collect()}
    assert len(after) == 40 and all(after[a] == i for a, i in before.items()) and len(set(after.values())) == 40
    assert {r.document_id: r.result for r in run.documents().where("status <> 'pending'").collect()} == done
    run.update(spark.createDataFrame([(next(iter(done)), 1, "x"), ("doc_unknown", 2, "y")], "document_id string, rank int, path string"))
    run.update(spark.createDataFrame([(next(iter(done)), 9)], "document_id string, rank int"))
    assert [tuple(r) for r in run.updates().select("document_id", "rank").collect()] == [(next(iter(done)), 9)]
    run.pause()
    assert run.state().first().status == "paused"


def test_missing_and_empty_batches(spark):
    with pytest.raises(runs.MissingBatch):
        fresh(spark).run(extract)
    run = opened(spark, [])
    assert run.run(extract) == "completed" and run.state().first().documents == 0


def test_ranks_in_one_huge_group(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    got = ranks.ranked(df, ["k"], [F.desc("v"), "i"]).collect()
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k, []).append((-v, i))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert {r.i: r["rank"] for r in got} == want
    named = batch.aliases(df.select("i", F.lit("same").alias("name")), F.col("name"), "i")
    assert {r.i: r.alias for r in named.where("i < 3").collect()} == {0: "same", 1: "same #2", 2: "same #3"} and named.select("alias").distinct().count() == 3000
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ranks.ranked(df.limit(0), ["k"], ["v"]).collect() == []
