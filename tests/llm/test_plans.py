"""What the driver keeps of a plan: no array of all ratios is spelled out there, and no row carries one."""

import corpus_pipeline as P

from corpusgrid.llm import quality


def test_ratios_stand_in_no_plan(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{table}.parquet") for table in ("documents", "labels"))
    made = [quality.log_ratios(docs, quality.trusted_ids(labels)), quality.quality_rules(docs, labels), quality.query(spark, sf), P.quality(spark, docs, sf)]
    for df in made:
        query = df._jdf.queryExecution()
        for plan in (query.optimizedPlan().toString(), query.executedPlan().toString()):
            assert len(plan) < 50_000 and "__ratios" not in plan


def test_no_labels_give_zeros(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{table}.parquet") for table in ("documents", "labels"))
    assert quality.log_ratios(docs, quality.trusted_ids(labels.limit(0)), buckets=64).first()["ratios"] == [0.0] * 64
    assert quality.log_ratios(docs.limit(0), quality.trusted_ids(labels), buckets=64).first()["ratios"] == [0.0] * 64
    assert {r.llr_score for r in quality.quality_rules(docs, labels.limit(0)).select("llr_score").collect()} == {0.0}
