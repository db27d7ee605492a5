"""Structured answers case by case."""

import json

from pyspark.sql import functions as F

from corpusgrid.operators import answers

GOOD = {"status": "supported", "claims": [{"text": "x", "evidence_ids": ["E2", "E1"]}], "limitations": []}
CASES = {
    "plain": (GOOD, "supported", ""), "claim_alias": ({**GOOD, "claims": [{"claim": "x", "evidence_ids": ["E1"]}]}, "supported", ""), "string_limitations": ({**GOOD, "limitations": "few"}, "supported", ""),
    "empty_string_limitations": ({**GOOD, "limitations": ""}, "validation_failed", "LIMITATIONS_INVALID_TYPE"), "number_limitations": ({**GOOD, "limitations": [1]}, "validation_failed", "LIMITATIONS_INVALID_TYPE"),
    "both": ({**GOOD, "claims": [{"claim": "x", "text": "y", "evidence_ids": ["E1"]}]}, "validation_failed", "NORMALIZATION_CONFLICT"), "alias_type": ({**GOOD, "claims": [{"claim": 3, "evidence_ids": ["E1"]}]}, "validation_failed", "INVALID_CLAIM_ALIAS_TYPE"),
    "extra_top": ({**GOOD, "page": 1}, "validation_failed", "UNKNOWN_TOP_LEVEL_FIELD"), "missing_top": ({"status": "supported", "claims": []}, "validation_failed", "TOP_LEVEL_SCHEMA_ERROR"), "status": ({**GOOD, "status": "sure"}, "validation_failed", "INVALID_STATUS"),
    "claims_type": ({**GOOD, "claims": "x"}, "validation_failed", "INVALID_CLAIMS"), "page": ({**GOOD, "claims": [{"text": "x", "evidence_ids": ["E1"], "page": 3}]}, "validation_failed", "UNKNOWN_CLAIM_FIELD"),
    "unknown_id": ({**GOOD, "claims": [{"text": "x", "evidence_ids": ["E9"]}]}, "validation_failed", "UNKNOWN_EVIDENCE_ID"), "mixed": ({**GOOD, "claims": [*GOOD["claims"], {"text": "y", "evidence_ids": []}]}, "supported", "MISSING_CITATION"),
    "abstain": ({"status": "insufficient_evidence", "claims": [], "limitations": ["none"]}, "insufficient_evidence", ""), "inconsistent": ({**GOOD, "status": "insufficient_evidence"}, "validation_failed", "STATUS_CLAIM_INCONSISTENCY"),
    "no_claims": ({**GOOD, "claims": []}, "validation_failed", "NO_VALID_CLAIMS"),
}


def test_cases(spark):
    rows = [(k, json.dumps(v), "stop") for k, (v, _, _) in CASES.items()]
    rows += [("fenced", f"```json\n{json.dumps(GOOD)}\n```", "stop"), ("bad", "{nope", "stop"), ("array", "[1]", "stop"), ("cut", json.dumps(GOOD), "length"), ("null", None, None)]
    want = {k: (s, w) for k, (_, s, w) in CASES.items()} | {"fenced": ("supported", ""), "bad": ("validation_failed", "INVALID_JSON_STRUCTURE"), "array": ("validation_failed", "INVALID_JSON_STRUCTURE"), "cut": ("validation_failed", "TRUNCATED"), "null": ("validation_failed", "INVALID_JSON_STRUCTURE")}
    packs = spark.createDataFrame([(k, e) for k in want for e in ("E1", "E2")], "qid string, evidence_id string")
    got = {r.qid: (r.status, r.warnings) for r in answers.validated(spark.createDataFrame(rows, "qid string, content string, finish_reason string"), packs).collect()}
    assert got == want


def test_shape(spark):
    df = spark.createDataFrame([('{"b": 1, "a": ["x"]}',), ("[1]",), (None,)], "c string")
    got = [r.s for r in df.select(answers.shape(F.col("c")).alias("s")).collect()]
    assert got[0]["keys"] == ["a", "b"] and "BIGINT" in got[0]["types"] and got[1] is None and got[2] is None
