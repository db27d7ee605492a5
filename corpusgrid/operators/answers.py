"""Structured answers: parsing, the two accepted spellings, shape without values, and strict validation with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.operators import evidence

TOP, CLAIM = ("status", "claims", "limitations"), ("text", "evidence_ids")


def unfenced(content: Column) -> Column:
    """The content without a code fence that encloses all of it."""
    inner = F.regexp_extract(F.trim(content), r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(content))


def shape(content: Column) -> Column:
    """What a JSON object looks like without its values: sorted keys with their types, or null."""
    body = unfenced(content)
    keys = F.array_sort(F.json_object_keys(body))
    kind = F.schema_of_variant(F.try_parse_json(body))
    return F.when(keys.isNotNull(), F.struct(keys.alias("keys"), kind.alias("types")))


def read(responses: DataFrame) -> DataFrame:
    """qid, problem, status, limitations, claims (text, evidence_ids, problem) of qid, content, finish_reason.

    `claim` stands for `text` where that is missing, and a non-empty string for a list of limitations; a clash of the two spellings or another
    type fails the answer as a whole. A claim with other fields is dropped; what it says of pages or sources is never used.
    """
    rows = responses.withColumn("body", unfenced(F.col("content")))
    rows = rows.withColumns({"v": F.try_parse_json("body"), "keys": F.json_object_keys("body")})
    rows = rows.withColumns({
        "status": F.try_variant_get("v", "$.status", "string"), "list": F.try_variant_get("v", "$.limitations", "array<variant>"), "one": F.schema_of_variant(F.try_variant_get("v", "$.limitations", "variant")),
        "raw": F.try_variant_get("v", "$.claims", "array<variant>"),
    })
    fields = lambda c: F.coalesce(F.json_object_keys(F.to_json(c)), F.array().cast("array<string>"))
    kind = lambda c, path: F.schema_of_variant(F.try_variant_get(c, path, "variant"))
    rows = rows.withColumn("found", F.transform("raw", lambda c: F.struct(
        fields(c).alias("fields"), kind(c, "$.text").alias("text_kind"), kind(c, "$.claim").alias("alias_kind"),
        F.coalesce(F.try_variant_get(c, "$.text", "string"), F.try_variant_get(c, "$.claim", "string")).alias("text"), F.try_variant_get(c, "$.evidence_ids", "array<string>").alias("ids"),
    )))
    has = lambda c, name: F.array_contains(c["fields"], name)
    known = F.array(*map(F.lit, TOP))
    texts = F.when(F.col("one") == "STRING", F.try_variant_get("v", "$.limitations", "string") != "").otherwise(F.col("list").isNotNull() & F.forall("list", lambda x: F.schema_of_variant(x) == "STRING"))
    problem = (
        F.when(F.col("finish_reason") == "length", "TRUNCATED").when(F.col("v").isNull() | F.col("keys").isNull(), "INVALID_JSON_STRUCTURE").when(F.size(F.array_except("keys", known)) > 0, "UNKNOWN_TOP_LEVEL_FIELD")
        .when(F.size(F.array_except(known, F.col("keys"))) > 0, "TOP_LEVEL_SCHEMA_ERROR").when(~F.coalesce(F.col("status").isin("supported", "insufficient_evidence"), F.lit(False)), "INVALID_STATUS")
        .when(~F.coalesce(texts, F.lit(False)), "LIMITATIONS_INVALID_TYPE").when(F.col("raw").isNull(), "INVALID_CLAIMS")
        .when(F.exists("found", lambda c: has(c, "claim") & has(c, "text")), "NORMALIZATION_CONFLICT").when(F.exists("found", lambda c: has(c, "claim") & (c["alias_kind"] != "STRING")), "INVALID_CLAIM_ALIAS_TYPE")
        .when((F.col("status") == "insufficient_evidence") & (F.size("raw") > 0), "STATUS_CLAIM_INCONSISTENCY")
    )
    allowed = F.array(*map(F.lit, (*CLAIM, "claim")))
    one = lambda c: F.when(F.size(c["fields"]) == 0, "INVALID_CLAIM").when(F.size(F.array_except(c["fields"], allowed)) > 0, "UNKNOWN_CLAIM_FIELD").when(has(c, "text") & (c["text_kind"] != "STRING"), "INVALID_CLAIM")
    claims = F.transform("found", lambda c: F.struct(c["text"].alias("text"), c["ids"].alias("evidence_ids"), one(c).alias("problem")))
    limits = F.when(F.col("one") == "STRING", F.array(F.try_variant_get("v", "$.limitations", "string"))).otherwise(F.try_variant_get("v", "$.limitations", "array<string>"))
    rows = rows.withColumn("problem", problem)
    ok = F.col("problem").isNull()
    return rows.select("qid", "problem", "status", F.when(ok, F.filter(F.transform(limits, F.trim), lambda x: x != "")).alias("limitations"), F.when(ok, claims).alias("claims"))


def validated(responses: DataFrame, packs: DataFrame) -> DataFrame:
    """qid, status, n_claims, warnings: supported with at least one claim whose citations are all in its pack, insufficient_evidence, or validation_failed."""
    rows = read(responses)
    claims = rows.where("problem is null and status = 'supported'").select("qid", F.posexplode("claims").alias("claim", "c")).select("qid", "claim", "c.*")
    good = evidence.claims_checked(claims.where("problem is null").drop("problem"), packs).select("qid", "warning")
    every = good.unionByName(claims.where("problem is not null").select("qid", F.col("problem").alias("warning")))
    per = evidence.answers(every)
    out = rows.select("qid", "problem", F.col("status").alias("said")).join(per, "qid", "left")
    status = F.when(F.col("problem").isNotNull(), "validation_failed").when(F.col("said") == "insufficient_evidence", "insufficient_evidence").otherwise(F.coalesce("status", F.lit("validation_failed")))
    warnings = F.coalesce("problem", F.when(F.col("said") == "insufficient_evidence", "").otherwise(F.coalesce("warnings", F.lit("NO_VALID_CLAIMS"))))
    return out.select("qid", status.alias("status"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), warnings.alias("warnings"))
