"""What became of calls to a model: failure codes, categories of provider errors, and fields taken over from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of failures with the words of their messages, and categories of errors in the order in which they are tried.
FAILURE_CODES = (("hard_request_limit", ("已达到模型请求硬上限", "硬上限")), ("output_limit_reached", ("output_limit_reached",)), ("invalid_provider_output", ("invalid_provider_output",)), ("invalid_json", ("不是有效 JSON", "JSON 顶层", "类型错误")))
OTHER_FAILURE = "provider_request_error"
CONNECTION_WORDS = ("connection", "connect", "reset", "refused", "unreachable")
REASONS = {
    "INVALID_JSON": "INVALID_JSON", "INVALID_JSON_STRUCTURE": "INVALID_SCHEMA", "INVALID_STATUS": "ILLEGAL_STATUS", "INVALID_CLAIMS": "INVALID_SCHEMA", "INVALID_CLAIM": "INVALID_SCHEMA",
    "UNKNOWN_EVIDENCE_ID": "UNKNOWN_EVIDENCE_ID", "MISSING_CITATION": "MISSING_EVIDENCE_ID", "NO_VALID_CLAIMS": "ALL_CLAIMS_REJECTED", "OUTPUT_LIMIT_REACHED": "OUTPUT_LIMIT_REACHED", "PROVIDER_CITATION_METADATA_IGNORED": "UNSAFE_CLAIM_METADATA",
}
OTHER_REASON = "OTHER_VALIDATION_FAILURE"
HIDDEN = "[已脱敏]"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def failure_code(code: Column, message: Column) -> Column:
    """The provider's own code if it gave one, else that of the first words its message holds."""
    message, out = F.coalesce(message, F.lit("")), F.when(F.coalesce(code, F.lit("")) != "", code)
    for name, words in FAILURE_CODES:
        out = out.when(_holds(message, words), name)
    return out.otherwise(OTHER_FAILURE)


def error_category(code: Column, status: Column, message: Column, kind: Column | None = None) -> Column:
    """One of nine categories, by code, HTTP status (100 to 599) and words of the message; `kind` is the name of the exception's class. Nulls say nothing."""
    code, message = F.lower(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    kind = F.lit("") if kind is None else F.coalesce(kind, F.lit(""))
    status = F.coalesce(F.when(status.between(100, 599), status), F.lit(0))
    has = lambda *words: _holds(message, words)
    return (
        F.when(code.isin("auth_error", "authentication_error") | status.isin(401, 403) | has("unauthorized"), "AUTH_ERROR")
        .when(code.isin("rate_limit", "rate_limit_error") | (status == 429) | has("rate limit"), "RATE_LIMIT")
        .when((code == "timeout") | (kind == "TimeoutError") | has("timed out", "timeout"), "TIMEOUT")
        .when(status.between(400, 499), "PROVIDER_4XX").when(status.between(500, 599), "PROVIDER_5XX")
        .when((code == "model_not_found") | (has("model") & has("not found", "does not exist")), "INVALID_PROVIDER_CONFIG")
        .when(has("json") | (kind == "JSONDecodeError"), "MALFORMED_PROVIDER_RESPONSE").when(has(*CONNECTION_WORDS), "CONNECTION_ERROR").otherwise("UNKNOWN_PROVIDER_ERROR")
    )


def sanitized(message: Column, secret: str | None = None) -> Column:
    """The message without the secret, bearer tokens and API keys."""
    out = F.replace(message, F.lit(secret), F.lit(HIDDEN)) if secret else message
    out = F.regexp_replace(out, r"(?i)(bearer\s+)[^\s,;]+", f"$1{HIDDEN}")
    return F.regexp_replace(out, r"(?i)(api[_ -]?key[=: ]+)[^\s,;]+", f"$1{HIDDEN}")


def validation_reason(warning: Column) -> Column:
    """What a warning of the answer's check stands for."""
    names = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return F.when(warning.isNotNull(), F.coalesce(F.element_at(names, warning), F.lit(OTHER_REASON)))


def trace(calls: DataFrame) -> DataFrame:
    """Calls (id, error, code, status, kind, content, parsed, warnings) with `stage`, where a call ended, and `outcome`: request (a category), parse, validate (the first warning's reason) or done."""
    failed = F.col("error").isNotNull()
    stage = F.when(failed, "request").when(~F.coalesce("parsed", F.lit(False)), "parse").when(F.coalesce(F.size("warnings"), F.lit(0)) > 0, "validate").otherwise("done")
    outcome = F.when(F.col("stage") == "request", error_category(F.col("code"), F.col("status"), F.col("error"), F.col("kind"))).when(F.col("stage") == "parse", F.when(F.coalesce("content", F.lit("")) == "", "EMPTY_RESPONSE").otherwise("INVALID_JSON"))
    outcome = outcome.when(F.col("stage") == "validate", validation_reason(F.get("warnings", F.lit(0)))).otherwise("VALID")
    return calls.withColumn("stage", stage).withColumn("outcome", outcome)


def inherited(final: DataFrame, parts: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """`final` whose empty fields (null, '' or an empty array) have the value of the first of its parts, in `order`, that has one; `inherited` names them. One aggregation of the parts, whatever their number."""

    def empty(c: Column, kind: str) -> Column:
        return c.isNull() | (F.size(c) == 0 if kind == "array" else c.cast("string") == "")

    kinds = {f: final.schema[f].dataType.typeName() for f in fields}
    first = parts.groupBy(key).agg(*(F.min_by(F.col(f), F.when(~empty(F.col(f), kinds[f]), F.col(order))).alias(f"__{f}") for f in fields))
    rows = final.join(first, key, "left")
    taken = {f: empty(F.col(f), kinds[f]) & F.coalesce(~empty(F.col(f"__{f}"), kinds[f]), F.lit(False)) for f in fields}
    names = F.array_compact(F.array(*(F.when(taken[f], F.lit(f)) for f in fields)))
    values = {f: F.when(taken[f], F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    rows = rows.withColumn("inherited", names).withColumns({f"__v_{f}": v for f, v in values.items()})
    return rows.select(*((F.col(f"__v_{c}").alias(c) if c in fields else F.col(c)) for c in final.columns), "inherited")
