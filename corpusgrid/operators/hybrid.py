"""Hybrid search: routed lexical search and vectors, fused by rank, with a mode and a status for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.operators import search, vector
from corpusgrid.session import materialise

MOST = 100


def readiness(queries: DataFrame, dimension: int, state: str | None) -> DataFrame:
    """Queries (qid, text, mode, vector) with semantic_status: disabled where the mode is not hybrid; else unavailable without an index, not_indexed if the index is empty or has no
    vectors, error if the query's own vector cannot be used, and available. `state`: that of the vector index (READY, PARTIAL, NOT_READY, EMPTY), None if there is none."""
    wants = F.coalesce(F.lower(F.trim("mode")), F.lit("lexical")) == "hybrid"
    status = F.when(~wants, "disabled")
    if state not in ("READY", "PARTIAL"):
        status = status.otherwise("unavailable" if state is None else "not_indexed")
    else:
        status = status.when(~F.coalesce(vector.valid(F.col("vector"), dimension), F.lit(False)), "error").otherwise("available")
    return queries.withColumn("semantic_status", status)


def hybrid_search(rows: DataFrame, queries: DataFrame, vectors: DataFrame | None, state: str | None, limit: int = 10, dimension: int = 64, k: int = 60, sources: list[str] | None = None, sections: list[str] | None = None, references: bool = False) -> DataFrame:
    """qid, passage_id, rank, fused_score, lexical_rank, lexical_score, semantic_rank, semantic_score, sources, mode, semantic_status, warning: the best `limit` passages of each query.

    `rows`: passages as of `search`; `queries`: qid, text, mode, vector; `vectors`: passage_id, vector. Both lists give up to min(3 x limit, 100) candidates within the filters; only
    passages within the filters are allowed. A query whose semantic side is not available gets the lexical list, says so in `mode`, and has a warning unless it asked for
    nothing else. Blank queries find nothing lexically.
    """
    limit = max(1, limit)
    fetch = min(3 * limit, MOST)
    asked = materialise(readiness(queries.select("qid", "text", "mode", "vector"), dimension, state if vectors is not None else None), "hybrid-queries")
    found = search.search(rows, asked.select("qid", "text"), fetch, sources, sections, references).select("qid", "passage_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    ready = asked.where("semantic_status = 'available'").select(F.col("qid").alias("id"), F.col("vector").alias("embedding"))
    if vectors is not None and not ready.isEmpty():
        allowed = search.passages(rows, sources, sections, references).select("passage_id")
        pool = vectors.join(allowed, "passage_id", "left_semi").select(F.col("passage_id").alias("id"), F.col("vector").alias("embedding"))
        near = vector.cosine_topk(pool, ready, fetch, "id").select("qid", F.col("vec_id").alias("passage_id"), F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    else:
        near = found.limit(0).select("qid", "passage_id", F.col("lexical_rank").alias("semantic_rank"), F.col("lexical_score").alias("semantic_score"))
    both = found.join(near, ["qid", "passage_id"], "full").join(asked.select("qid", "mode", "semantic_status"), "qid")
    gain = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    available = F.col("semantic_status") == "available"
    both = both.withColumn("fused_score", F.when(available, F.round(gain("lexical_rank") + gain("semantic_rank"), 9)))
    far = F.lit(1 << 40)
    one, two = (F.coalesce(c, far) for c in ("lexical_rank", "semantic_rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("fused_score"), F.least(one, two), one, two, "passage_id")
    names = F.concat_ws(",", F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("semantic_rank").isNotNull(), "semantic"))
    reasons = {"unavailable": "semantic search is unavailable", "not_indexed": "no passage has a vector", "error": "the query has no usable vector"}
    warning = F.lit("")
    for status, reason in reasons.items():
        warning = F.when(F.col("semantic_status") == status, f"{reason}: lexical results only").otherwise(warning)
    out = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return out.select("qid", "passage_id", "rank", "fused_score", "lexical_rank", "lexical_score", "semantic_rank", "semantic_score", names.alias("sources"), F.when(available, "hybrid").otherwise("lexical").alias("mode"), "semantic_status", warning.alias("warning"))
