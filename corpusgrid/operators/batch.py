"""Identity of inputs, incremental batches, request plans, report layout and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.operators import ranks


def identified(inputs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Inputs with content_sha256, document_id, duplicate_of (the first input of equal content) and is_duplicate.

    The first input of a group comes from a map-side minimum, not from a window over the group, so that a content that most inputs share is no hot key.
    """
    rows = inputs.withColumn("content_sha256", F.sha2(F.col(content_col).cast("binary"), 256))
    named = F.when(F.col("content_sha256").isNotNull(), F.concat(F.lit("doc_"), F.col("content_sha256"))).otherwise(F.concat(F.lit("doc_unreadable_"), F.col(id_col)))
    rows = rows.withColumn("document_id", named)
    first = rows.groupBy("document_id").agg(F.min(id_col).alias("first_input"), F.count(F.lit(1)).alias("n_inputs"))
    rows = rows.join(first, "document_id")
    return rows.withColumn("duplicate_of", F.when(F.col(id_col) != F.col("first_input"), F.col("first_input")))


def counts(inputs: DataFrame) -> DataFrame:
    return inputs.agg(F.count(F.lit(1)).alias("inputs"), F.count_distinct("document_id").alias("documents"), F.count("duplicate_of").alias("duplicates"))


def statuses(inputs: DataFrame, documents: DataFrame) -> DataFrame:
    """Inputs with `status`: duplicate if they have a duplicate_of, else that of their document (document_id unique), pending without one."""
    known = documents.select("document_id", F.col("status").alias("__status"))
    status = F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.coalesce("__status", F.lit("pending")))
    return inputs.join(known, "document_id", "left").withColumn("status", status).drop("__status")


def outcome(inputs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: the six counts of a batch (of inputs and documents with `status`) and its status, completed_with_errors if a document failed."""
    of = lambda s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False)))
    one = inputs.agg(F.count(F.lit(1)).alias("inputs"), of("duplicate").alias("duplicates"), of("skipped").alias("skipped"))
    two = documents.agg(F.count(F.lit(1)).alias("documents"), of("completed").alias("completed"), of("failed").alias("failed"))
    return one.join(F.broadcast(two)).withColumn("status", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))


def aliases(inputs: DataFrame, name: Column, order: str) -> DataFrame:
    """Inputs with `alias`: the name, from its second occurrence on with its number. A name may stand for any share of the inputs."""
    rows = ranks.ranked(inputs.withColumn("__name", name), ["__name"], [order], "__n")
    return rows.withColumn("alias", F.when(F.col("__n") > 1, F.concat("__name", F.lit(" #"), "__n")).otherwise(F.col("__name"))).drop("__n", "__name")


def pending(documents: DataFrame, results: DataFrame, pause_after: int | None = None) -> DataFrame:
    """Documents without a completed or failed result, in order; at most `pause_after`."""
    done = results.where(F.col("status").isin("completed", "failed")).select("document_id")
    rest = documents.join(done, "document_id", "left_anti")
    return rest if pause_after is None else rest.orderBy("position").limit(pause_after)


def upsert(target: DataFrame, rows: DataFrame, source: str, required: list[str]) -> DataFrame:
    """The target without any row of an incoming source, plus the incoming rows whose required fields are all there."""
    whole = rows
    for c in required:
        whole = whole.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return target.join(rows.select(source).distinct(), source, "left_anti").unionByName(whole)


def changed_sources(pages: DataFrame, digests: DataFrame) -> DataFrame:
    """source_file, digest of sources whose joined page texts differ from what is indexed."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n")
    return pages.groupBy("source_file").agg(F.sha2(text, 256).alias("digest")).join(digests, ["source_file", "digest"], "left_anti")


def request_plan(papers: DataFrame, retries: int = 2, repairs: int = 1, chunk_tokens: int = 2000, reduce_tokens: int = 4000) -> DataFrame:
    """Papers (with n_chunks) with base requests, output tokens and worst-case requests."""
    base = F.col("n_chunks") + 1
    return papers.withColumns({"base_requests": base, "max_output_tokens": F.col("n_chunks") * chunk_tokens + reduce_tokens, "worst_requests": base * (retries + 1) * (1 + repairs)})


def layout(n: Column) -> Column:
    """Report layout for a number of papers, chosen automatically."""
    return F.when(n <= 1, "single").when(n <= 3, "matrix").otherwise("vertical")


def selection(papers: DataFrame, most: int = 10, by: list[str] | None = None) -> DataFrame:
    """Papers (metadata, verified, sections, flags, failed) with score and selection_rank (null if not chosen), per `by` group."""
    score = F.col("metadata") * 10 + F.least("verified", F.lit(20)) * 2 + F.least("sections", F.lit(8)) - F.col("flags") * 2
    keys = [*(by or []), "failed"]
    rows = ranks.ranked(papers.withColumn("score", score), keys, [F.desc("score"), "document_id"], "__rank")
    return rows.withColumn("selection_rank", F.when(~F.col("failed") & (F.col("__rank") <= most), F.col("__rank"))).drop("__rank")
