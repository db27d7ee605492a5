"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned on the normalised text: Spark samples the sort keys, picks splitters and sends
each range to one task, which sorts it externally. Equal texts are then neighbours, and the window over a
run of neighbours (full comparison of the whole text) keeps the smallest id. The sampled key is a bounded
prefix of the text and a 64-bit hash, so what the sampling gathers on the driver does not grow with the
length of the texts; the text itself is the last sort key and the only thing that decides equality.

Hot texts: a text with more copies than a quarter of a task's fair share of rows is spread over several
runs by a hash of the id. There are fewer than 4 x partitions such texts, by counting, so the list
of them and the totals of their runs are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import SPACE, partitions
from corpusgrid.session import materialise

PREFIX = 24


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with keep_id, group_size, kept and text_sha256 for every row.

    Null text counts as empty, and all empty texts are copies of one another. Rows with a null id sort last:
    they are kept only if no row of the group has an id, and keep_id is then null. Of repeated
    rows with the same id and text exactly one is kept. Input columns that carry one of the four names are replaced.
    """
    out = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*(c for c in docs.columns if c in out))
    norm = normalised(F.col(text_col))
    keyed = docs.withColumns({"__norm": norm, "__hash": F.xxhash64(norm)})
    share = max(64, docs.count() // (4 * partitions(docs)))
    hot = (
        keyed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__copies"))
        .where(F.col("__copies") > share)
        .select("__hash", F.ceil(F.col("__copies") / share).alias("__runs"))
    )
    hot = materialise(hot, "hot-texts")
    any_hot = not hot.isEmpty()
    if any_hot:
        keyed = keyed.join(F.broadcast(hot), "__hash", "left").withColumn(
            "__run", F.when(F.col("__runs").isNotNull(), F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col("__runs")))
        )
    keyed = keyed.withColumn("__prefix", F.substring("__norm", 1, PREFIX))
    # the window asks for rows of equal range keys together, which the ranges already give: no second exchange
    keys = ["__prefix", "__hash", *["__run"] * any_hot]
    placed = keyed.repartitionByRange(*keys)
    run = Window.partitionBy(*keys, "__norm").orderBy(F.col(id_col).asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.select(
        *docs.columns, F.sha2("__norm", 256).alias("text_sha256"),
        F.min(id_col).over(whole).alias("__min"), F.count(F.lit(1)).over(whole).alias("__count"), F.row_number().over(run).alias("__at"),
    )
    if any_hot:
        totals = (
            docs.withColumn("__norm", norm).withColumn("__hash", F.xxhash64("__norm"))
            .join(F.broadcast(hot), "__hash")
            .groupBy("__norm").agg(F.min(id_col).alias("__all_min"), F.count(F.lit(1)).alias("__all"))
            .select(F.sha2("__norm", 256).alias("text_sha256"), "__all_min", "__all")
        )
        placed = placed.join(F.broadcast(totals), "text_sha256", "left")
        keep, size = F.when(F.col("__all").isNull(), F.col("__min")).otherwise(F.col("__all_min")), F.coalesce("__all", "__count")
    else:
        keep, size = F.col("__min"), F.col("__count")
    return placed.select(
        *docs.columns, keep.alias("keep_id"), size.cast("long").alias("group_size"),
        ((F.col("__at") == 1) & F.col("__min").eqNullSafe(keep) & F.col(id_col).eqNullSafe(keep)).alias("kept"), "text_sha256",
    )


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents)
select doc_id, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
       row_number() over (partition by n order by doc_id) = 1 as kept, sha256(n) as text_sha256
from t
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
