"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before it, and returns the columns of documents; the last
returns the packed pieces. No stage looks at a subset of rows.

Null texts count as empty (the quality rules drop them), null sources form a source of their own, and a null id is linked with nothing. Repeated rows are copies: exact dedup keeps one of them.
Rows that share an id but not the text are rows of their own. Columns besides doc_id, text and source keep their values, whatever their names, but for names that
begin with two underscores. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm.exact_dedup import exact_dedup
from corpusgrid.llm.mixing import mix
from corpusgrid.llm.near_dedup import near_dedup
from corpusgrid.llm.packing import digest, pack
from corpusgrid.llm.quality import quality_rules
from corpusgrid.session import materialise


NEEDED = ("doc_id", "text", "source")


def hidden(docs: DataFrame) -> DataFrame:
    """`docs` with the columns that no stage needs in one struct, so that none of them meets a column of an operator."""
    return docs.select(*NEEDED, F.struct(F.lit(0).alias("__none"), *(c for c in docs.columns if c not in NEEDED)).alias("rest_of_row"))


def shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, with their own values."""
    return rows.select(*(c if c in NEEDED else F.col("rest_of_row")[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return shown(quality_rules(hidden(docs), labels).where("kept"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the smallest id."""
    return shown(exact_dedup(hidden(docs)).where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the smallest id. Rows go by id and text, so that of rows that share an id only the near copies go."""
    dropped = near_dedup(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__digest")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__digest"))
    return docs.join(dropped, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the schedule interleaves their sources."""
    return shown(mix(hidden(docs)).orderBy("mix_slot", "mix_row"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, packed in blocks that follow the mixed order.

    Files are dealt to tasks by size, not in their order. As the mixing stage keeps every row, its slots come out the same for its result, and
    rows are brought back into their order by them.
    """
    return digest(pack(mix(docs), public_tokenizers.path("byte_bpe_50k.json"), order=("mix_slot", "mix_row")))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]
ORACLE_SQL = None  # hashed n-grams, MinHash, scheduling and tokenizing are not SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
