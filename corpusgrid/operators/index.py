"""An incremental vector index: what is cached and still valid, what is missing, and the table after a build."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.session import materialise


def fingerprint(**settings) -> str:
    """The name of an encoder: a digest of its settings (versions, dimension, prefixes, file sizes), in any order."""
    return "enc_" + hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:32]


def usable(vector: Column, dimension: int) -> Column:
    """True for a vector of this dimension whose values are all finite and not all zero; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lookup(passages: DataFrame, cache: DataFrame, encoder: str, dimension: int) -> DataFrame:
    """passage_id, text, text_hash, cached: whether the cache holds a valid vector of this very text under this encoder.

    A null text counts as empty. A passage that the cache holds twice counts as cached if one of the two is valid.
    """
    rows = passages.select("passage_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.sha2("text", 256))
    valid = cache.where((F.col("encoder") == encoder) & (F.col("dimension") == dimension) & usable(F.col("vector"), dimension))
    valid = valid.select("passage_id", "text_hash").distinct().withColumn("cached", F.lit(True))
    return rows.join(valid, ["passage_id", "text_hash"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with these rows in place of those of the same passage and encoder."""
    return cache.join(rows.select("passage_id", "encoder").distinct(), ["passage_id", "encoder"], "left_anti").unionByName(rows)


def build(passages: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame], encoder: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(the cache after the build, one row of total, cached, encoded and failed).

    `encode` takes the missing rows (passage_id, text) and gives (passage_id, vector), by mapInPandas for instance; what it leaves out or
    gives as an unusable vector has failed, and its old row stays. There is no cap on the number of passages.
    """
    seen = materialise(lookup(passages, cache, encoder, dimension), "index-lookup")
    todo = seen.where(~F.col("cached"))
    made = encode(todo.select("passage_id", "text")).where(usable(F.col("vector"), dimension)).select("passage_id", F.col("vector").cast("array<float>").alias("vector"))
    made = materialise(made.join(todo.select("passage_id", "text_hash"), "passage_id").dropDuplicates(["passage_id"]), "index-encoded")
    fresh = made.select("passage_id", F.lit(encoder).alias("encoder"), "text_hash", F.lit(dimension).alias("dimension"), "vector")
    done = seen.join(made.select("passage_id", F.lit(True).alias("encoded")), "passage_id", "left")
    new = ~F.col("cached") & F.coalesce("encoded", F.lit(False))
    stats = done.agg(F.count(F.lit(1)).alias("total"), F.count_if("cached").alias("cached"), F.count_if(new).alias("encoded"), F.count_if(~F.col("cached") & ~new).alias("failed"))
    return upsert(cache, fresh), stats


def state(stats: DataFrame) -> DataFrame:
    """The row of a build with `state`: EMPTY without passages, READY if none failed, NOT_READY if there is no vector at all, else PARTIAL."""
    ready = F.col("cached") + F.col("encoded")
    return stats.withColumn("state", F.when(F.col("total") == 0, "EMPTY").when(F.col("failed") == 0, "READY").when(ready == 0, "NOT_READY").otherwise("PARTIAL"))


def without_source(rows: DataFrame, source: str) -> DataFrame:
    """The rows of all other sources; those without a source stay."""
    return rows.where(~F.col("source_file").eqNullSafe(source))


def cleared(rows: DataFrame, confirm: bool = False) -> DataFrame:
    """No rows, in the same columns; an error unless confirmed."""
    if not confirm:
        raise ValueError("clearing an index needs confirm=True")
    return rows.limit(0)
