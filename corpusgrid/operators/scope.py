"""The scope of a search: only the passages of the caller's own batch, never another's.

Passages are kept in files partitioned by batch, with one row for each batch in a table of their own. A search names its batches; the join with them prunes the partitions, and a batch that is
missing, or is no longer what the caller has seen, gives a state instead of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.operators.inverted import BROADCAST_ROWS
from corpusgrid.sources.snapshots import Snapshots


def batches(passages: DataFrame) -> DataFrame:
    """batch_id, n_sources, n_passages, digest (of its passages' ids and texts, in any order)."""
    row = F.xxhash64("passage_id", "source_file", "text").cast("decimal(38,0)")
    return passages.groupBy("batch_id").agg(F.count_distinct("source_file").alias("n_sources"), F.count(F.lit(1)).alias("n_passages"), F.sum(row).cast("string").alias("digest"))


class ScopedStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, Snapshots(spark, folder)

    def put(self, passages: DataFrame) -> int:
        """Writes whole batches (batch_id, passage_id, source_file, section, text), in place of those of the same id; returns the version. Rows without a batch are left out."""
        version = self.store.current()
        rows = passages.where("batch_id is not null")
        new = self.store.write(rows.repartition("batch_id", F.pmod(F.xxhash64("passage_id"), F.lit(8))), "passages", "batch_id")
        info = self.spark.read.parquet(new)
        told = batches(info).withColumn("folder", F.lit(new))
        old = self.store.read(version, "batches")
        if old is not None:
            told = told.unionByName(old.join(told.select("batch_id"), "batch_id", "left_anti"))
        return self.store.commit(version, {"passages": [*version.tables.get("passages", []), new], "batches": [self.store.write(told, "batches")]}).number

    def states(self, contexts: DataFrame) -> DataFrame:
        """Contexts (context_id, batch_id, digest) with state: missing without such a batch, stale if the batch has changed since, else present."""
        known = self.store.read(self.store.current(), "batches")
        if known is None:
            return contexts.withColumns({"state": F.lit("missing"), "folder": F.lit(None).cast("string")})
        known = known.select("batch_id", F.col("digest").alias("__digest"), "folder")
        state = F.when(F.col("__digest").isNull(), "missing").when(~F.col("digest").eqNullSafe(F.col("__digest")), "stale").otherwise("present")
        return contexts.join(known, "batch_id", "left").withColumn("state", state).drop("__digest")

    def passages(self, contexts: DataFrame) -> DataFrame:
        """context_id, batch_id, passage_id, source_file, section, text of the contexts that are present. The contexts' batches prune the partitions that are read."""
        version = self.store.current()
        here = self.states(contexts).where("state = 'present'").select("context_id", "batch_id", "folder")
        few = here.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        out = None
        for folder in version.tables.get("passages", []):  # a batch is read from the folder that has its last version
            mine = here.where(F.col("folder") == folder).drop("folder")
            rows = self.spark.read.parquet(folder).join(F.broadcast(mine) if few else mine, "batch_id")
            rows = rows.select("context_id", F.col("batch_id").cast("string").alias("batch_id"), "passage_id", "source_file", "section", "text")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "context_id long, batch_id string, passage_id string, source_file string, section string, text string")
