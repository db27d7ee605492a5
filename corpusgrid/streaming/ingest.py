"""Continuous ingest: new files or rows reach the result table once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def first_seen(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, time: str, width: str, delay: str | None, *keys: str) -> DataFrame:
    """Counts per tumbling window and keys; rows later than the watermark are left out. No delay: the rows have a watermark already."""
    if delay is not None:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counts = rows.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n")


def follow(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Process each new file's rows that the target lacks and append them; the checkpoint resumes after a stop.

    A batch that is replayed after a failure finds its keys in the target and adds nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        rows = rows.dropDuplicates([key])
        try:
            done = session.read.parquet(target).select(key)
        except Exception as e:  # the first batch: no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            rows = rows.join(done, key, "left_anti")
        process(rows).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
