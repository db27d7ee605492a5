"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

LEAST_SHARE = 256  # rows of a key that are never worth dealing over several tasks


def words(text: Column) -> Column:
    """The maximal runs of characters that are not white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, jobs send Python at most `rows` rows at once: texts and sets of many rows are then neither in the JVM's buffers nor in a worker at the same time. The session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`batches`; at their end Arrow's freed memory goes back to the system. Python workers outlive their tasks, and would hold it beside the JVM's in later stages."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """`many` joined with `one`, which has one row for each key; keys must not be null.

    A key with more than a quarter of a task's fair share of the rows of `many` is dealt over several runs, and its row of
    `one` is repeated for each. There are fewer than 4 x partitions such keys, by counting, so their list goes through the driver and is broadcast. `many` is
    read more than once: it should be a table, or `counted` one that has its rows' keys.
    """
    table = many if counted is None else counted
    bound = 4 * partitions(many)
    counts = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > LEAST_SHARE)
    top = counts.orderBy(F.desc("__rows")).limit(bound).collect()
    share = max(LEAST_SHARE, table.count() // bound) if top else 0
    hot = [(*r[:-1], -(-r[-1] // share)) for r in top if r[-1] > share]
    if not hot:
        return many.join(one, keys, how)
    hot = many.sparkSession.createDataFrame(hot, StructType([*(many.schema[k] for k in keys), StructField("__runs", IntegerType())]))
    rest = [c for c in many.columns if c not in keys]
    many = many.join(F.broadcast(hot), keys, "left").withColumn("__run", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("__runs")), F.lit(0)).cast("int")).drop("__runs")
    one = one.join(F.broadcast(hot), keys, "left").withColumn("__run", F.explode(F.sequence(F.lit(0), F.coalesce("__runs", F.lit(1)) - 1))).drop("__runs")
    return many.join(one, [*keys, "__run"], how).drop("__run")
