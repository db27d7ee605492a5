"""Session defaults and the shared folder that long jobs cut their lineage in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` adds to them or replaces them."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all executors and the driver share.

    Where it is unset, a local session gets a fresh local folder; on a cluster a local folder would be
    invisible to other machines, so there the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpusgrid-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: later steps start from the files,
    so that a lost executor costs only the tasks that ran on it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its plan has fewer partitions than there are cores (a small table in few row groups); elsewhere as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
