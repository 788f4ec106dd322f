"""Shared scratch space for written tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder the session names for checkpoints.

    Only a local session may go without that setting; it gets a temporary folder. On a
    cluster a machine's own folder would not be seen by the other machines.
    """
    base = spark.conf.get(CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docmark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and read what it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    store, at = _file_system(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; a missing one is no error."""
    store, at = _file_system(spark, path)
    store.delete(at, True)
