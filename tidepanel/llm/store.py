"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, on one machine only.

    Other executors would not see a machine's own folder, so on a cluster the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidepanel-"))
    return named or sc.getCheckpointDir()


def free(name: str, names: list[str]) -> str:
    """``name``, with underscores before it until it is none of ``names``, whatever their case."""
    taken = {x.lower() for x in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Texts go to Python workers by batches of about ``size``, so that a few long ones don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def gathered(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need at ``each`` a partition: many small files and tasks cost more than they hold."""
    return df.coalesce(max(1, -(-rows // each)))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """As :func:`cut`, but as compressed Parquet, for wide tables that are read column by column."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tidepanel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes what :func:`saved` wrote, once nothing that is still to be computed reads it."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
