"""Stage boundaries: a result that several later steps read is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a session on one machine may go without: it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def safe_unions(spark: SparkSession) -> None:
    """Plan unions without taking over the partitioning of their branches.

    Spark 4.1 may treat a union of equally partitioned branches as partitioned by the same key and leave out the
    exchange before a window or join, which then sees the rows of a key in parts. This is the one place that turns it off.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a stage result as a table in the shared folder and read it back.

    Later steps start from files that survive the loss of executors, prune columns, and do
    not repeat the work that led to them.
    """
    path = f"{stage_root(df.sparkSession)}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
