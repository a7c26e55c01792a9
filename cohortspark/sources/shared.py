"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and kept tables: the cluster's own (spark.checkpoint.dir, or the one that is set).

    Only a session in one process (a local master, as in tests) may go without: it gets a new temporary folder. On a
    cluster a missing setting is an error, as no folder of one machine will do.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


class Kept(NamedTuple):
    """A table in the shared folder."""

    df: DataFrame
    path: str

    def remove(self) -> None:
        """Delete its files; nothing may read the table after."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> Kept:
    """The rows, written to the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Kept(spark.read.schema(df.schema).parquet(path), path)
