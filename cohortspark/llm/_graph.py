"""Tables kept in the shared folder, and connected components over them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.shared import Kept, kept


#: Rows of a record batch that goes to Python while tables are kept: texts are long, and the batch is there on both sides.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller record batches for the actions inside; the session's setting stands again after."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before))) if int(before) > 0 else str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def keep(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there and survives lost executors."""
    return _kept(df).df


def keep_in_few(df: DataFrame) -> DataFrame:
    """The same in few files, for tables of which there are many: see ``files``."""
    return _few(df).df


def files(spark: SparkSession) -> int:
    """Files that a table is kept in at most: two for each core, or one for every 16 partitions of a shuffle where that is more.

    A task then takes its partitions one after the other, so none holds more at once. Every file of a local folder costs Hadoop
    several processes started beside the executor; with hundreds of nearly empty files in each of dozens of tables these add up.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)


def _kept(df: DataFrame, few: bool = False) -> Kept:
    with small_batches(df.sparkSession):
        return kept(df.coalesce(files(df.sparkSession)) if few else df)


def _few(df: DataFrame) -> Kept:
    return _kept(df, few=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): the label is the least node that can be reached.

    Labels fall to the least one among the neighbours and then to that one's own label, until none changes. Each round
    is joins and a minimum per node; a node with very many edges only adds rows to partial minima. The tables of the rounds
    are removed, the result's stays.
    """
    both = _few(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    table = _few(both.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        label = table.df.select("node", "label")
        near = both.df.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = label.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = _few(low.join(jump, "low").select("node", F.least("low", "next").alias("label"), "old"))
        table.remove()
        table = new
        if new.df.where("label <> old").isEmpty():
            both.remove()
            return new.df.select("node", "label")
