"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session within one machine, as in tests, gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, *apart: str) -> DataFrame:
    """df, written once to the shared folder and read back; survives lost executors. Rows that differ in the columns ``apart`` go to folders of their own."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sightline/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*apart).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a small input, by the optimizer's estimate.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input of few partitions dealt out to all cores, before work that is heavy for each row.

    A small file of one row group is otherwise read, and worked on, by one
    task. Larger inputs stay as they are: they have partitions enough, and
    their rows are not shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
