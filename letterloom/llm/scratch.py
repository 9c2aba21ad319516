"""Shared scratch tables: results that several jobs read are written once and reread.

The folder is the one that the cluster names in ``spark.checkpoint.dir``; only where that is unset and Spark is local
(tests, notebooks) is a folder made and registered.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import new_folder, shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors see."""
    return shared_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return new_folder(spark, name)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers by a few megabytes, so that long texts need little memory on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there, and a lost executor
    costs a reread, not a recomputation."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it only reads files, whose rows come alike each time; else ``df`` written once, as rows that a shuffle
    or sample deals out, or that Python makes, need not be the same when a lost task is run again."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    moved = re.search(r"Exchange|Sample|Limit|MapIn|Python|Pandas|RDD|Generate|rand|uuid|monotonically|spark_partition", plan)
    return written(df, name) if moved else df


def drop(df: DataFrame) -> None:
    """Delete a table of ``written`` that no pending result reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
