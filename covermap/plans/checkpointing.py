"""Keeping a result that several later steps read, so that its scans run once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder for kept results that all executors share: the session's setting, or its checkpoint directory."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write the result to the shared folder and read it from there.

    Later steps, and tasks that replace lost executors, read files instead of scanning the
    sources again, and being Parquet they read only the columns they need. Columns are written
    under positional names, so any names can be kept, repeated ones too.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    positional.write.parquet(path)
    return df.sparkSession.read.schema(positional.schema).parquet(path).toDF(*df.columns)


def drop_kept(spark: SparkSession) -> int:
    """Delete all kept results in the shared folder; how many there were. Nothing may still read them."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/kept-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(pattern) or []
    return sum(files.delete(one.getPath(), True) for one in found)
