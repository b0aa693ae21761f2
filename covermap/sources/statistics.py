"""Answers from a file's own statistics."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PUSHED = "spark.sql.parquet.aggregatePushdown"
_READERS = "spark.sql.sources.useV1SourceList"


def statistics_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, with the same settings, in which Parquet answers plain counts from its footers.

    Tables must be read in it, and results computed in it. The given session stays as it is.
    """
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and session.conf.isModifiable(name):
            session.conf.set(name, value)
    v1 = [name for name in session.conf.get(_READERS).split(",") if name and name != "parquet"]
    session.conf.set(_READERS, ",".join(v1))
    session.conf.set(_PUSHED, "true")
    return session


def answers_from_statistics(spark: SparkSession) -> bool:
    return spark.conf.get(_PUSHED, "false").lower() == "true"
