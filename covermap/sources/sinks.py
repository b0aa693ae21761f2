"""Saving results where others read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: The mode that replaces the partitions it has rows for, and leaves all others as they are.
REPLACE = "replace"


def save(df: DataFrame, path: str | None = None, table: str | None = None, format: str = "parquet",
         mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write a result to a path, or as a table of the session's catalog.

    ``mode="replace"`` with ``partition_by`` can be run again: partitions that the result has rows for, such as those of a run or
    a scope, are replaced as a whole, each when all of it is written; all others are not touched. A first run makes the target.
    """
    if (path is None) == (table is None):
        raise ValueError("give either path or table")
    if mode == REPLACE and not partition_by:
        raise ValueError("replacing needs partition_by: it says what is replaced")
    if mode == REPLACE and table is not None and df.sparkSession.catalog.tableExists(table):
        # By position, as the table has its columns.
        names = df.sparkSession.table(table).columns
        rows = df.select(*["`" + name.replace("`", "``") + "`" for name in names])
        rows.write.option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=True)
        return
    writer = df.write.format(format).mode("overwrite" if mode == REPLACE and path is not None else "errorifexists" if mode == REPLACE else mode)
    if mode == REPLACE:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer.save(path)
    else:
        writer.saveAsTable(table)
