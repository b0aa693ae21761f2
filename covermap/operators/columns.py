"""A catalog's columns as rows. Everything here comes from schemas; no row is read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from covermap.functions import patterns
from covermap.sources.spec import Source

_LISTING = pa.schema([
    ("slot", pa.int32()), ("source_name", pa.string()), ("source_type", pa.string()),
    ("table_name", pa.string()), ("column", pa.string()), ("dtype", pa.string()),
    ("datetime_type", pa.bool_()),
])


def list_columns(sources: Sequence[Source]) -> DataFrame:
    """One row per (source, column) with its type and the flags that need only name and type.

    ``slot`` numbers the columns of the whole catalog, in source order. The rows are a local
    relation of known size, so Spark itself broadcasts them while they are small.
    """
    rows = [
        {"source_name": source.name, "source_type": source.source_type, "table_name": source.table_name,
         "column": field.name, "dtype": field.dataType.simpleString(),
         "datetime_type": patterns.is_datetime_type(field.dataType)}
        for source in sources for field in source.df.schema.fields
    ]
    table = pa.Table.from_pylist([{"slot": slot, **row} for slot, row in enumerate(rows)], schema=_LISTING)
    listing = sources[0].df.sparkSession.createDataFrame(table)
    return listing.withColumns({
        "is_probable_datetime": patterns.probable_datetime(F.col("column"), F.col("datetime_type")),
        "is_probable_pii": patterns.probable_pii(F.col("column")),
    }).drop("datetime_type")


def only_columns(sources: Sequence[Source], wanted: Callable[[T.StructField], bool]) -> list[Source]:
    """The sources cut down to the wanted columns, so that scans read no others."""
    kept = []
    for source in sources:
        quoted = ["`" + f.name.replace("`", "``") + "`" for f in source.df.schema.fields if wanted(f)]
        if quoted:
            kept.append(replace(source, df=source.df.select(*quoted)))
    return kept
