"""Ranges of equal depth, in which a table is read in parallel however unevenly its keys lie."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal
from math import isfinite

from pyspark.sql import DataFrame, functions as F, types as T

#: A quantile is off by the rows over this at most.
ACCURACY = 10_000


def _literal(value: object) -> str:
    """A bound as SQL that all systems read."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)) or not isfinite(value):
        raise ValueError(f"no bound can be {value!r}")
    return str(value)


def equi_depth_bounds(rows: DataFrame, column: str, parts: int, accuracy: int = ACCURACY) -> list:
    """At most ``parts`` - 1 different values that divide the rows into ranges of about equal depth, lowest first.

    ``rows`` may be a sample of the table, such as a query that reads one column of some of its rows. Numbers, dates and times are
    divided by estimated quantiles, texts by Spark's sampled ranges, which shuffles them once. A very common value is one bound.
    Only bounds reach the driver. Nulls and NaN do not count; without rows there are no bounds.
    """
    if parts < 2:
        return []
    name = "`" + column.replace("`", "``") + "`"
    kind = rows.select(name).schema[0].dataType
    present = rows.select(F.col(name).alias("key")).where("key IS NOT NULL")
    shares = [part / parts for part in range(1, parts)]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        present = present.where(~F.isnan("key"))
    if isinstance(kind, T.StringType):
        # Texts have no quantile function; Spark's range partitioning samples them, and its partitions begin at the bounds.
        ranges = present.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
        return sorted(row.key for row in ranges.collect())[1:]
    quantiles = present.agg(F.percentile_approx("key", shares, accuracy).alias("bounds"))
    bounds = quantiles.select(F.explode(F.array_distinct("bounds")).alias("key"))
    return sorted(row.key for row in bounds.collect())


def range_predicates(column: str, bounds: Sequence) -> tuple[str, ...]:
    """Conditions that divide all rows at the bounds: each row meets exactly one. Nulls go with the lowest range.

    ``column`` is as the system's own SQL writes it, with its quotes if it needs any.
    """
    if not bounds:
        return ()
    edges = [_literal(bound) for bound in bounds]
    first = f"({column} < {edges[0]} OR {column} IS NULL)"
    between = [f"({column} >= {low} AND {column} < {high})" for low, high in zip(edges, edges[1:])]
    return (first, *between, f"({column} >= {edges[-1]})")
