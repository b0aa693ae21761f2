"""Row, null and distinct counts of every column, for many tables in one pass."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from covermap import fixed_values as fixed
from covermap.functions.values import (
    distinct_key, is_collated, is_fixed_width, is_floating, is_nested, null_if_nan, text_key)
from covermap.operators.unions import union_all
from covermap.sources.spec import Source
from covermap.sources.statistics import answers_from_statistics

SKETCH_LG_K = 12
#: Four standard errors of such a sketch: 1.04 / sqrt(4096) each.
SKETCH_ERROR = 0.065

_COUNTS = ["slot", "rows", "nulls", "distincts"]

Scan = tuple[DataFrame, list[tuple[int, T.DataType]]]


def scans(sources: Sequence[Source]) -> Iterator[Scan]:
    """Yield (table with columns ``c<slot>``, [(slot, type)]) for each table of the catalog.

    Columns are renamed by position, so dots, quotes and repeated names need no care.
    """
    first = 0
    for source in sources:
        types = [field.dataType for field in source.df.schema.fields]
        slots = list(zip(range(first, first + len(types)), types))
        first += len(types)
        if slots:
            yield source.df.toDF(*[f"c{slot}" for slot, _ in slots]), slots


def _keys(table: DataFrame, columns: list[tuple[int, T.DataType]]) -> DataFrame:
    """One row (slot, whole, real, words) per value. UNPIVOT runs as Spark's Expand, without arrays."""
    keyed = [(slot, *distinct_key(f"c{slot}", data_type)) for slot, data_type in columns]
    flat = ", ".join(f"{slot} AS s{slot}, {whole} AS w{slot}, {real} AS r{slot}, {words} AS t{slot}"
                     for slot, whole, real, words in keyed)
    rows = ", ".join(f"(s{slot}, w{slot}, r{slot}, t{slot})" for slot, _ in columns)
    return table.sparkSession.sql(
        f"SELECT slot, whole, real, words FROM (SELECT {flat} FROM {{table}})"
        f" UNPIVOT INCLUDE NULLS ((slot, whole, real, words) FOR name IN ({rows}))", table=table)


def is_set() -> Column:
    return F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("words").isNotNull()


def text_classes(table: DataFrame, slot: int) -> DataFrame:
    """(slot, value, copies) of a collated column: the lowest of each group of equal texts, by bytes, and their number."""
    plain = f"CAST(c{slot} AS STRING COLLATE UTF8_BINARY)"
    return table.groupBy(f"c{slot}").agg(F.expr(f"min({plain})").alias("value"), F.count(F.lit(1)).alias("copies")).select(
        F.lit(slot).alias("slot"), "value", "copies")


def distinct_values(sources: Sequence[Source], without: Collection[int] = ()) -> DataFrame:
    """(slot, whole, real, words, copies): each distinct value of each column once, with how often it occurs.

    ``without`` are slots that are counted in another way.

    All tables share one shuffle, on the value. Each task first folds its copies of a value into one counted
    row, so a value that fills a third of a table reaches the shuffle once per task, and the values of one column
    spread over all reducers. Nulls are one value of their column. Collated columns, where texts of different
    bytes can be equal, are grouped by themselves, each in a shuffle of its own.
    """
    every = [(table, [one for one in columns if one[0] not in without]) for table, columns in scans(sources)]
    plain = [(table, [one for one in columns if not is_collated(one[1])]) for table, columns in every]
    parts = [_keys(table, columns) for table, columns in plain if columns]
    values = [union_all(parts).groupBy("slot", "whole", "real", "words").agg(F.count(F.lit(1)).alias("copies"))] if parts else []
    nothing = "CAST(NULL AS BIGINT) AS whole", "CAST(NULL AS DOUBLE) AS real"
    values += [text_classes(table, slot).selectExpr("slot", *nothing, f"{text_key('value')} AS words", "copies")
               for table, columns in every for slot, data_type in columns if is_collated(data_type)]
    if not values:
        return sources[0].df.sparkSession.createDataFrame([], "slot int, whole bigint, real double, words string, copies bigint")
    return union_all(values)


def exact_tally(values: DataFrame) -> DataFrame:
    """(slot, rows, nulls, distincts), exact, from ``distinct_values``.

    Each reducer's share is folded to one row per column before it moves. A table without rows gives no row.
    """
    return values.groupBy("slot").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.when(is_set(), 0).otherwise(F.col("copies"))).alias("nulls"),
        F.count_if(is_set()).alias("distincts"),
    )


def _scan_tally(sources: Sequence[Source], distincts: Callable[[str, T.DataType], str]) -> DataFrame:
    """The counts of each table in one aggregation, of which every task sends a single row.

    Nulls are the rows less a plain count of the column, which a source can answer from its own statistics.
    """
    return union_all([_one_row(table, columns, distincts) for table, columns in scans(sources)])


def _one_row(table: DataFrame, columns: list[tuple[int, T.DataType]], distincts: Callable[[str, T.DataType], str]) -> DataFrame:
    counts = ", ".join(
        f"named_struct('slot', {slot}, 'rows', count(1),"
        f" 'nulls', count(1) - count({null_if_nan(f'c{slot}', data_type)}),"
        f" 'distincts', {distincts(f'c{slot}', data_type)})" for slot, data_type in columns)
    return table.selectExpr(f"array({counts}) AS counts").selectExpr("inline(counts)")


def approx_tally(sources: Sequence[Source]) -> DataFrame:
    """As ``exact_tally`` with estimated distinct counts, from sketches of a few KB per column."""
    def sketch(value: str, data_type: T.DataType) -> str:
        whole, real, words = distinct_key(value, data_type)
        # A sketch takes whole numbers and texts; the hash of one double never meets another's.
        key = words if not is_fixed_width(data_type) else f"xxhash64({real})" if "NULL AS BIGINT" in whole else whole
        if key.startswith("xxhash64"):
            key = f"IF({real} IS NULL, NULL, {key})"
        return f"hll_sketch_estimate(hll_sketch_agg({key}, {SKETCH_LG_K}))"

    return _scan_tally(sources, sketch)


def _doubtful(rows: int, nulls: int, distincts: int) -> bool:
    """Whether the flag of nearly unique values could be another one for a count within the estimate's error."""
    low, high = distincts * (1 - SKETCH_ERROR), min(distincts * (1 + SKETCH_ERROR), rows - nulls)
    if not rows or high / rows <= fixed.ID_CARDINALITY or high <= fixed.ID_DISTINCT:
        return False
    return low / rows <= fixed.ID_CARDINALITY or low <= fixed.ID_DISTINCT


def checked_tally(sources: Sequence[Source]) -> DataFrame:
    """As ``approx_tally``, with exact counts where the estimate's error could flip a column's flag.

    The estimates, a row for each column, are made now and reach the driver, which then knows the columns to be
    counted again: only those are read, and shuffled. Columns whose name says enough need no count.
    """
    names = [field.name for source in sources for field in source.df.schema.fields]
    estimates = [tuple(row) for row in approx_tally(sources).select(*_COUNTS).collect()]
    again = {slot for slot, *counts in estimates if not re.search(fixed.ID_NAME, names[slot], re.IGNORECASE) and _doubtful(*counts)}
    counts = list(zip(*[row for row in estimates if row[0] not in again])) or [()] * 4
    sure = sources[0].df.sparkSession.createDataFrame(
        pa.table([pa.array(column, pa.int32() if not place else pa.int64()) for place, column in enumerate(counts)], names=_COUNTS))
    if not again:
        return sure
    exact = exact_tally(distinct_values(sources, set(range(len(names))) - again))
    return sure.unionByName(exact.select(*_COUNTS))


def null_tally(sources: Sequence[Source]) -> DataFrame:
    """As ``exact_tally`` without distinct counts: what concepts and scores need, at a scan's cost.

    In a ``statistics_session``, plain counts are asked for apart from those of floating and nested columns, which a file's
    statistics cannot answer (NaN counts as null): so Parquet answers them from its footers, and reads the other columns alone.
    """
    def none(value: str, data_type: T.DataType) -> str:
        return "CAST(NULL AS BIGINT)"

    if not answers_from_statistics(sources[0].df.sparkSession):
        return _scan_tally(sources, none)
    stored = [name not in source.computed for source in sources for name in source.df.columns]
    parts = []
    for table, columns in scans(sources):
        plain = [(slot, data_type) for slot, data_type in columns if stored[slot] and not (is_floating(data_type) or is_nested(data_type))]
        for own in (plain, [column for column in columns if column not in plain]):
            if own:
                parts.append(_one_row(table, own, none))
    return union_all(parts)
