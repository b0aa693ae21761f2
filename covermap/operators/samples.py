"""A few example values of every column.

Rows have no order in Spark, so the lowest distinct values stand for the first ones. They come from the same
shuffled values that the counts come from; only texts need a second scan, for the few that are shown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from covermap import fixed_values as fixed
from covermap.functions.values import (
    HEAD_CHARACTERS, as_text, comparable_text, from_key, is_collated, is_fixed_width, text_key)
from covermap.operators.bitmaps import Bitmaps, lowest_of_bitmaps
from covermap.operators.tally import Scan, distinct_values, is_set, scans, text_classes
from covermap.operators.unions import union_all
from covermap.sources.spec import Source


def _lowest_keys(values: DataFrame, count: int) -> DataFrame:
    """The lowest keys of each column; every task sends at most ``count`` per column to the one that ranks them."""
    place = Window.partitionBy("slot").orderBy("whole", "real", "words")
    # Told by ``copies``, which the shuffle yields, so that counts and samples read the same shuffle.
    there = values.where(F.when(is_set(), F.col("copies")) > 0)
    return there.withColumn("place", F.row_number().over(place)).where(F.col("place") <= count)


def _numbers(lowest: DataFrame, types: dict[int, T.DataType]) -> DataFrame:
    """(slot, value, order): the texts of numbers, dates and times, from their keys."""
    by_type: dict[str, tuple[T.DataType, list[int]]] = {}
    for slot, data_type in types.items():
        by_type.setdefault(data_type.simpleString(), (data_type, []))[1].append(slot)
    cases = " ".join(f"WHEN slot IN ({', '.join(map(str, slots))}) THEN {from_key('whole', 'real', data_type)}"
                     for data_type, slots in by_type.values())
    return lowest.select("slot", F.expr(f"CASE {cases} END").alias("value"), "place").where(F.col("value").isNotNull())


def _texts(scan: Scan) -> DataFrame:
    """One row (slot, value, same) per text of the scan: as it is shown and, where that differs, as it is compared."""
    table, columns = scan
    plain = "CAST(NULL AS STRING)"
    compared = {slot: comparable_text(f"c{slot}", data_type) for slot, data_type in columns}
    shown = {slot: as_text(f"c{slot}", data_type) for slot, data_type in columns}
    flat = ", ".join(f"{slot} AS s{slot}, {shown[slot]} AS c{slot}, {plain if compared[slot] == shown[slot] else compared[slot]} AS k{slot}"
                     for slot, _ in columns)
    rows = ", ".join(f"(s{slot}, c{slot}, k{slot})" for slot, _ in columns)
    return table.sparkSession.sql(
        f"SELECT slot, value, same FROM (SELECT {flat} FROM {{table}})"
        f" UNPIVOT INCLUDE NULLS ((slot, value, same) FOR name IN ({rows})) WHERE value IS NOT NULL", table=table)


def _text_parts(scan: Scan) -> list[DataFrame]:
    table, columns = scan
    plain = [column for column in columns if not is_collated(column[1])]
    collated = [text_classes(table, slot).where("value IS NOT NULL").selectExpr("slot", "value", "CAST(NULL AS STRING) AS same")
                for slot, data_type in columns if is_collated(data_type)]
    return ([_texts((table, plain))] if plain else []) + collated


def _lowest_texts(lowest: DataFrame, text_scans: Sequence[Scan], count: int) -> DataFrame:
    """(slot, value, place): the lowest texts, whole.

    Keys order texts by their first characters, so no text whose beginning lies above that of the last of the lowest
    keys can be among the lowest texts. A second scan compares the beginnings, and only texts up to there are
    digested, so that each distinct one travels once; a column with fewer distinct texts than wanted has no bound. The
    bounds are a short text per column.
    """
    bounds = lowest.where((F.col("place") == count) & F.col("words").isNotNull()).select(
        F.col("slot").alias("of"), F.substring("words", 1, HEAD_CHARACTERS).alias("bound"))
    texts = union_all([part for scan in text_scans for part in _text_parts(scan)])
    head = F.substring(F.coalesce("same", "value"), 1, HEAD_CHARACTERS)
    near = texts.join(F.broadcast(bounds), texts["slot"] == bounds["of"], "left").where(
        F.col("bound").isNull() | (head <= F.col("bound")))
    few = near.groupBy("slot", F.expr(text_key("coalesce(same, value)")).alias("words")).agg(F.min("value").alias("value"))
    place = Window.partitionBy("slot").orderBy("value")
    return few.select("slot", "value", F.row_number().over(place).alias("place")).where(F.col("place") <= count)


def samples_of(values: DataFrame, sources: Sequence[Source], count: int = fixed.SAMPLE_VALUES,
               bitmaps: Bitmaps | None = None) -> DataFrame:
    """(slot, sample_values) from ``distinct_values`` of the same sources, and the ``bitmaps`` of the columns they leave out."""
    lowest = _lowest_keys(values, count)
    if bitmaps is not None:
        lowest = lowest.drop("copies").unionByName(lowest_of_bitmaps(bitmaps, count))
    numbers, text_scans = {}, []
    for table, columns in scans(sources):
        numbers |= {slot: data_type for slot, data_type in columns if is_fixed_width(data_type)}
        texts = [column for column in columns if not is_fixed_width(column[1]) and not isinstance(column[1], T.NullType)]
        if texts:
            text_scans.append((table, texts))
    parts = [_numbers(lowest, numbers)] if numbers else []
    if text_scans:
        parts.append(_lowest_texts(lowest, text_scans, count))
    if not parts:
        parts = [lowest.select("slot", F.col("words").alias("value"), "place")]
    in_order = F.array_sort(F.collect_list(F.struct("place", "value")))
    return union_all(parts).groupBy("slot").agg(F.transform(in_order, lambda one: one["value"]).alias("sample_values"))


def lowest_values(sources: Sequence[Source], count: int = fixed.SAMPLE_VALUES) -> DataFrame:
    """(slot, sample_values): the ``count`` lowest distinct present values of each column, as text.

    Numbers, dates and times are ordered as their type is, all other values by their text.
    """
    return samples_of(distinct_values(sources), sources, count)
