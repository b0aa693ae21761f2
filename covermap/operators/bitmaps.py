"""Exact distinct counts of dense whole numbers and dates: a bit per value instead of a row.

A column whose values lie close together, such as a code, a day or a key of a small table, needs one bitmap of 4 KB for each
32,768 values of its range. Tasks send bitmaps, which the shuffle joins by OR, instead of each of their distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from covermap.functions.values import as_whole, is_fixed_width, is_floating
from covermap.operators.tally import scans
from covermap.operators.unions import union_all
from covermap.sources.spec import Source

#: Values of a bitmap, as Spark's bitmap functions have it.
BUCKET_VALUES = 32_768
#: A column is dense if its range needs at most so many bitmaps: at most a megabyte for each task and column.
MOST_BUCKETS = 256
#: And if it has at least so many values for each of them: ten times the bitmap's bytes as rows.
LEAST_VALUES = 1024


@dataclass(frozen=True)
class Bitmaps:
    """(slot, bucket, bits, copies): a bitmap for each bucket of each dense column, counted from its lowest value; nulls have no bucket."""

    rows: DataFrame
    lowest: dict[int, int]


def dense_ranges(sources: Sequence[Source], most_buckets: int = MOST_BUCKETS, least_values: int = LEAST_VALUES) -> dict[int, int]:
    """{slot: lowest value} of the dense columns, measured now by one aggregation: a row for each column reaches the driver."""
    def ranges(table: DataFrame, columns: list) -> DataFrame | None:
        whole = [(slot, as_whole(f"c{slot}", data_type)) for slot, data_type in columns if is_fixed_width(data_type) and not is_floating(data_type)]
        parts = ", ".join(f"named_struct('slot', {slot}, 'low', min({value}), 'high', max({value}), 'present', count({value}))" for slot, value in whole)
        return table.selectExpr(f"array({parts}) AS ranges").selectExpr("inline(ranges)") if whole else None

    parts = [part for table, columns in scans(sources) if (part := ranges(table, columns)) is not None]
    dense = {}
    for row in union_all(parts).collect() if parts else ():
        if row.present:
            buckets = (row.high - row.low) // BUCKET_VALUES + 1
            if buckets <= most_buckets and row.present >= least_values * buckets:
                dense[row.slot] = row.low
    return dense


def bitmaps_of(sources: Sequence[Source], lowest: dict[int, int]) -> Bitmaps | None:
    """The bitmaps of the columns in ``lowest``, as ``dense_ranges`` gives them; None without any."""
    def places(table: DataFrame, columns: list) -> DataFrame:
        flat = ", ".join(f"{slot} AS s{slot}, {as_whole(f'c{slot}', data_type)} - {lowest[slot]}L + 1 AS p{slot}" for slot, data_type in columns)
        rows = ", ".join(f"(s{slot}, p{slot})" for slot, _ in columns)
        return table.sparkSession.sql(f"SELECT slot, place FROM (SELECT {flat} FROM {{table}})"
                                      f" UNPIVOT INCLUDE NULLS ((slot, place) FOR name IN ({rows}))", table=table)

    dense = [(table, [column for column in columns if column[0] in lowest]) for table, columns in scans(sources)]
    parts = [places(table, columns) for table, columns in dense if columns]
    if not parts:
        return None
    rows = union_all(parts).groupBy("slot", F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"), F.count(F.lit(1)).alias("copies"))
    return Bitmaps(rows, lowest)


def bitmap_tally(bitmaps: Bitmaps) -> DataFrame:
    """(slot, rows, nulls, distincts) as ``exact_tally`` has them."""
    there = F.col("bucket").isNotNull()
    return bitmaps.rows.groupBy("slot").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.when(there, 0).otherwise(F.col("copies"))).alias("nulls"),
        F.sum(F.when(there, F.bitmap_count("bits")).otherwise(0)).alias("distincts"))


def lowest_of_bitmaps(bitmaps: Bitmaps, count: int) -> DataFrame:
    """(slot, whole, real, words, place): the ``count`` lowest values of each dense column, from as many of its first bitmaps at most."""
    first = bitmaps.rows.where("bucket IS NOT NULL").withColumn(
        "place", F.row_number().over(Window.partitionBy("slot").orderBy("bucket"))).where(F.col("place") <= count)
    filled = first.selectExpr("slot", "bucket", "hex(bits) AS digits").selectExpr(
        "slot", "bucket", "digits", f"explode(slice(filter(sequence(0, {BUCKET_VALUES // 8 - 1}), b -> substring(digits, 2 * b + 1, 2) != '00'), 1, {count})) AS byte")
    bits = filled.selectExpr(
        "slot", "bucket", "byte", "explode(filter(sequence(0, 7), i -> (CAST(conv(substring(digits, 2 * byte + 1, 2), 16, 10) AS INT) & shiftleft(1, i)) != 0)) AS bit")
    low = " ".join(f"WHEN {slot} THEN {value}L" for slot, value in bitmaps.lowest.items())
    values = bits.selectExpr("slot", f"CASE slot {low} END + (bucket - 1) * {BUCKET_VALUES}L + byte * 8 + bit AS whole")
    place = F.row_number().over(Window.partitionBy("slot").orderBy("whole"))
    return values.select("slot", "whole", F.lit(None).cast("double").alias("real"), F.lit(None).cast("string").alias("words"),
                         place.alias("place")).where(F.col("place") <= count)
