"""Bitmaps, checked estimates and file statistics against plain exact counts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from covermap import Source, count_columns, profile_catalog, statistics_session
from covermap.operators import bitmaps as dense, tally


def _source(spark, rows, schema, name="t"):
    return Source(name, "given", name, spark.createDataFrame(rows, schema).repartition(3))


@pytest.fixture(scope="module")
def source(spark):
    draw, start = random.Random(3), datetime.date(1969, 1, 1)
    rows = [(draw.randrange(-70_000, 70_000), draw.randrange(300) if n % 7 else None, n % 3 == 0, start + datetime.timedelta(draw.randrange(900)),
             draw.randrange(1 << 60), draw.random(), f"w{draw.randrange(50)}", None) for n in range(9000)]
    return _source(spark, rows, "wide bigint, code int, flag boolean, day date, sparse bigint, real double, word string, empty int")


def rows_of(df):
    return sorted(tuple(row) for row in df.collect())


def test_bitmaps_count_as_values_do(spark, source, monkeypatch):
    assert {source.df.columns[slot] for slot in dense.dense_ranges([source], least_values=1)} == {"wide", "code", "flag", "day"}
    assert {source.df.columns[slot] for slot in dense.dense_ranges([source])} == {"wide", "code", "flag", "day"}
    assert {source.df.columns[slot] for slot in dense.dense_ranges([source], most_buckets=1)} == {"code", "flag", "day"}
    assert rows_of(count_columns([source], bitmaps=True)) == rows_of(count_columns([source]))


def test_samples_come_from_bitmaps_too(spark, source):
    shown = lambda **options: rows_of(profile_catalog([source], **options).select("column", "sample_values", "cardinality_ratio", "null_ratio"))
    assert shown(bitmaps=True) == shown()


def test_bitmaps_at_the_edges_of_buckets(spark):
    edges = [0, 32_767, 32_768, 65_535, 65_536]
    source = _source(spark, [(edge - 5,) for edge in edges for _ in range(2)] + [(None,)], "n bigint")
    bitmaps = dense.bitmaps_of([source], {0: -5})
    assert rows_of(dense.bitmap_tally(bitmaps)) == [(0, 11, 1, 5)]
    assert [row.whole for row in dense.lowest_of_bitmaps(bitmaps, 3).sort("place").collect()] == [-5, 32_762, 32_763]
    assert bitmaps.rows.where("bucket is not null").count() == 3


def test_nothing_dense(spark):
    source = _source(spark, [], "n bigint, t string")
    assert dense.dense_ranges([source]) == {} and dense.bitmaps_of([source], {}) is None
    assert [row[-3:] for row in rows_of(count_columns([source], bitmaps=True))] == [(0, 0, 0), (0, 0, 0)]


def test_all_dense(spark):
    source = _source(spark, [(n % 5,) for n in range(6000)], "n int")
    assert list(dense.dense_ranges([source])) == [0]
    assert rows_of(count_columns([source], bitmaps=True))[0][-3:] == (6000, 0, 5)
    assert profile_catalog([source], bitmaps=True).first().sample_values == ["0", "1", "2"]


def test_flags_near_the_threshold_are_counted_again(spark):
    """Shares of distinct values around 0.95, where estimates flip."""
    size = 20_000
    shares = [0.90, 0.93, 0.945, 0.9499, 0.95, 0.9501, 0.955, 0.97, 1.0]
    columns = [F.when(F.col("id") < int(size * share), F.col("id")).otherwise(0).cast("bigint").alias(f"c{n}") for n, share in enumerate(shares)]
    small = [F.when(F.col("id") < distinct, F.col("id")).alias(f"s{distinct}") for distinct in (19, 20, 21)]
    source = Source("t", "given", "t", spark.range(size).select(*columns, *small))
    flags = lambda distinct: rows_of(profile_catalog([source], distinct=distinct, samples=False).select("column", "is_probable_id"))
    assert flags("checked") == flags("exact")


def test_only_doubtful_columns_are_counted_again(spark, monkeypatch):
    again = []
    monkeypatch.setattr(tally, "distinct_values", lambda sources, without=(), real=tally.distinct_values: again.append(set(without)) or real(sources, without))
    source = Source("t", "given", "t", spark.range(5000).selectExpr("id", "id AS unique", "id % 7 AS few", "CAST(id * 0.951 AS BIGINT) AS near"))
    tally.checked_tally([source]).collect()
    # The name of ``id`` says enough; ``few`` is far away.
    assert again == [{0, 2}] or again == [{0, 1, 2}]


@pytest.mark.parametrize("rows, nulls, distincts, doubtful", [
    (0, 0, 0, False), (1000, 0, 1000, True), (1000, 0, 800, False), (1000, 0, 930, True), (1000, 0, 950, True), (1000, 400, 600, False), (21, 0, 21, True), (10, 0, 10, False)])
def test_doubt(rows, nulls, distincts, doubtful):
    assert tally._doubtful(rows, nulls, distincts) == doubtful


def test_statistics_count_as_scans_do(spark, tmp_path):
    rows = [(n if n % 4 else None, float("nan") if n % 3 == 0 else 1.5, None if n % 5 == 0 else "x", [[n], [], [None], None][n % 4]) for n in range(60)]
    spark.createDataFrame(rows, "n int, real double, word string, list array<int>").write.parquet(str(tmp_path / "t"))
    session = statistics_session(spark)
    assert session.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    given = [Source("t", "parquet", "t", one.read.parquet(str(tmp_path / "t"))) for one in (session, spark)]
    counted = [rows_of(tally.null_tally([source]).select("slot", "rows", "nulls")) for source in given]
    assert counted[0] == counted[1] == [(0, 60, 15), (1, 60, 20), (2, 60, 12), (3, 60, 15)]


def test_computed_columns_are_read(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = statistics_session(spark).read.parquet(str(tmp_path / "t")).withColumn("gap", F.expr("IF(id < 4, NULL, id)"))
    source = Source("t", "parquet", "t", df, computed=("gap",))
    assert rows_of(tally.null_tally([source]).select("slot", "rows", "nulls")) == [(0, 10, 0), (1, 10, 4)]
