import math
import random
from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F, types as T

from covermap import Source, count_columns, lowest_values, only_columns, profile_catalog, profile_table
from covermap.functions.patterns import field_speaks_of_pii, field_speaks_of_time


def profile(df, **options):
    rows = profile_table(df, "s", "test", "t", **options).collect()
    return {row["column"]: row for row in rows}


def counts(df, **options):
    rows = count_columns([Source("s", "test", "t", df)], **options).collect()
    return {row["column"]: (row["rows"], row["nulls"], row["distincts"]) for row in rows}


def test_schema_and_provenance(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, label string")
    result = profile_table(df, "orders", "postgres", "public.orders")
    assert result.schema.simpleString() == (
        "struct<source_name:string,source_type:string,table_name:string,column:string,dtype:string,"
        "null_ratio:double,cardinality_ratio:double,is_probable_datetime:boolean,is_probable_id:boolean,"
        "is_probable_pii:boolean,sample_values:array<string>>")
    first = result.where("column = 'id'").first()
    assert (first.source_name, first.source_type, first.table_name, first.dtype) == (
        "orders", "postgres", "public.orders", "bigint")


@pytest.mark.parametrize("distinct", ["exact", "approx"])
def test_empty_table_keeps_its_columns(spark, distinct):
    rows = profile(spark.createDataFrame([], "a int, b string"), distinct=distinct)
    assert set(rows) == {"a", "b"}
    for row in rows.values():
        assert (row.null_ratio, row.cardinality_ratio, row.sample_values) == (0.0, 0.0, [])
        assert not row.is_probable_id


@pytest.mark.parametrize("distinct", ["exact", "approx"])
def test_all_null_column(spark, distinct):
    row = profile(spark.createDataFrame([(None,)] * 5, "a string"), distinct=distinct)["a"]
    assert (row.null_ratio, row.cardinality_ratio, row.sample_values) == (1.0, 0.0, [])


@pytest.mark.parametrize("distinct", ["exact", "approx"])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_nan_counts_as_null(spark, distinct, kind):
    df = spark.createDataFrame([(1.5,), (1.5,), (math.nan,), (None,)], f"a {kind}")
    assert counts(df, distinct=distinct)["a"] == (4, 2, 1)
    assert profile(df)["a"].sample_values == ["1.5"]


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0, [0.0]), (-0.0, [-0.0])], "a double, b array<double>")
    assert counts(df) == {"a": (2, 0, 1), "b": (2, 0, 1)}


@pytest.mark.parametrize("rows, flagged", [(20, False), (21, True)])
def test_id_by_distinct_count(spark, rows, flagged):
    assert profile(spark.range(rows).toDF("measure"))["measure"].is_probable_id is flagged


@pytest.mark.parametrize("distinct, flagged", [(95, False), (96, True)])
def test_id_threshold_is_strict_and_unrounded(spark, distinct, flagged):
    df = spark.range(100).select((F.col("id") % distinct).alias("measure"))
    assert profile(df)["measure"].is_probable_id is flagged


def test_id_threshold_before_rounding(spark):
    # 9504 of 10000 rounds to 0.95 but lies above it.
    df = spark.range(10000).select((F.col("id") % 9504).alias("measure"))
    row = profile(df, samples=False)["measure"]
    assert (row.cardinality_ratio, row.is_probable_id) == (0.95, True)


def test_flags_by_name(spark):
    names = ["주문일자", "고객번호", "E-MAIL", "id", "ID", "row_key", "keyed", "created_at", "at_home", "hotel",
             "plain", "order_no", "none", "일시", "주민"]
    rows = profile(spark.createDataFrame([tuple([1] * len(names))], names), samples=False)
    assert {n for n in names if rows[n].is_probable_datetime} == {"주문일자", "created_at", "일시"}
    assert {n for n in names if rows[n].is_probable_id} == {"고객번호", "id", "ID", "row_key", "order_no"}
    assert {n for n in names if rows[n].is_probable_pii} == {"E-MAIL", "hotel", "주민"}


def test_flags_by_type(spark):
    df = spark.sql("SELECT DATE'2026-01-01' AS a, TIMESTAMP'2026-01-01 00:00:00' AS b,"
                   " TIMESTAMP_NTZ'2026-01-01 00:00:00' AS c, '2026-01-01' AS d")
    flags = {name: row.is_probable_datetime for name, row in profile(df).items()}
    assert flags == {"a": True, "b": True, "c": True, "d": False}


def test_choosing_columns_by_name_agrees_with_the_flags(spark, sf_dir):
    from checks.tables import catalog
    sources = catalog(spark, sf_dir)
    whole = profile_catalog(sources, samples=False)
    for flag, wanted in (("is_probable_datetime", field_speaks_of_time), ("is_probable_pii", field_speaks_of_pii)):
        chosen = {(s.name, column) for s in only_columns(sources, wanted) for column in s.df.columns}
        flagged = {(r.source_name, r.column) for r in whole.where(flag).collect()}
        assert chosen == flagged


def test_samples_are_the_lowest_distinct_values(spark):
    df = spark.createDataFrame(
        [(3, "b", True, date(2026, 1, 2)), (1, "a", False, date(2026, 1, 1)), (3, "a", True, None),
         (10, "c", None, None), (2, "d", None, None)], "n int, s string, f boolean, d date")
    found = {name: row.sample_values for name, row in profile(df).items()}
    assert found == {"n": ["1", "2", "3"], "s": ["a", "b", "c"], "f": ["false", "true"],
                       "d": ["2026-01-01", "2026-01-02"]}


@pytest.mark.parametrize("distinct", [1, 2, 3, 40, 3000])
@pytest.mark.parametrize("beginning", ["v", "v" * 31, "v" * 32, "v" * 40])
def test_lowest_texts_are_exact_whatever_bounds_them(spark, distinct, beginning):
    df = spark.range(6000).select(
        F.concat(F.lit(beginning), F.col("id") % distinct).alias("t"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("w"), F.col("id") % distinct)).otherwise("a hot text").alias("h"))
    every = [df.select(name).distinct().orderBy(name).limit(3).collect() for name in "th"]
    found = lowest_values([Source("s", "test", "t", df)]).orderBy("slot").collect()
    assert [row.sample_values for row in found] == [[r[0] for r in rows] for rows in every]


@pytest.mark.parametrize("count", [1, 2, 5])
def test_sample_count(spark, count):
    df = spark.range(4).toDF("n")
    row = lowest_values([Source("s", "test", "t", df)], count).first()
    assert row.sample_values == ["0", "1", "2", "3"][:count]


def test_long_texts_stay_whole(spark):
    texts = ["x" * 5000 + suffix for suffix in ("a", "b", "c", "d")] + ["y" * 31, "y" * 32, "y" * 33, ""]
    df = spark.createDataFrame([(t,) for t in texts] * 3, "t string")
    assert counts(df)["t"] == (24, 0, 8)
    assert profile(df)["t"].sample_values == sorted(texts)[:3]


def test_nested_and_other_types(spark):
    df = spark.createDataFrame([
        (["a, b"], {"k": 1, "j": 2}, Row(x=1, y=None), bytearray(b"\x00"), Decimal("1.10"), None),
        (["a", "b"], {"j": 2, "k": 1}, Row(x=1, y=None), bytearray(b"\x00\x00"), Decimal("1.1"), None),
        ([], {}, Row(x=None, y=None), bytearray(b""), Decimal("12345678901234567890.12"), None),
        (None, None, None, None, None, None),
    ], "a array<string>, m map<string,int>, s struct<x:int,y:string>, b binary, d decimal(30,2), v void")
    assert counts(df) == {"a": (4, 1, 3), "m": (4, 1, 2), "s": (4, 1, 2), "b": (4, 1, 3), "d": (4, 1, 2),
                          "v": (4, 4, 0)}
    rows = profile(df)
    # Nested values are ordered by their text.
    assert rows["a"].sample_values == ['["a","b"]', '["a, b"]', "[]"]
    assert rows["d"].sample_values == ["1.10", "12345678901234567890.12"]
    assert len(rows["m"].sample_values) == 2
    assert rows["v"].sample_values == []


def test_deeply_nested_values_are_compared_by_value(spark):
    schema = "a array<struct<m:map<string,array<double>>,`odd name`:timestamp>>"
    moment = datetime(2026, 1, 1, 0, 0, 0, 1)
    later = datetime(2026, 1, 1, 0, 0, 0, 2)
    df = spark.createDataFrame([
        ([({"x": [0.0], "y": []}, moment)],), ([({"y": [], "x": [-0.0]}, moment)],),
        ([({"x": [0.0], "y": []}, later)],), ([(None, moment), None],)], schema)
    assert counts(df)["a"] == (4, 0, 3)


def test_awkward_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a.b", "tick`s", "with space", "dup"]).selectExpr(
        "*", "5 AS dup", "6 AS `it's`")
    listed = profile_table(df, "s", "test", "t").collect()
    assert sorted(row.column for row in listed) == sorted(["a.b", "tick`s", "with space", "dup", "dup", "it's"])
    assert sorted(row.sample_values[0] for row in listed) == ["1", "2", "3", "4", "5", "6"]


def test_wide_table(spark):
    width = 230
    df = spark.range(50).select(*[(F.col("id") % (i % 50 + 1)).alias(f"v{i}") for i in range(width)])
    assert counts(df) == {f"v{i}": (50, 0, i % 50 + 1) for i in range(width)}
    assert profile(df)["v222"].sample_values == ["0", "1", "2"]


def test_collated_texts_are_counted_as_their_collation_says(spark):
    df = spark.sql("SELECT x COLLATE UTF8_LCASE AS x FROM VALUES ('a'), ('A'), ('b') AS t(x)")
    assert counts(df)["x"] == (3, 0, df.select(F.count_distinct("x")).first()[0] == 2 and 2)
    assert profile(df)["x"].sample_values[-1] == "b"


def test_times_come_back_from_their_keys(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'1969-12-31 23:59:59.999999', TIMESTAMP'1950-01-02 03:04:05.000006',"
                   " DATE'0001-01-01', CAST('-0.05' AS DECIMAL(4, 2))), (TIMESTAMP_NTZ'2024-03-31 02:30:00',"
                   " TIMESTAMP'2026-01-01 00:00:00', DATE'1969-12-31', CAST('99.90' AS DECIMAL(4, 2))) AS t(n, t, d, m)")
    expected = {name: sorted(r[0] for r in df.select(F.col(name).cast("string")).collect()) for name in df.columns}
    found = {name: row.sample_values for name, row in profile(df).items()}
    assert {name: sorted(values) for name, values in found.items()} == expected
    assert found["n"][0].startswith("1969") and found["m"] == ["-0.05", "99.90"]


def test_batches_give_the_same_profile(spark, sf_dir):
    from checks.tables import catalog
    from covermap import profile_in_batches
    sources = catalog(spark, sf_dir, "region", "nation", "supplier")
    whole = sorted(map(str, profile_catalog(sources).collect()))
    assert sorted(map(str, profile_in_batches(sources, tables=2).collect())) == whole


def test_against_brute_force_with_a_hot_value(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "hot", "hot", f"k{rng.randrange(400)}"]),
             rng.choice([math.nan, None, 1.0, rng.uniform(1, 2)]), rng.randrange(50)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s string, x double, n bigint").repartition(7)
    kept = defaultdict(list)
    for row in rows:
        for name, value in zip("sxn", row):
            if value is not None and value == value:
                kept[name].append(value)
    found = profile(df)
    for name in "sxn":
        assert counts(df)[name] == (3000, 3000 - len(kept[name]), len(set(kept[name])))
        assert found[name].sample_values == [str(v) for v in sorted(set(kept[name]))[:3]]


def test_result_does_not_depend_on_partitioning(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    expected = sorted(map(str, profile_table(df, "s", "t", "t").collect()))
    for parts in (df.repartition(1), df.repartition(13), df.repartition(5, "event_type")):
        assert sorted(map(str, profile_table(parts, "s", "t", "t").collect())) == expected


def test_ratios_lie_between_zero_and_one(spark, sf_dir):
    from checks.tables import catalog_with_gaps
    result = profile_catalog(catalog_with_gaps(spark, sf_dir), samples=False)
    assert result.where("null_ratio NOT BETWEEN 0 AND 1 OR cardinality_ratio NOT BETWEEN 0 AND 1").isEmpty()
    assert not result.where("null_ratio > 0").isEmpty()


def test_approx_is_close(spark):
    df = spark.range(200_000).select("id", F.col("id").cast("string").alias("text"), (F.col("id") % 7).alias("few"))
    found = counts(df, distinct="approx")
    assert found["few"] == (200_000, 0, 7)
    assert all(abs(found[name][2] - 200_000) < 10_000 for name in ("id", "text"))


def test_nulls_only(spark, sf_dir):
    from checks.tables import catalog_with_gaps
    sources = catalog_with_gaps(spark, sf_dir)
    listed = ["source_name", "column", "dtype", "null_ratio", "is_probable_datetime", "is_probable_pii"]
    exact = profile_catalog(sources, samples=False).select(*listed).collect()
    nulls = profile_catalog(sources, distinct="none", samples=False)
    assert sorted(map(tuple, nulls.select(*listed).collect())) == sorted(map(tuple, exact))
    flags = {(r.source_name, r.column): (r.cardinality_ratio, r.is_probable_id) for r in nulls.collect()}
    assert flags["events", "event_id"] == (None, True) and flags["orders", "o_orderkey"] == (None, None)


def test_sample_rows(spark):
    source = Source("s", "test", "t", spark.range(100).repartition(5).toDF("n"))
    with pytest.raises(TypeError):
        source.sample_rows(10)
    assert [r.n for r in source.sample_rows(3, ["n"]).df.collect()] == [0, 1, 2]


def test_fixed_width_keys_keep_every_value(spark):
    """Dense, sparse and neighbouring values of each fixed-width type keep their exact count."""
    df = spark.range(-100_000, 100_000).select(
        F.col("id").alias("b"), (F.col("id") * 4294967296 + 7).alias("high"), F.col("id").cast("int").alias("i"),
        (F.col("id") / 3).alias("x"), (F.col("id") / 3).cast("float").alias("f"),
        F.timestamp_micros("id").alias("ts"), F.expr("DATE'2000-01-01' + CAST(id AS INT)").alias("day"),
        (F.col("id") / 100).cast("decimal(18,2)").alias("money"))
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
    assert {name: value[2] for name, value in counts(df).items()} == exact.asDict()


def test_types_are_reported_as_spark_names_them(spark):
    df = spark.createDataFrame([], T.StructType([
        T.StructField("a", T.DecimalType(10, 2)), T.StructField("b", T.ArrayType(T.FloatType()))]))
    assert {name: row.dtype for name, row in profile(df).items()} == {"a": "decimal(10,2)", "b": "array<float>"}
