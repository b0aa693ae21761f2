import pytest

import __spark_entry__ as driver
from checks.compare import duckdb_rows, duckdb_tables, spark_rows
from checks.queries import QUERIES
from checks.tables import TABLES, read_table


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duckdb_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duckdb_rows(connection, driver.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.oracle_sql())


def test_tables_are_listed_as_they_are(spark, sf_dir):
    for name, columns in TABLES.items():
        assert spark.read.parquet(f"{sf_dir}/{name}.parquet").dtypes == list(columns.items())
        assert read_table(spark, sf_dir, name).dtypes == list(columns.items())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns[:3] == ["name", "coverage_pct", "readiness"] and result.count() == 6
