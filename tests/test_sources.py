import pytest

from covermap import (
    Source, SourceSpec, Split, advise, default_candidates, drop_kept, first_available, keep, load_catalog, load_report,
    profile_table, read, save, synthetic_fallbacks, synthetic_source, system_spec)
from covermap.sources.systems import is_enabled

ALL_SET = {
    "PG_HOST": "pg", "PG_USER": "reader", "MYSQL_HOST": "my", "MYSQL_DATABASE": "shop", "MYSQL_USER": "reader",
    "MSSQL_HOST": "ms", "MSSQL_PORT": "1444", "MSSQL_DATABASE": "shop", "MSSQL_USER": "reader", "HANA_HOST": "ha",
    "HANA_USER": "reader", "RUNTIME_ENV": "fabric", "ONELAKE_LAKEHOUSE_PATH": "/lake",
    "DATABRICKS_HOST": "db", "DATABRICKS_HTTP_PATH": "/sql/1",
}


def log_rows(log):
    return [(r.name, r.source_type, r.status) for r in log.collect()]


def test_nothing_is_enabled_without_settings():
    assert not any(spec.enabled for specs in default_candidates({}).values() for spec in specs)


def test_order_of_candidates():
    found = {name: [(s.source_type, s.table or s.path, s.table_name) for s in specs]
             for name, specs in default_candidates(ALL_SET).items()}
    assert found == {
        "orders": [("postgres", "orders", "orders"), ("mysql", "orders", "orders"), ("mssql", "orders", "orders"),
                   ("onelake", "/lake/Tables/orders", "orders")],
        "customers": [("postgres", "customers", "customers"), ("onelake", "/lake/Tables/customers", "customers")],
        "inventory": [("hana", "INVENTORY", "inventory"), ("databricks", "inventory", "inventory")]}


@pytest.mark.parametrize("system", ["postgres", "mysql", "mssql", "hana", "databricks"])
def test_databases_are_read_in_portions_and_on_wish_in_parallel(system):
    assert system_spec(system, "t", ALL_SET).options["fetchsize"] == "10000"
    split = Split("id", "0", "1000", 8)
    options = system_spec(system, "t", ALL_SET, split=split, fetch_rows=5).options
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"],
            options["fetchsize"]) == ("id", "0", "1000", "8", "5")
    assert (options.get("useCursorFetch") == "true") is (system == "mysql")


def test_splits_reach_the_candidates_of_their_table():
    found = default_candidates(ALL_SET, {"customers": Split("customer_id", "1", "9", 2)})
    assert {name: [s.options.get("numPartitions") for s in specs if s.format == "jdbc"] for name, specs in found.items()} == {
        "orders": [None, None, None], "customers": ["2"], "inventory": [None, None]}


def test_no_scan_of_the_library_carries_a_limit_without_order():
    """Only the probe of a candidate and the ordered sample cap rows."""
    from pathlib import Path
    import covermap
    files = [p for p in Path(covermap.__file__).parent.rglob("*.py") if "llm" not in p.parts]
    limits = {p.name: p.read_text().count(".limit(") for p in files if ".limit(" in p.read_text()}
    assert limits == {"reading.py": 1, "spec.py": 1}
    assert "orderBy(*order_by).limit(" in next(p for p in files if p.name == "spec.py").read_text()


@pytest.mark.parametrize("system, url, options", [
    ("postgres", "jdbc:postgresql://pg:5432/postgres", {"user": "reader", "loginTimeout": "10"}),
    ("mysql", "jdbc:mysql://my:3306/shop", {"user": "reader", "connectTimeout": "10000"}),
    ("mssql", "jdbc:sqlserver://ms:1444;databaseName=shop", {"encrypt": "true", "loginTimeout": "10"}),
    ("hana", "jdbc:sap://ha:30015", {"encrypt": "true", "validateCertificate": "true", "user": "reader"}),
    ("databricks", "jdbc:databricks://db:443", {"httpPath": "/sql/1", "ssl": "1", "user": "token"}),
])
def test_jdbc_options(system, url, options):
    spec = system_spec(system, "t", ALL_SET)
    assert spec.format == "jdbc" and spec.enabled and spec.options["url"] == url
    assert options.items() <= spec.options.items()
    assert spec.password_env and "password" not in spec.options


def test_a_user_key_replaces_host_and_password():
    spec = system_spec("hana", "t", {"HANA_USERKEY": "KEY"})
    assert spec.enabled and spec.password_env is None
    assert spec.options["key"] == "KEY" and "user" not in spec.options


@pytest.mark.parametrize("environment, enabled", [
    ({"RUNTIME_ENV": "fabric", "ONELAKE_LAKEHOUSE_PATH": "/lake"}, True),
    ({"RUNTIME_ENV": "fabric"}, False),
    ({"ONELAKE_LAKEHOUSE_PATH": "/lake"}, False),
])
def test_lakehouse_needs_runtime_and_path(environment, enabled):
    assert is_enabled("onelake", environment) is enabled


def test_password_is_read_from_the_environment_when_reading(spark, monkeypatch):
    seen = {}
    reader = type(spark.read)
    monkeypatch.setattr(reader, "option", lambda self, key, value: seen.update({key: value}) or self)
    monkeypatch.setattr(reader, "load", lambda self, path=None: spark.range(1))
    monkeypatch.setenv("PG_DIAGNOSE_PASSWORD", "secret")
    spec = system_spec("postgres", "t", ALL_SET)
    read(spark, spec)
    assert seen == {"password": "secret", "dbtable": "t"}
    assert "secret" not in repr(spec)
    read(spark, spec, {"PG_DIAGNOSE_PASSWORD": "other"})
    assert seen["password"] == "other"


def test_a_password_that_is_not_set_fails_its_candidate_only(spark, monkeypatch):
    monkeypatch.delenv("PG_DIAGNOSE_PASSWORD", raising=False)
    spec = system_spec("postgres", "t", ALL_SET)
    source, log = first_available(spark, "t", [spec], lambda: synthetic_source(spark, "orders"), environment={})
    assert source.is_synthetic and "PG_DIAGNOSE_PASSWORD is not set" in log[0]["error"]


def test_own_tables_need_no_stand_in(spark, sf_dir):
    works = SourceSpec("files", "region", "parquet", path=f"{sf_dir}/region.parquet")
    sources, _ = load_catalog(spark, {"mine": [works]}, {})
    assert sources["mine"].df.count() == 5
    with pytest.raises(ValueError, match="no source of mine works"):
        load_catalog(spark, {"mine": [SourceSpec("files", "t", "parquet", path="/none")]})


def test_query_scan(spark, monkeypatch):
    seen = {}
    reader = type(spark.read)
    monkeypatch.setattr(reader, "option", lambda self, key, value: seen.update({key: value}) or self)
    monkeypatch.setattr(reader, "load", lambda self, path=None: spark.range(5000))
    df = read(spark, SourceSpec("postgres", "t", "jdbc", query="SELECT 1"))
    assert seen == {"query": "SELECT 1"} and df.count() == 5000


@pytest.mark.parametrize("parts", [{}, {"table": "t", "query": "q"}, {"table": "t", "path": "p"}])
def test_a_spec_reads_exactly_one_thing(spark, parts):
    with pytest.raises(ValueError):
        read(spark, SourceSpec("x", "t", "jdbc", **parts))


def test_formats_and_catalog_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    for format in ("parquet", "orc", "json"):
        save(df, path=str(tmp_path / format), format=format)
        spec = SourceSpec("files", "t", format, path=str(tmp_path / format))
        assert sorted(map(tuple, read(spark, spec).select("n", "s").collect())) == [(1, "a"), (2, "b")]
    save(df, table="kept_table")
    assert read(spark, SourceSpec("catalog", "t", "table", table="kept_table")).count() == 2
    spark.sql("DROP TABLE kept_table")


def test_first_that_works_wins_and_later_ones_are_not_tried(spark, sf_dir, tmp_path):
    candidates = [
        SourceSpec("off", "t", "parquet", path="/none", enabled=False),
        SourceSpec("missing", "t", "parquet", path=str(tmp_path / "none")),
        SourceSpec("delta", "t", "delta", path=str(tmp_path)),
        SourceSpec("no_driver", "t", "jdbc", {"url": "jdbc:postgresql://h/d", "driver": "org.postgresql.Driver"},
                   table="t"),
        SourceSpec("good", "nation", "parquet", path=f"{sf_dir}/nation.parquet"),
        SourceSpec("never", "t", "parquet", path=f"{sf_dir}/region.parquet"),
    ]
    source, log = first_available(spark, "n", candidates, lambda: pytest.fail("no fallback needed"))
    assert [(e["source_type"], e["status"]) for e in log] == [
        ("off", "disabled"), ("missing", "failed"), ("delta", "failed"), ("no_driver", "failed"), ("good", "loaded")]
    assert all(e["error"] for e in log if e["status"] == "failed")
    assert "Driver" in log[3]["error"]
    assert (source.source_type, source.table_name, source.is_synthetic) == ("good", "nation", False)
    assert source.df.count() == 25


def test_an_empty_table_counts_as_available(spark, tmp_path):
    save(spark.createDataFrame([], "a int"), path=str(tmp_path / "empty"))
    source, _ = first_available(spark, "n", [SourceSpec("files", "t", "parquet", path=str(tmp_path / "empty"))],
                                lambda: pytest.fail("no fallback needed"))
    assert source.df.count() == 0


def test_everything_fails_and_the_run_still_ends(spark, tmp_path):
    environment = {"PG_HOST": "localhost", "RUNTIME_ENV": "fabric", "ONELAKE_LAKEHOUSE_PATH": str(tmp_path)}
    sources, log = load_catalog(spark, default_candidates(environment), synthetic_fallbacks(spark))
    assert log_rows(log) == [
        ("orders", "postgres", "failed"), ("orders", "mysql", "disabled"), ("orders", "mssql", "disabled"),
        ("orders", "onelake", "failed"), ("orders", "onelake", "synthetic"),
        ("customers", "postgres", "failed"), ("customers", "onelake", "failed"), ("customers", "onelake", "synthetic"),
        ("inventory", "hana", "disabled"), ("inventory", "databricks", "disabled"),
        ("inventory", "databricks", "synthetic")]
    assert all(s.is_synthetic for s in sources.values())
    report = {r.source_name: (r.source_type, r.is_synthetic, r.rows, r.columns)
              for r in load_report(list(sources.values())).collect()}
    assert report == {"orders": ("onelake", True, 500, 6), "customers": ("onelake", True, 1200, 6),
                      "inventory": ("databricks", True, 300, 5)}
    assert advise(list(sources.values()), samples=False).ranking.count() == 6


def test_an_error_after_the_probe_is_not_hidden(spark, tmp_path):
    path = str(tmp_path / "numbers")
    save(spark.range(10).selectExpr("id", "CAST(id AS STRING) AS text"), path=path)
    source, _ = first_available(spark, "n", [SourceSpec("files", "t", "parquet", path=path)],
                                lambda: pytest.fail("no fallback needed"))
    broken = Source("n", "files", "t", source.df.selectExpr("raise_error('late failure') AS x"))
    with pytest.raises(Exception, match="late failure"):
        profile_table(broken.df, "n", "files", "t").collect()


@pytest.mark.parametrize("name, schema", [
    ("orders", "order_id bigint, customer_id bigint, order_date timestamp, order_amount double,"
               " shipping_delay_days bigint, product_category string"),
    ("customers", "customer_id bigint, signup_date timestamp, email string, last_login_at timestamp,"
                  " total_spend double, region string"),
    ("inventory", "sku string, warehouse_id bigint, stock_qty bigint, reorder_point bigint, unit_cost double"),
])
def test_stand_in_schemas(spark, name, schema):
    df = synthetic_source(spark, name).df
    expected = spark.createDataFrame([], schema).dtypes
    assert df.dtypes == expected
    assert df.where(" OR ".join(f"{column} IS NULL" for column in df.columns)).isEmpty()


def test_stand_in_ranges(spark):
    from covermap.sources import synthetic
    orders, customers, inventory = (make(spark, 20_000) for make in (
        synthetic.orders, synthetic.customers, synthetic.inventory))
    o = orders.selectExpr(
        "min(order_id)", "max(order_id)", "min(customer_id)", "max(customer_id)",
        "CAST(min(order_date) AS STRING)", "CAST(max(order_date) AS STRING)", "min(shipping_delay_days)",
        "max(shipping_delay_days)", "count(DISTINCT product_category)").first()
    assert tuple(o) == (1, 20_000, 1000, 1199, "2026-01-01 00:00:00", "2026-08-28 00:00:00", 0, 9, 4)
    c = customers.selectExpr(
        "min(customer_id)", "max(customer_id)", "CAST(min(signup_date) AS STRING)", "CAST(max(signup_date) AS STRING)",
        "CAST(max(last_login_at) AS STRING)", "min(email)", "count(DISTINCT email)", "count(DISTINCT region)").first()
    assert tuple(c) == (1000, 20_999, "2023-07-17 00:00:00", "2025-12-02 00:00:00", "2026-01-01 00:00:00",
                        "user0@example.com", 20_000, 4)
    i = inventory.selectExpr("min(sku)", "min(warehouse_id)", "max(warehouse_id)", "min(stock_qty)", "max(stock_qty)",
                             "min(reorder_point)", "max(reorder_point)").first()
    assert tuple(i) == ("SKU-00000", 1, 5, 0, 499, 20, 99)
    for df, column, mean, deviation in ((orders, "order_amount", 85_000, 30_000),
                                        (customers, "total_spend", 500_000, 150_000),
                                        (inventory, "unit_cost", 12_000, 4_000)):
        found = df.selectExpr(f"avg({column})", f"stddev({column})", f"max(abs({column} - round({column})))").first()
        assert abs(found[0] - mean) < deviation * 0.03 and abs(found[1] - deviation) < deviation * 0.03
        assert found[2] == 0.0


def test_stand_ins_do_not_depend_on_partitions(spark):
    from covermap.sources import synthetic
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    first = sorted(map(tuple, synthetic.orders(spark).collect()))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert sorted(map(tuple, synthetic.orders(spark).collect())) == first
    finally:
        if before is None:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        else:
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)


def test_save_round_trip(spark, tmp_path):
    advice = advise([synthetic_source(spark, "orders")], samples=False)
    path = str(tmp_path / "scored")
    save(advice.scored, path=path, partition_by=["readiness"])
    back = spark.read.parquet(path).select(*advice.scored.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, advice.scored.collect()))
    save(advice.scored, path=path, mode="append", partition_by=["readiness"])
    assert spark.read.parquet(path).count() == 12
    with pytest.raises(Exception, match="(?i)exists"):
        save(advice.scored, path=path)


@pytest.mark.parametrize("target", [{}, {"path": "p", "table": "t"}])
def test_save_needs_one_target(spark, target):
    with pytest.raises(ValueError):
        save(spark.range(1), **target)


def test_keep_uses_the_shared_folder_and_cuts_lineage(spark, plan_of):
    df = spark.range(10).selectExpr("id AS `a.b`", "id * 2 AS `a.b`").repartition(3)
    kept = keep(df)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder.rstrip("/").split("/")[-1] == "shared" and folder in plan_of(kept)
    assert kept.columns == ["a.b", "a.b"] and kept.count() == 10
    assert "Exchange" not in plan_of(kept) and "Range" not in plan_of(kept)


def test_no_session_makes_a_folder_of_its_own(spark, monkeypatch):
    from covermap.plans import checkpointing
    context = type(spark.sparkContext)
    monkeypatch.setattr(checkpointing, "_SETTING", "spark.covermap.unset")
    monkeypatch.setattr(context, "getCheckpointDir", lambda self: "file:/shared/checkpoints/")
    assert checkpointing.shared_folder(spark) == "file:/shared/checkpoints"
    monkeypatch.setattr(context, "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError, match="executors share"):
        checkpointing.shared_folder(spark)


def test_kept_results_can_be_dropped(spark, monkeypatch, tmp_path):
    from covermap.plans import checkpointing
    monkeypatch.setattr(checkpointing, "shared_folder", lambda spark: str(tmp_path))
    keep(spark.range(3)), keep(spark.range(4))
    assert drop_kept(spark) == 2 and drop_kept(spark) == 0


def test_staged_source(spark):
    source = synthetic_source(spark, "inventory").staged()
    assert source.is_synthetic and source.df.count() == 300 and source.df.columns[0] == "sku"
