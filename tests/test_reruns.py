"""Ranges of equal depth, concurrent probes, saving again and answers that outlive a run."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from covermap import (
    SourceSpec, equi_depth_bounds, first_available, load_catalog, range_predicates, save, suggest, synthetic_fallbacks, system_spec)
from covermap.sources import reading
from covermap.sources.systems import Split

ENVIRONMENT = {"PG_HOST": "db", "PG_USER": "me", "PG_DIAGNOSE_PASSWORD": "x"}


# ---- ranges ----

def _depths(rows, predicates):
    met = sum((F.expr(predicate).cast("int") for predicate in predicates), F.lit(0))
    assert rows.where(met != 1).isEmpty()
    return [rows.where(predicate).count() for predicate in predicates]


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,2)", "timestamp_ntz", "date"])
def test_skewed_keys_are_divided_evenly(spark, kind):
    draw = random.Random(4)
    keys = spark.createDataFrame([(int(draw.paretovariate(0.7) * 1000),) for _ in range(8000)] + [(None,)] * 5, "n bigint").repartition(3)
    cast = {"timestamp_ntz": "TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(n % 1000000 AS DECIMAL(18, 6)))",
            "date": "date_add(DATE'2000-01-01', CAST(n % 100000 AS INT))"}.get(kind, f"CAST(n AS {kind})")
    rows = keys.selectExpr(f"{cast} AS `odd key`")
    bounds = equi_depth_bounds(rows, "odd key", 8)
    depths = _depths(rows, range_predicates("`odd key`", bounds))
    assert len(depths) == 8 and max(depths) < 1300


def test_texts_with_a_common_beginning_are_divided(spark):
    rows = spark.range(4000).selectExpr("concat('https://example.org/it''s/', lpad(id, 6, '0')) AS url")
    depths = _depths(rows, range_predicates("url", equi_depth_bounds(rows, "url", 4)))
    assert len(depths) == 4 and max(depths) < 1500


def test_a_common_key_is_one_bound(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS k")
    bounds = equi_depth_bounds(rows, "k", 6)
    assert bounds == sorted(set(bounds)) and len(_depths(rows, range_predicates("k", bounds))) <= 6
    assert equi_depth_bounds(rows, "k", 1) == [] and range_predicates("k", []) == ()
    assert equi_depth_bounds(rows.where("k IS NULL"), "k", 4) == []


def test_bounds_that_are_no_literals():
    assert range_predicates("d", [datetime.date(2020, 1, 2)])[0] == "(d < DATE '2020-01-02' OR d IS NULL)"
    with pytest.raises(ValueError):
        range_predicates("x", [b"raw"])
    with pytest.raises(ValueError):
        range_predicates("x", [float("inf")])


class _Reader:
    """Notes what a JDBC reader is asked for; no database is there."""

    def __init__(self):
        self.asked = {}

    def __getattr__(self, name):
        def note(*args, **named):
            self.asked[name] = (args, named)
            if name == "option":
                self.asked.setdefault("options_set", {})[args[0]] = args[1]
            return self
        return note


class _Session:
    def __init__(self):
        self.read = _Reader()


def test_a_query_is_read_in_ranges():
    split = Split("id", "1", "1000", 8)
    spec = system_spec("postgres", "orders", ENVIRONMENT, query="SELECT id FROM orders WHERE x > 1", split=split)
    session = _Session()
    reading.read(session, spec, ENVIRONMENT)
    assert session.read.asked["options_set"]["dbtable"] == "(SELECT id FROM orders WHERE x > 1) AS ranged"
    assert session.read.asked["options"][1]["partitionColumn"] == "id" and "query" not in session.read.asked["options_set"]
    session = _Session()
    reading.read(session, system_spec("postgres", "orders", ENVIRONMENT, query="SELECT 1"), ENVIRONMENT)
    assert session.read.asked["options_set"]["query"] == "SELECT 1" and "dbtable" not in session.read.asked["options_set"]


def test_predicates_make_a_read_each():
    predicates = range_predicates("id", [10, 20])
    session, spec = _Session(), system_spec("postgres", "orders", ENVIRONMENT, predicates=predicates)
    reading.read(session, spec, ENVIRONMENT)
    (url, table), named = session.read.asked["jdbc"]
    assert url.startswith("jdbc:postgresql://db") and table == "orders" and named["predicates"] == list(predicates)
    assert named["properties"]["password"] == "x" and "url" not in named["properties"] and "partitionColumn" not in named["properties"]
    with pytest.raises(ValueError):
        system_spec("postgres", "orders", ENVIRONMENT, predicates=predicates, split=Split("id", "1", "2", 2))


# ---- probes ----

def _slow(monkeypatch, seconds):
    real = reading.read

    def read(spark, spec, environment):
        if spec.source_type == "dead":
            time.sleep(seconds)
            raise reading.MissingPassword("no answer")
        return real(spark, spec, environment)

    monkeypatch.setattr(reading, "read", read)


def test_twenty_dead_candidates_cost_one_timeout(spark, sf_dir, monkeypatch):
    dead = [SourceSpec("dead", f"t{n}", "jdbc", table="t") for n in range(20)]
    alive = [SourceSpec("parquet", "orders", "parquet", path=f"{sf_dir}/orders.parquet"), SourceSpec("parquet", "nation", "parquet", path=f"{sf_dir}/nation.parquet")]
    off = SourceSpec("dead", "off", "jdbc", table="t", enabled=False)
    _slow(monkeypatch, 0.0)
    expected = first_available(spark, "orders", [off, *dead, *alive])
    _slow(monkeypatch, 0.5)
    began = time.time()
    found = first_available(spark, "orders", [off, *dead, *alive], probes=32)
    assert time.time() - began < 5
    assert found[1] == expected[1] and found[0].table_name == "orders" and [entry["status"] for entry in found[1]] == ["disabled"] + ["failed"] * 20 + ["loaded"]


def test_catalogs_are_probed_together(spark, sf_dir, monkeypatch):
    _slow(monkeypatch, 0.4)
    candidates = {name: [SourceSpec("dead", name, "jdbc", table="t")] for name in ("orders", "customers", "inventory")}
    candidates["nation"] = [SourceSpec("dead", "n", "jdbc", table="t"), SourceSpec("parquet", "nation", "parquet", path=f"{sf_dir}/nation.parquet")]
    began = time.time()
    sources, log = load_catalog(spark, candidates, synthetic_fallbacks(spark), probes=8)
    assert time.time() - began < 1.6 and list(sources) == list(candidates)
    assert [row.status for row in log.collect()] == ["failed", "synthetic"] * 3 + ["failed", "loaded"]


def test_an_error_that_is_no_dead_source_is_raised(spark, monkeypatch):
    specs = [SourceSpec("a", "a", "parquet", path="/nowhere"), SourceSpec("b", "b", "parquet")]
    with pytest.raises(ValueError):
        first_available(spark, "t", specs, probes=4)


# ---- saving again ----

def _files(path):
    return {os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
            for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def test_a_rerun_touches_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "scored")
    rows = lambda run, count: spark.range(count).selectExpr("id", f"'{run}' AS run")
    save(rows("a", 3).union(rows("b", 4)), path, mode="replace", partition_by=["run"])
    before = _files(path)
    for _ in range(2):
        save(rows("b", 2), path, mode="replace", partition_by=["run"])
    after = _files(path)
    assert {name: at for name, at in before.items() if "run=a" in name} == {name: at for name, at in after.items() if "run=a" in name}
    assert sorted(map(tuple, spark.read.parquet(path).select("run", "id").collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    with pytest.raises(ValueError):
        save(rows("b", 1), path, mode="replace")


def test_a_table_is_saved_again_by_name(spark):
    rows = lambda scope, values: spark.createDataFrame([(value, scope, f"n{value}") for value in values], "v bigint, scope string, name string")
    try:
        save(rows("x", [1, 2]).union(rows("y", [3])), table="saved_scores", mode="replace", partition_by=["scope"])
        save(rows("y", [8, 9]), table="saved_scores", mode="replace", partition_by=["scope"])
        assert sorted(map(tuple, spark.table("saved_scores").select("scope", "v", "name").collect())) == [
            ("x", 1, "n1"), ("x", 2, "n2"), ("y", 8, "n8"), ("y", 9, "n9")]
    finally:
        spark.sql("DROP TABLE IF EXISTS saved_scores")


# ---- answers ----

def _names(spark, count):
    return spark.range(count).selectExpr("concat('name', id) AS column", "array('x') AS sample_values")


def _asking(folder, dead=None):
    """A guess that leaves a line for each call, and may fail at one name."""
    def guess(name, samples):
        with open(os.path.join(folder, f"calls-{os.getpid()}"), "a") as file:
            file.write(name + "\n")
        if name == dead:
            raise RuntimeError("the service is gone")
        return None if name.endswith("3") else name.upper()

    return guess


def _calls(folder):
    return sorted(line for name in os.listdir(folder) if name.startswith("calls-") for line in open(os.path.join(folder, name)).read().split())


def test_a_run_that_dies_half_way_pays_once_for_each_portion_it_finished(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    portions = {row.column: row.portion for row in _names(spark, 80).select("column", F.pmod(F.xxhash64("column"), F.lit(8)).alias("portion")).collect()}
    dead = min(name for name, portion in portions.items() if portion == 5)
    with pytest.raises(Exception, match="the service is gone"):
        suggest(_names(spark, 80), _asking(str(calls), dead), 4, answers=answers, portions=8)
    first = _calls(str(calls))
    finished = {name for name, portion in portions.items() if portion < 5}
    assert finished <= set(first) and not any(portions[name] > 5 for name in first)
    result = suggest(_names(spark, 80), _asking(str(calls)), 4, answers=answers, portions=8)
    again = _calls(str(calls))
    assert all(again.count(name) == 1 for name in finished)
    assert sorted((row.column, row.concept) for row in result.collect()) == sorted(
        (name, None if name.endswith("3") else name.upper()) for name in portions)


def test_later_runs_ask_about_new_names_only(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    assert suggest(_names(spark, 0), _asking(str(calls)), 2, answers=answers).collect() == []
    suggest(_names(spark, 10), _asking(str(calls)), 2, answers=answers)
    assert suggest(_names(spark, 14), _asking(str(calls)), 2, answers=answers).count() == 14
    assert suggest(_names(spark, 4), _asking(str(calls)), 2, answers=answers).count() == 4
    assert _calls(str(calls)) == sorted(f"name{n}" for n in range(14))
