"""From specs to DataFrames: one reader, and the first source of several that works."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from covermap.operators.unions import union_all
from covermap.sources.spec import Source, SourceSpec

_LOG = pa.schema([("name", pa.string()), ("source_type", pa.string()), ("table_name", pa.string()),
                  ("status", pa.string()), ("error", pa.string())])
_RANGE_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
LOADED, DISABLED, FAILED, FALLBACK = "loaded", "disabled", "failed", "synthetic"


_Probe = Callable[[SourceSpec], tuple[DataFrame | None, str | None]]


class MissingPassword(PySparkException):
    """A source wants a password that the environment does not hold."""

    def __init__(self, message: str):
        super().__init__(message=message)


def read(spark: SparkSession, spec: SourceSpec, environment: Mapping[str, str] = os.environ) -> DataFrame:
    """A lazy, distributed read of one spec.

    For a large database table or query give ``system_spec`` a ``Split``, or predicates: Spark then reads ranges of it in
    parallel. A query that is read so is asked for as a derived table, each time with the range's own condition.
    """
    if sum(part is not None for part in (spec.table, spec.query, spec.path)) != 1:
        raise ValueError(f"{spec.source_type}: give exactly one of table, query and path")
    if spec.format == "table":
        df = spark.table(spec.table)
    else:
        reader = spark.read.format(spec.format).options(**spec.options)
        if spec.password_env:
            if not environment.get(spec.password_env):
                raise MissingPassword(f"{spec.source_type}: {spec.password_env} is not set")
            reader = reader.option("password", environment[spec.password_env])
        derived = spec.table if spec.table is not None else f"({spec.query}) AS ranged"
        if spec.path is not None:
            df = reader.load(spec.path)
        elif spec.predicates:
            options = {name: value for name, value in spec.options.items() if name not in _RANGE_OPTIONS}
            if spec.password_env:
                options["password"] = environment[spec.password_env]
            df = spark.read.jdbc(options.pop("url"), derived, predicates=list(spec.predicates), properties=options)
        elif spec.table is not None or "partitionColumn" in spec.options:
            df = reader.option("dbtable", derived).load()
        else:
            df = reader.option("query", spec.query).load()
    return df


def first_available(spark: SparkSession, name: str, candidates: Sequence[SourceSpec],
                    fallback: Callable[[], Source] | None = None,
                    environment: Mapping[str, str] = os.environ, stage: bool = False, probes: int = 1) -> tuple[Source, list[dict]]:
    """The first candidate that is enabled and yields a row or an empty result, else the fallback.

    ``stage`` reads a chosen database table once, into the shared folder: a live table would otherwise be queried by
    every scan, and could change between them. Without a fallback it is an error when no candidate works.

    Spark reads lazily, so each candidate is probed with one row before it is chosen, and later
    candidates are not touched. With ``probes`` over 1, so many candidates are probed at a time, and the choice and its log are
    the same: dead systems then cost one timeout together instead of one each. An error after the
    probe is not hidden: it fails the job. The second value is the log, one entry per candidate tried.
    """
    with _probing(spark, [spec for spec in candidates if spec.enabled], environment, probes) as probe:
        return _chosen(name, candidates, probe, fallback, stage)


def _probe(spark: SparkSession, spec: SourceSpec, environment: Mapping[str, str]) -> tuple[DataFrame | None, str | None]:
    """The table, or why it cannot be read."""
    try:
        df = read(spark, spec, environment)
        df.limit(1).collect()
    except (PySparkException, Py4JJavaError) as error:
        cause = error.java_exception.toString() if isinstance(error, Py4JJavaError) else str(error)
        return None, cause.splitlines()[0]
    return df, None


@contextmanager
def _probing(spark: SparkSession, specs: Sequence[SourceSpec], environment: Mapping[str, str], probes: int) -> Iterator[_Probe]:
    """A function that probes a spec; with ``probes`` over 1 all are under way, so many at a time, in the order given."""
    if probes < 2 or len(specs) < 2:
        yield lambda spec: _probe(spark, spec, environment)
        return
    with ThreadPoolExecutor(probes) as pool:
        # A thread of its own for each probe hands Spark's job properties on.
        def start(spec: SourceSpec) -> Future:
            return pool.submit(inheritable_thread_target(spark)(lambda: _probe(spark, spec, environment)))

        under_way = {id(spec): start(spec) for spec in specs}
        try:
            yield lambda spec: under_way[id(spec)].result()
        finally:
            for one in under_way.values():
                one.cancel()


def _chosen(name: str, candidates: Sequence[SourceSpec], probe: _Probe, fallback: Callable[[], Source] | None,
            stage: bool) -> tuple[Source, list[dict]]:
    log = []

    def note(spec: SourceSpec | Source, status: str, error: str | None = None) -> None:
        log.append({"name": name, "source_type": spec.source_type, "table_name": spec.table_name,
                    "status": status, "error": error})

    for spec in candidates:
        if not spec.enabled:
            note(spec, DISABLED)
            continue
        df, error = probe(spec)
        if df is None:
            note(spec, FAILED, error)
            continue
        note(spec, LOADED)
        source = Source(name, spec.source_type, spec.table_name, df)
        return source.staged() if stage and spec.format == "jdbc" else source, log
    if fallback is None:
        tried = "; ".join(f"{entry['source_type']}: {entry['error'] or entry['status']}" for entry in log)
        raise ValueError(f"no source of {name} works ({tried})")
    source = fallback()
    note(source, FALLBACK)
    return source, log


def log_table(spark: SparkSession, entries: Sequence[dict]) -> DataFrame:
    """Log entries as (name, source_type, table_name, status, error)."""
    return spark.createDataFrame(pa.Table.from_pylist(list(entries), schema=_LOG))


def load_catalog(spark: SparkSession, candidates: Mapping[str, Sequence[SourceSpec]],
                 fallbacks: Mapping[str, Callable[[], Source]] | None = None,
                 environment: Mapping[str, str] = os.environ, stage: bool = False, probes: int = 1) -> tuple[dict[str, Source], DataFrame]:
    """Load every logical table; returns the sources and the log as a DataFrame. ``probes`` as in ``first_available``, over all tables."""
    sources, entries = {}, []
    enabled = [spec for specs in candidates.values() for spec in specs if spec.enabled]
    with _probing(spark, enabled, environment, probes) as probe:
        for name, specs in candidates.items():
            sources[name], log = _chosen(name, specs, probe, (fallbacks or {}).get(name), stage)
            entries += log
    return sources, log_table(spark, entries)


def load_report(sources: Sequence[Source]) -> DataFrame:
    """Rows and columns of every source. Counting reads no column: Parquet answers from footers."""
    def line(source: Source) -> DataFrame:
        return source.df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(source.name).alias("source_name"), F.lit(source.source_type).alias("source_type"),
            F.lit(source.table_name).alias("table_name"), F.lit(source.is_synthetic).alias("is_synthetic"),
            "rows", F.lit(len(source.df.columns)).alias("columns"))

    return union_all([line(source) for source in sources])
