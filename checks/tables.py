"""The given tables: names, columns, and the values that count as missing in the checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from covermap.sources.spec import Source

# The columns that the SQL names one by one, and which of them can hold NaN; queries read the files as they are.
TABLES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                 "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
             "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                 "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double",
                 "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
                 "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
               "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
                  "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}

# The given tables hold no nulls. For the null paths these values count as missing; a NaN is
# put in place of the value where "nan" says so. Conditions are SQL that both engines read.
MISSING = {
    "customer": {"c_acctbal": ("c_acctbal < 0", "null")},
    "part": {"p_type": ("p_type = 'ECONOMY'", "null")},
    "orders": {"o_totalprice": ("o_totalprice > 400000", "nan"),
               "o_orderpriority": ("o_orderpriority = '4-NOT SPECIFIED'", "null")},
    "lineitem": {"l_quantity": ("l_quantity = 1", "null"), "l_discount": ("l_discount = 0", "nan")},
    "events": {"user_id": ("event_type = 'error'", "null")},
    "labels": {"toxic": ("toxic = 0", "null")},
}

# Columns, skewed and even ones, whose tables are read in ranges of equal depth.
RANGED = (("lineitem", "l_orderkey"), ("orders", "o_orderdate"), ("events", "user_id"), ("customer", "c_acctbal"), ("pages", "url"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> list[Source]:
    """The named tables, or all of them, as sources."""
    return [Source(name, "parquet", name, read_table(spark, sf_dir, name)) for name in names or TABLES]


def catalog_with_gaps(spark: SparkSession, sf_dir: str, *names: str) -> list[Source]:
    """As ``catalog``, with the values of ``MISSING`` taken out."""
    sources = []
    for source in catalog(spark, sf_dir, *names):
        gaps = {
            column: F.when(~F.expr(condition), F.col(column)).otherwise(
                F.lit(float("nan")) if kind == "nan" else F.lit(None))
            for column, (condition, kind) in MISSING.get(source.name, {}).items()
        }
        df = source.df.withColumns(gaps) if gaps else source.df
        sources.append(replace(source, df=df, computed=tuple(gaps)))
    return sources
