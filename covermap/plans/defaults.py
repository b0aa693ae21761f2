"""The built-in rules and templates as DataFrames, and ways to make your own."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from covermap import fixed_values as fixed

_RULES = pa.schema([("rule_order", pa.int32()), ("concept", pa.string()), ("keyword", pa.string())])
_TEMPLATES = pa.schema([
    ("template_order", pa.int32()), ("name", pa.string()), ("description", pa.string()),
    ("required_concepts", pa.list_(pa.string())), ("nice_to_have_concepts", pa.list_(pa.string())),
])
_SUGGESTIONS = pa.schema([("column", pa.string()), ("concept", pa.string())])


def concept_rules(spark: SparkSession, rules: Mapping[str, Sequence[str]] = fixed.CONCEPT_RULES) -> DataFrame:
    """(rule_order, concept, keyword), one row per keyword; earlier concepts win ties."""
    rows = [{"rule_order": order, "concept": concept, "keyword": keyword}
            for order, (concept, keywords) in enumerate(rules.items()) for keyword in keywords]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_RULES))


def scenario_templates(
    spark: SparkSession,
    templates: Iterable[tuple[str, str, Sequence[str], Sequence[str]]] = fixed.SCENARIO_TEMPLATES,
) -> DataFrame:
    """(template_order, name, description, required_concepts, nice_to_have_concepts)."""
    rows = [dict(zip(_TEMPLATES.names, (order, *template))) for order, template in enumerate(templates)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_TEMPLATES))


def concept_suggestions(spark: SparkSession, suggestions: Iterable[tuple[str, str]]) -> DataFrame:
    """(column, concept): concepts proposed for column names that no rule knows."""
    rows = [dict(zip(_SUGGESTIONS.names, pair)) for pair in suggestions]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_SUGGESTIONS))
