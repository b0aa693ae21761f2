"""The registered queries: every operator run over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from checks.controls import ALIGNED_RULES, SUGGESTIONS, TEMPLATES
from checks.tables import MISSING, RANGED, catalog, catalog_with_gaps, read_table
from covermap import fixed_values as fixed
from covermap.operators.concepts import (
    RULE, SUGGESTED, available_concepts, map_concepts, suggest, unmatched_columns)
from covermap.operators.profile import count_columns, profile_catalog, profile_table
from covermap.operators.scoring import (
    gap_report, match_needs, rank_scenarios, readiness_label, scenario_cards, scopes_without, score_templates)
from covermap.operators.unions import union_all
from covermap.plans.advice import advise
from covermap.plans.defaults import concept_rules, concept_suggestions, scenario_templates
from covermap.sources.ranges import equi_depth_bounds, range_predicates
from covermap.sources.reading import first_available, load_report, log_table
from covermap.sources.sinks import REPLACE, save
from covermap.sources.spec import Source, SourceSpec
from covermap.sources.statistics import statistics_session
from covermap.sources.synthetic import synthetic_source

Query = Callable[[SparkSession, str], DataFrame]
_RATIOS = ["null_ratio", "cardinality_ratio"]


def _joined(values: str) -> Column:
    return F.array_join(values, " | ").alias(values)


def _shown_alike(sources: list[Source]) -> list[Source]:
    """Arrays of floats as whole millionths, which both engines print alike; all else as it is."""
    def shown(source: Source) -> Source:
        whole = {field.name: F.transform(field.name, lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint"))
                 for field in source.df.schema.fields if field.dataType.simpleString() == "array<float>"}
        return replace(source, df=source.df.withColumns(whole)) if whole else source
    return [shown(source) for source in sources]


# ---- sources ----

def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_report(catalog(spark, sf_dir))


def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disabled and a broken candidate come first; the third is read."""
    candidates = [
        SourceSpec("postgres", "orders", "jdbc", table="orders", enabled=False),
        SourceSpec("onelake", "orders", "parquet", path=f"{sf_dir}/Tables/orders"),
        SourceSpec("parquet", "orders", "parquet", path=f"{sf_dir}/orders.parquet"),
    ]
    source, log = first_available(spark, "orders", candidates, lambda: synthetic_source(spark, "orders"))
    report = load_report([source]).withColumn("status", F.lit(log[-1]["status"]))
    tried = log_table(spark, log[:-1]).select(F.col("name").alias("source_name"), "source_type", "status")
    return tried.unionByName(report.drop("table_name", "is_synthetic"), allowMissingColumns=True)


def sample_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row cap is the operator here: the first 2000 orders by key, profiled."""
    capped = [s.sample_rows(2000, ["o_orderkey"]) for s in catalog(spark, sf_dir, "orders")]
    return profile_catalog(capped).select("column", *_RATIOS, "is_probable_id", _joined("sample_values"))


def equi_depth_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether eight ranges of equal depth hold every row of a table once, and none holds more than its share of rows or one key's."""
    def line(name: str, column: str) -> DataFrame:
        rows = read_table(spark, sf_dir, name)
        conditions = range_predicates(column, equi_depth_bounds(rows, column, 8))
        met = sum((F.expr(condition).cast("int") for condition in conditions), F.lit(0))
        number = F.coalesce(*[F.when(F.expr(condition), F.lit(place)) for place, condition in enumerate(conditions)])
        # Counted by key first, so that a range's largest key is known.
        keys = rows.select(F.col(column).alias("key"), met.alias("met"), number.alias("number")).groupBy("key", "met", "number").agg(
            F.count(F.lit(1)).alias("n"))
        ranges = keys.groupBy("number").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.min("met").alias("least"), F.max("met").alias("most"))
        return ranges.agg(
            F.lit(name).alias("source_name"), F.lit(column).alias("column"), F.sum("n").alias("rows"),
            ((F.min("least") == 1) & (F.max("most") == 1)).alias("whole"),
            (F.max(F.col("n") - F.col("largest")) <= F.sum("n") / 8 * 1.5).alias("even"))

    return union_all([line(name, column) for name, column in RANGED])


def saved_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ratios of all tables, saved by table; then those of the tables with gaps again, into their own partitions only."""
    def ratios_of(sources: list[Source]) -> DataFrame:
        return profile_catalog(sources, distinct="none", samples=False).select("source_name", "column", "null_ratio")

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/saved-{uuid.uuid4().hex}"
    save(ratios_of(catalog(spark, sf_dir)), path, mode=REPLACE, partition_by=["source_name"])
    for _ in range(2):
        save(ratios_of(catalog_with_gaps(spark, sf_dir, *MISSING)), path, mode=REPLACE, partition_by=["source_name"])
    return spark.read.parquet(path).select("source_name", "column", "null_ratio")


# ---- profile ----

def whole_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all columns. Floats print differently in the two engines, so arrays show how many samples they have."""
    samples = F.when(F.col("dtype") == "array<float>", F.concat(F.size("sample_values"), F.lit(" samples"))).otherwise(
        F.array_join("sample_values", " | "))
    return profile_catalog(catalog(spark, sf_dir)).withColumn("sample_values", samples)


def one_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalog(spark, sf_dir, "lineitem")[0].df
    profile = profile_table(df, "lineitem", "parquet", "lineitem")
    return profile.withColumn("sample_values", _joined("sample_values"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense whole numbers and dates by bitmaps, all else by its values."""
    return count_columns(catalog_with_gaps(spark, sf_dir), bitmaps=True).select(
        "source_name", "column", "rows", "nulls", "distincts")


def null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers and texts that are stored as they are answer from the files' footers, all others are read."""
    sources = catalog_with_gaps(statistics_session(spark), sf_dir)
    return profile_catalog(sources, distinct="none", samples=False).select("source_name", "column", "null_ratio")


def bitmap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest values of all columns, those of dense ones from their bitmaps."""
    sources = _shown_alike(catalog_with_gaps(spark, sf_dir))
    return profile_catalog(sources, bitmaps=True).select("source_name", "column", *_RATIOS, _joined("sample_values"))


def checked_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id flag of every column, from sketches, and from exact counts where a sketch could be wrong."""
    return profile_catalog(catalog_with_gaps(spark, sf_dir), distinct="checked", samples=False).select(
        "source_name", "column", "null_ratio", "is_probable_id")


def ratios(name: str, distinct: str) -> Query:
    return lambda spark, sf_dir: profile_catalog(
        catalog_with_gaps(spark, sf_dir), distinct=distinct, samples=False).select("source_name", "column", name)


def flagged(flag: str) -> Query:
    return lambda spark, sf_dir: profile_catalog(catalog_with_gaps(spark, sf_dir), samples=False).where(flag).select(
        "source_name", "column", *_RATIOS)


def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _shown_alike(catalog_with_gaps(spark, sf_dir))
    return profile_catalog(sources).select("source_name", "column", _joined("sample_values"))


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and null counts, and whether each estimate lies within six percent of the exact count."""
    sources = catalog_with_gaps(spark, sf_dir)
    exact = count_columns(sources).select("slot", F.col("distincts").alias("exact"))
    estimated = count_columns(sources, distinct="approx").join(exact, "slot")
    close = F.abs(F.col("distincts") - F.col("exact")) <= 0.06 * F.col("exact")
    return estimated.select("source_name", "column", "rows", "nulls", close.alias("within_error"))


# ---- concepts ----

def _concept_map(spark: SparkSession, sf_dir: str, suggestions: bool = False, rules=ALIGNED_RULES,
                 distinct: str = "none", samples: bool = False) -> DataFrame:
    """The mapped profile. Concepts and scores use its null ratios; ``advice`` takes the whole profile."""
    sources = catalog_with_gaps(spark, sf_dir)
    profile = profile_catalog(_shown_alike(sources) if samples else sources, distinct=distinct, samples=samples)
    offered = concept_suggestions(spark, SUGGESTIONS) if suggestions else None
    return map_concepts(profile, concept_rules(spark, rules), offered)


def concept_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _concept_map(spark, sf_dir, suggestions=True, distinct="exact", samples=True).withColumn(
        "sample_values", _joined("sample_values"))


def _guess(name: str, samples: list[str]) -> str | None:
    """Stands for an outside service: a concept from the name's last part, none for names without parts."""
    return f"{name.rsplit('_', 1)[1]}:{len(samples)}" if "_" in name else None


def suggested_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that no rule knows, asked of a function of name and samples."""
    mapped = _concept_map(spark, sf_dir, samples=True, distinct="exact")
    return suggest(unmatched_columns(mapped), _guess, kept=False)


def matched_by(kind: str) -> Query:
    return lambda spark, sf_dir: _concept_map(spark, sf_dir, suggestions=kind == SUGGESTED).where(
        F.col("matched_by") == kind).select("source_name", "column", "business_concept", "null_ratio")


def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available_concepts(_concept_map(spark, sf_dir))


# ---- scenarios ----

def _scored(spark: SparkSession, sf_dir: str, rules=ALIGNED_RULES) -> DataFrame:
    concepts = available_concepts(_concept_map(spark, sf_dir, rules=rules))
    return score_templates(scenario_templates(spark, TEMPLATES), concepts)


def needs(required: bool, have: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        matched = match_needs(scenario_templates(spark, TEMPLATES), available_concepts(_concept_map(spark, sf_dir)))
        chosen = matched.where((F.col("required") == required) & (F.col("have") == have))
        return chosen.select("name", "concept", "columns", "null_ratio")
    return run


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "name", "coverage_pct", "required_null_ratio", F.array_join("matched_required", ", ").alias("matched"),
        F.array_join("missing_required", ", ").alias("missing"), F.array_join("matched_nice", ", ").alias("nice"))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "name", "readiness", readiness_label(F.col("readiness")).alias("label"), "required_null_ratio")


def score_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _concept_map(spark, sf_dir)
    scored = score_templates(scenario_templates(spark, TEMPLATES), available_concepts(mapped, "source_name"), "source_name")
    return scored.select("source_name", "name", "coverage_pct", "readiness", "required_null_ratio",
                         F.array_join("missing_required", ", ").alias("missing"))


def scopes_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _concept_map(spark, sf_dir)
    return scopes_without(scenario_templates(spark, TEMPLATES), available_concepts(mapped, "source_name"), mapped,
                          "source_name").drop("template_order")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_report(_scored(spark, sf_dir)).select("name", "gap", "required_null_ratio")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_cards(_scored(spark, sf_dir))


def ranking(rules: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = Window.orderBy(F.desc("coverage_pct"), "template_order")
        return rank_scenarios(_scored(spark, sf_dir, rules)).select(
            F.row_number().over(place).alias("place"), "name", "coverage_pct", "readiness",
            F.array_join("missing_required", ", ").alias("missing"), "required_null_ratio")
    return run


def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: full profile of all tables, concepts with suggestions, scores, ranking, gaps and evidence."""
    sources = catalog_with_gaps(spark, sf_dir)
    result = advise(sources, concept_rules(spark, ALIGNED_RULES), scenario_templates(spark, TEMPLATES),
                    concept_suggestions(spark, SUGGESTIONS), kept=False)
    profiled = result.concept_map.groupBy("business_concept").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if("is_probable_id").alias("ids"),
        F.sum(F.size("sample_values")).alias("samples"), F.max("cardinality_ratio").alias("cardinality"))
    supplied = result.scored.select("name", F.explode_outer("matched_required").alias("business_concept"))
    evidence = supplied.join(profiled, "business_concept", "left").groupBy("name").agg(
        F.sum("columns").alias("columns"), F.sum("ids").alias("ids"), F.sum("samples").alias("samples"),
        F.max("cardinality").alias("cardinality"))
    ranked = result.ranking.join(result.gaps, "name").join(evidence, "name", "left")
    return ranked.select("name", "coverage_pct", "readiness", F.array_join("missing_required", ", ").alias("missing"), "gap",
                         "columns", "ids", "samples", "cardinality")


QUERIES: dict[str, Query] = {
    "load_report": load,
    "first_available": first_source,
    "equi_depth_ranges": equi_depth_ranges,
    "saved_again": saved_again,
    "sample_limit": sample_limit,
    "profile_catalog": whole_profile,
    "profile_table": one_profile,
    "distinct_count": counts,
    "null_ratio": null_ratio,
    "cardinality_ratio": ratios("cardinality_ratio", "exact"),
    "flag_datetime": flagged("is_probable_datetime"),
    "flag_id": flagged("is_probable_id"),
    "flag_pii": flagged("is_probable_pii"),
    "sample_values": sample_values,
    "bitmap_samples": bitmap_samples,
    "approx_distinct": approx_distinct,
    "checked_flags": checked_flags,
    "concept_map": concept_map,
    "concept_rules": matched_by(RULE),
    "concept_suggestions": matched_by(SUGGESTED),
    "suggested_by_function": suggested_by_function,
    "available_concepts": available,
    "matched_required": needs(required=True, have=True),
    "missing_required": needs(required=True, have=False),
    "matched_nice": needs(required=False, have=True),
    "coverage": coverage,
    "readiness": readiness,
    "score_by_scope": score_by_scope,
    "scopes_without": scopes_left,
    "gap_report": gaps,
    "scenario_cards": cards,
    "scenario_ranking": ranking(ALIGNED_RULES),
    "builtin_rules_ranking": ranking(fixed.CONCEPT_RULES),
    "advice": advice,
}
