"""Scenario templates scored by the share of their required concepts that is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from covermap import fixed_values as fixed

_TEMPLATE = ["template_order", "name", "description"]


def needed_concepts(templates: DataFrame) -> DataFrame:
    """One row per (template, needed concept), ``required`` true or false.

    A concept listed twice counts once, and a null is no concept. A template that needs nothing keeps one row.
    """
    def needs(column: str, required: bool) -> Column:
        wanted = F.coalesce(F.array_distinct(F.array_compact(column)), F.array())
        return F.transform(wanted, lambda concept: F.struct(
            concept.alias("concept"), F.lit(required).alias("required")))

    return templates.select(*_TEMPLATE, F.inline_outer(F.concat(
        needs("required_concepts", True), needs("nice_to_have_concepts", False))))


def _needs_per_scope(templates: DataFrame, available: DataFrame, scope: str) -> DataFrame:
    # A scope meets the templates with which it shares a concept, by equality of the concept.
    needed = needed_concepts(templates)
    pairs = available.select(scope, "concept").join(
        needed.select("template_order", "concept"), "concept").select(scope, "template_order").distinct()
    return pairs.join(needed, "template_order")


def match_needs(templates: DataFrame, available: DataFrame, scope: str | None = None) -> DataFrame:
    """The needed concepts, each with ``have``, and the evidence of ``available``.

    With ``scope``, a column of ``available`` whose null is a scope too, each scope is matched with its own concepts
    on the templates of which it has at least one; ``scopes_without`` tells about the others.
    """
    at_hand = available.withColumnRenamed("concept", "concept_at_hand")
    if scope is None:
        needs = needed_concepts(templates)
        same = F.col("concept") == F.col("concept_at_hand")
    else:
        needs = _needs_per_scope(templates, available, scope)
        at_hand = at_hand.withColumnRenamed(scope, "scope_at_hand")
        same = (F.col("concept") == F.col("concept_at_hand")) & F.col(scope).eqNullSafe(F.col("scope_at_hand"))
    return needs.join(at_hand, same, "left").withColumn("have", F.col("concept_at_hand").isNotNull()).drop(
        "concept_at_hand", "scope_at_hand")


def scopes_without(templates: DataFrame, available: DataFrame, scopes: DataFrame, scope: str) -> DataFrame:
    """(template_order, name, scopes, coverage_pct): how many scopes share no concept with a template.

    ``scopes`` is any DataFrame with the scope's column. All of them have the same coverage: none of what is
    needed, or all where nothing is.
    """
    total = scopes.select(scope).distinct().agg(F.count(F.lit(1))).scalar()
    shared = _needs_per_scope(templates, available, scope).select(scope, "template_order").distinct().groupBy(
        "template_order").agg(F.count(F.lit(1)).alias("sharing"))
    needs = needed_concepts(templates).groupBy("template_order", "name").agg(F.count_if(F.col("required")).alias("needed"))
    return needs.join(shared, "template_order", "left").select(
        "template_order", "name", (total - F.coalesce("sharing", F.lit(0))).alias("scopes"),
        F.when(F.col("needed") > 0, 0.0).otherwise(100.0).alias("coverage_pct"))


def _readiness(coverage: Column) -> Column:
    return (F.when(coverage >= fixed.READY_AT, "ready")
            .when(coverage >= fixed.PARTIAL_AT, "partial").otherwise("insufficient"))


def readiness_label(readiness: Column) -> Column:
    """The label people read for a readiness code."""
    label = F
    for code, text in fixed.READINESS.items():
        label = label.when(readiness == code, text)
    return label


def score_templates(templates: DataFrame, available: DataFrame, scope: str | None = None) -> DataFrame:
    """Score all templates against the concepts at hand, in one job.

    With ``scope``, each scope is scored on the templates with which it shares a concept.

    Where ``available`` carries null ratios, ``required_null_ratio`` tells the highest among the
    required concepts at hand: a scenario can be fully covered by columns that are mostly empty.
    """
    matched = match_needs(templates, available, scope)
    required, have = F.col("required"), F.col("have")

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("concept"))))

    measures = [
        F.count_if(required).alias("needed"), F.count_if(required & have).alias("found"),
        names(required & have).alias("matched_required"),
        names(required & ~have).alias("missing_required"),
        names(~required & have).alias("matched_nice"),
    ]
    evidence = []
    if "null_ratio" in available.columns:
        measures.append(F.max(F.when(required & have, F.col("null_ratio"))).alias("required_null_ratio"))
        evidence.append("required_null_ratio")
    keys = _TEMPLATE if scope is None else [scope, *_TEMPLATE]
    coverage = F.when(F.col("needed") > 0, F.col("found") / F.col("needed") * 100).otherwise(F.lit(100.0))
    return matched.groupBy(*keys).agg(*measures).withColumn("coverage", coverage).select(
        *keys, F.round("coverage", fixed.COVERAGE_DIGITS).alias("coverage_pct"),
        "matched_required", "missing_required", "matched_nice",
        _readiness(F.col("coverage")).alias("readiness"), *evidence)


def rank_scenarios(scored: DataFrame) -> DataFrame:
    """Best coverage first, within each scope if scores are per scope; equal ones in template order."""
    lead = scored.columns[:scored.columns.index("template_order")]
    return scored.orderBy(*lead, F.desc("coverage_pct"), "template_order")


def gap_text(name: Column, missing: Column) -> Column:
    return F.when(F.size(missing) == 0, F.format_string(fixed.GAP_NONE, name)).otherwise(
        F.format_string(fixed.GAP_MISSING, name, F.array_join(missing, ", ")))


def gap_report(scored: DataFrame) -> DataFrame:
    """Append ``gap``: one sentence per scenario on the data still missing."""
    return scored.withColumn("gap", gap_text(F.col("name"), F.col("missing_required")))


def scenario_cards(scored: DataFrame) -> DataFrame:
    """Name, coverage, readiness label, description and gap sentence of each scenario."""
    lead = scored.columns[:scored.columns.index("name")]
    evidence = [name for name in scored.columns if name == "required_null_ratio"]
    return gap_report(scored).select(
        *lead, "name", "coverage_pct", readiness_label(F.col("readiness")).alias("readiness"),
        "description", "gap", *evidence)
