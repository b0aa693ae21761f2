"""The whole way in one call: sources, profile, concepts, scored scenarios, checklist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from covermap.operators.concepts import available_concepts, map_concepts
from covermap.operators.profile import profile_catalog
from covermap.operators.scoring import gap_report, rank_scenarios, scenario_cards, score_templates
from covermap.plans.checkpointing import keep
from covermap.plans.defaults import concept_rules, scenario_templates
from covermap.sources.spec import Source


@dataclass(frozen=True)
class Advice:
    """The result of each step; every field but a kept ``profile`` is lazy."""

    profile: DataFrame
    concept_map: DataFrame
    available: DataFrame
    scored: DataFrame
    ranking: DataFrame
    gaps: DataFrame
    cards: DataFrame


def advise(sources: Sequence[Source], rules: DataFrame | None = None, templates: DataFrame | None = None,
           suggestions: DataFrame | None = None, kept: bool = True, **profile_options) -> Advice:
    """Profile once, then map, score and report from the kept profile; ``kept=False`` leaves the profile lazy."""
    spark = sources[0].df.sparkSession
    rules = concept_rules(spark) if rules is None else rules
    templates = scenario_templates(spark) if templates is None else templates
    profile = profile_catalog(sources, **profile_options)
    profile = keep(profile) if kept else profile
    concept_map = map_concepts(profile, rules, suggestions)
    available = available_concepts(concept_map)
    scored = score_templates(templates, available)
    ranking = rank_scenarios(scored).select("name", "coverage_pct", "readiness", "missing_required")
    return Advice(profile, concept_map, available, scored, ranking,
                  gap_report(scored).select("name", "gap"), scenario_cards(scored))
