"""covermap: what are these tables ready for?

Profile the columns of a catalog, map them to business concepts, and score scenario templates
by the share of their required concepts that is at hand. Every step takes and gives DataFrames.
"""

from covermap.operators.bitmaps import dense_ranges
from covermap.operators.columns import list_columns, only_columns
from covermap.operators.concepts import (
    available_concepts, map_concepts, match_rules, suggest, unmatched_columns)
from covermap.operators.profile import count_columns, profile_catalog, profile_in_batches, profile_table
from covermap.operators.samples import lowest_values
from covermap.operators.scoring import (
    gap_report, match_needs, needed_concepts, rank_scenarios, readiness_label, scenario_cards, scopes_without,
    score_templates)
from covermap.plans.advice import Advice, advise
from covermap.plans.checkpointing import drop_kept, keep
from covermap.plans.defaults import concept_rules, concept_suggestions, scenario_templates
from covermap.sources.ranges import equi_depth_bounds, range_predicates
from covermap.sources.reading import first_available, load_catalog, load_report, read
from covermap.sources.sinks import save
from covermap.sources.spec import Source, SourceSpec
from covermap.sources.statistics import statistics_session
from covermap.sources.synthetic import synthetic_fallbacks, synthetic_source
from covermap.sources.systems import Split, default_candidates, system_spec

__all__ = [
    "Advice", "Source", "SourceSpec", "Split", "advise", "available_concepts", "concept_rules", "concept_suggestions",
    "count_columns", "default_candidates", "dense_ranges", "drop_kept", "equi_depth_bounds", "first_available", "gap_report", "keep", "list_columns", "load_catalog",
    "load_report", "lowest_values", "map_concepts", "match_needs", "match_rules", "needed_concepts",
    "only_columns", "profile_catalog", "profile_in_batches", "profile_table", "range_predicates", "rank_scenarios", "read", "readiness_label", "save",
    "scenario_cards", "scenario_templates", "scopes_without", "score_templates", "statistics_session", "suggest", "synthetic_fallbacks",
    "synthetic_source", "system_spec", "unmatched_columns",
]
