"""Column profiles: one row per (source, column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from covermap import fixed_values as fixed
from covermap.functions import patterns
from covermap.operators.bitmaps import Bitmaps, bitmap_tally, bitmaps_of, dense_ranges
from covermap.operators.columns import list_columns
from covermap.operators.samples import samples_of
from covermap.operators.tally import approx_tally, checked_tally, distinct_values, exact_tally, null_tally
from covermap.operators.unions import union_all
from covermap.plans.checkpointing import keep
from covermap.sources.spec import Source

_TALLIES = {"approx": approx_tally, "checked": checked_tally, "none": null_tally}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def count_columns(sources: Sequence[Source], distinct: str = "exact", bitmaps: bool = False) -> DataFrame:
    """The column listing with the whole-number counts ``rows``, ``nulls`` and ``distincts``; ways to count as in ``profile_catalog``."""
    return _counted(sources, distinct, *_values_seen(sources, distinct == "exact", bitmaps))


def _values_seen(sources: Sequence[Source], wanted: bool, bitmaps: bool) -> tuple[DataFrame | None, Bitmaps | None]:
    """The distinct values of all columns, dense ones as bitmaps if asked for."""
    if not wanted:
        return None, None
    dense = bitmaps_of(sources, dense_ranges(sources)) if bitmaps else None
    return distinct_values(sources, dense.lowest if dense else ()), dense


def _counted(sources: Sequence[Source], distinct: str, values: DataFrame | None, dense: Bitmaps | None) -> DataFrame:
    counts = ["rows", "nulls"] if distinct == "none" else ["rows", "nulls", "distincts"]
    if distinct == "exact":
        tally = exact_tally(values).unionByName(bitmap_tally(dense)) if dense else exact_tally(values)
    else:
        tally = _TALLIES[distinct](sources)
    return list_columns(sources).join(tally, "slot", "left").fillna(0, counts)


def profile_catalog(sources: Sequence[Source], distinct: str = "exact", samples: bool = True, bitmaps: bool = False) -> DataFrame:
    """Profile every column of every source.

    ``distinct="approx"`` needs no shuffle but may flip ``is_probable_id`` near its threshold; ``distinct="checked"`` counts
    the columns where it could exactly. Both leave the counts of all others estimated.
    ``distinct="none"`` counts only nulls: ``cardinality_ratio`` is null, and so is ``is_probable_id`` unless the name
    says true. With exact counts, samples come from the counts' own shuffle, and only texts are scanned a second time.
    ``bitmaps`` counts dense whole numbers and dates by bitmaps: they are scanned once more beforehand, for their ranges, and by
    themselves, and shuffle a bit per value. ``samples=False`` leaves ``sample_values`` empty.
    """
    values_seen, dense = _values_seen(sources, distinct == "exact" or samples, bitmaps)
    counted = _counted(sources, distinct, values_seen, dense)
    cardinality = _share(F.col("distincts"), F.col("rows"))
    no_values = F.array().cast("array<string>")
    if samples:
        # Sample values can be whole documents, so their side is never broadcast.
        counted = counted.join(samples_of(values_seen, sources, bitmaps=dense).hint("merge"), "slot", "left")
        values = F.coalesce("sample_values", no_values)
    else:
        values = no_values
    return counted.select(
        "source_name", "source_type", "table_name", "column", "dtype",
        F.round(_share(F.col("nulls"), F.col("rows")), fixed.RATIO_DIGITS).alias("null_ratio"),
        F.round(cardinality, fixed.RATIO_DIGITS).alias("cardinality_ratio"),
        "is_probable_datetime",
        patterns.probable_id(F.col("column"), cardinality, F.col("distincts")).alias("is_probable_id"),
        "is_probable_pii",
        values.alias("sample_values"),
    )


def profile_table(df: DataFrame, source_name: str, source_type: str, table_name: str, **options) -> DataFrame:
    """Profile one DataFrame."""
    return profile_catalog([Source(source_name, source_type, table_name, df)], **options)


def profile_in_batches(sources: Sequence[Source], tables: int = 50, **options) -> DataFrame:
    """``profile_catalog`` for very large catalogs: so many tables at a time, each batch kept in the shared folder.

    Plans stay small, and a failure later on does not cost the batches before it.
    """
    return union_all([keep(profile_catalog(sources[start:start + tables], **options))
                      for start in range(0, len(sources), tables)])
