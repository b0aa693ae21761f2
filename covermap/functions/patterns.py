"""Flags that follow from a column's name, type and distinct count."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from covermap import fixed_values as fixed


def _name_matches(name: Column, pattern: str) -> Column:
    return name.rlike(f"(?i){pattern}")


def is_datetime_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def probable_datetime(name: Column, datetime_type: Column) -> Column:
    """True for a date or timestamp column, or a name that speaks of one."""
    return datetime_type | _name_matches(name, fixed.TIME_NAME)


def probable_id(name: Column, cardinality: Column, distinct: Column) -> Column:
    """True for an id-like name, or nearly all values distinct. ``cardinality`` must be unrounded.

    Without a distinct count (null) a name that says nothing leaves it unknown: null, not false.
    """
    nearly_unique = (cardinality > fixed.ID_CARDINALITY) & (distinct > fixed.ID_DISTINCT)
    return F.when(_name_matches(name, fixed.ID_NAME), True).otherwise(nearly_unique)


def probable_pii(name: Column) -> Column:
    """True for a name that speaks of personal data; the values are not looked at."""
    return _name_matches(name, fixed.PII_NAME)


def field_speaks_of_time(field: T.StructField) -> bool:
    """``probable_datetime`` for a schema field, to choose columns before anything is read."""
    return is_datetime_type(field.dataType) or bool(re.search(fixed.TIME_NAME, field.name, re.IGNORECASE))


def field_speaks_of_pii(field: T.StructField) -> bool:
    """``probable_pii`` for a schema field, to choose columns before anything is read."""
    return bool(re.search(fixed.PII_NAME, field.name, re.IGNORECASE))
