"""How a value is tested for null, keyed for exact distinct counting, ordered and shown.

A profile applies these to every column of a catalog, so they are written as SQL expressions:
one ``selectExpr`` then carries a whole table instead of many calls per column. ``value`` is
always a name or expression that is safe to paste, such as the positional names of a scan.
"""

from __future__ import annotations

from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DAY_MICROS = 86_400_000_000
# A longer text is keyed by this many of its first characters and its SHA-256: equal exactly when the texts are, in
# order as far as the first characters tell, and short however long the text is.
HEAD_CHARACTERS = 32
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_NEVER_ORDERED = (T.VariantType, T.CalendarIntervalType)
_JSON_OPTIONS = (
    "map('timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\","
    " 'timestampNTZFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, _NESTED)


def _contains(data_type: T.DataType, kinds: tuple) -> bool:
    if isinstance(data_type, T.ArrayType):
        inner = [data_type.elementType]
    elif isinstance(data_type, T.MapType):
        inner = [data_type.keyType, data_type.valueType]
    elif isinstance(data_type, T.StructType):
        inner = [field.dataType for field in data_type.fields]
    else:
        inner = []
    return isinstance(data_type, kinds) or any(_contains(part, kinds) for part in inner)


def is_fixed_width(data_type: T.DataType) -> bool:
    """Whether the whole value goes into a key, in order: numbers, dates and times of at most eight bytes."""
    if isinstance(data_type, T.DecimalType):
        return data_type.precision <= 18
    return is_floating(data_type) or isinstance(
        data_type, (*_WHOLE, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _one_form(value: str, data_type: T.DataType, depth: int = 0) -> str:
    """Rewrite a nested value so that equal values look the same: map entries sorted, no -0.0."""
    item = f"x{depth}"
    if is_floating(data_type):
        return f"({value} + CAST(0 AS {data_type.simpleString()}))"
    if isinstance(data_type, T.ArrayType):
        return f"transform({value}, {item} -> {_one_form(item, data_type.elementType, depth + 1)})"
    if isinstance(data_type, T.MapType):
        key = _one_form(f"{item}.key", data_type.keyType, depth + 1)
        mapped = _one_form(f"{item}.value", data_type.valueType, depth + 1)
        entries = (f"transform(map_entries({value}), {item} -> "
                   f"named_struct('key', {key}, 'value', {mapped}))")
        return entries if _contains(data_type.valueType, _NEVER_ORDERED) else f"array_sort({entries})"
    if isinstance(data_type, T.StructType) and data_type.fields:
        parts = []
        for position, field in enumerate(data_type.fields):
            quoted = field.name.replace("`", "``")
            parts.append(f"'f{position}', " + _one_form(f"{value}.`{quoted}`", field.dataType, depth + 1))
        return f"IF({value} IS NULL, NULL, named_struct({', '.join(parts)}))"
    return value


def as_text(value: str, data_type: T.DataType) -> str:
    """The value as people read it."""
    if isinstance(data_type, T.BinaryType):
        return f"base64({value})"
    if isinstance(data_type, T.VariantType):
        return f"to_json({value})"
    if isinstance(data_type, _NESTED):
        return f"to_json({value}, {_JSON_OPTIONS})"
    return f"CAST({value} AS STRING)"


def as_whole(value: str, data_type: T.DataType) -> str:
    """A fixed-width value as a bigint, in its own order; ``from_key`` undoes it."""
    if isinstance(data_type, T.DateType):
        return f"CAST(unix_date({value}) AS BIGINT)"
    if isinstance(data_type, T.TimestampType):
        return f"unix_micros({value})"
    if isinstance(data_type, T.TimestampNTZType):
        # By its own calendar and clock, whatever the session's time zone.
        clock = f"CAST((hour({value}) * 3600 + minute({value}) * 60) AS BIGINT) * 1000000"
        return (f"(CAST(unix_date(CAST({value} AS DATE)) AS BIGINT) * {_DAY_MICROS} + {clock}"
                f" + CAST(extract(SECOND FROM {value}) * 1000000 AS BIGINT))")
    if isinstance(data_type, T.DecimalType) and data_type.scale:
        return f"CAST({value} * CAST('1{'0' * data_type.scale}' AS DECIMAL({data_type.scale + 1}, 0)) AS BIGINT)"
    return f"CAST({value} AS BIGINT)"


def from_key(whole: str, real: str, data_type: T.DataType) -> str:
    """The text of a fixed-width value from its key."""
    if is_floating(data_type):
        return f"CAST(CAST({real} AS {data_type.simpleString()}) AS STRING)"
    if isinstance(data_type, T.BooleanType):
        return f"CAST({whole} = 1 AS STRING)"
    if isinstance(data_type, T.DateType):
        return f"CAST(date_from_unix_date(CAST({whole} AS INT)) AS STRING)"
    if isinstance(data_type, T.TimestampType):
        return f"CAST(timestamp_micros({whole}) AS STRING)"
    if isinstance(data_type, T.TimestampNTZType):
        days = f"CAST(floor({whole} / CAST({_DAY_MICROS} AS DECIMAL(20, 0))) AS INT)"
        seconds = f"CAST(pmod({whole}, {_DAY_MICROS}) AS DECIMAL(20, 0)) / 1000000"
        return (f"CAST(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval({days}, 0, 0,"
                f" CAST({seconds} AS DECIMAL(18, 6))) AS STRING)")
    if isinstance(data_type, T.DecimalType):
        scaled = f"CAST({whole} AS DECIMAL(20, 0))"
        if data_type.scale:
            scaled += f" / CAST('1{'0' * data_type.scale}' AS DECIMAL({data_type.scale + 1}, 0))"
        return f"CAST(CAST({scaled} AS {data_type.simpleString()}) AS STRING)"
    return f"CAST({whole} AS STRING)"


def comparable_text(value: str, data_type: T.DataType) -> str:
    """A text that is equal exactly when two values are."""
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({_one_form(value, data_type)}, {_JSON_OPTIONS})"
    return as_text(value, data_type)


def is_collated(data_type: T.DataType) -> bool:
    """Texts that may be equal though their bytes differ."""
    return isinstance(data_type, T.StringType) and not data_type.isUTF8BinaryCollation()


def text_key(text: str) -> str:
    head = f"left({text}, {HEAD_CHARACTERS})"
    return f"IF(char_length({text}) <= {HEAD_CHARACTERS}, {text}, concat({head}, sha2(CAST({text} AS BINARY), 256)))"


def distinct_key(value: str, data_type: T.DataType) -> tuple[str, str, str]:
    """Three expressions (bigint, double, string) that together are equal exactly when two values are equal.

    One of them is set for a present value and none for a null or NaN. Numbers, dates and times are the value itself, in
    its order. Other values go by their text, of which long ones travel as their head and SHA-256 (equal unless SHA-256
    collides), so a shuffle of keys never carries whole documents.
    """
    no_whole, no_real, no_text = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
    if isinstance(data_type, T.NullType):
        return f"CAST({value} AS BIGINT)", no_real, no_text
    if is_floating(data_type):
        return no_whole, f"IF(isnan({value}), NULL, CAST({value} AS DOUBLE))", no_text
    if is_fixed_width(data_type):
        return as_whole(value, data_type), no_real, no_text
    return no_whole, no_real, text_key(comparable_text(value, data_type))


def null_if_nan(value: str, data_type: T.DataType) -> str:
    """What a count counts. Nested values are tested one by one: a file's statistics are about their parts, not about them."""
    if is_nested(data_type):
        return f"IF({value} IS NULL, NULL, 1)"
    return f"IF(isnan({value}), NULL, {value})" if is_floating(data_type) else value
