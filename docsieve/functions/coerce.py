"""Turning incoming values into values of a field type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.dates import naive
from docsieve.schema import SPARK_TYPES

# What counts as a date, a number, an integer and a link in text. Text that looks like a code
# (a leading zero) is no number.
ISO_DATE = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][+-]?\d+)?$"
URL = r"^https?://\S+$"
_OFFSET = r"[T ]\d{2}:\d{2}.*([+-])(\d{2}):?(\d{2})$"
_WITHOUT_ZONE = r"^(\d{4}-\d{2}-\d{2}(?:[T ][\d:.]+)?)"


def _local_date(text: Column) -> Column:
    return F.when(text.rlike(ISO_DATE), F.regexp_extract(text, _WITHOUT_ZONE, 1)).try_cast(T.TimestampNTZType())


def is_date(text: Column) -> Column:
    return _local_date(text).isNotNull()


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER), F.lit(False))


def is_integer(text: Column) -> Column:
    number = coerce_number(text)
    return F.coalesce(number == F.floor(number), F.lit(False))


def is_boolean(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "false", "1", "0"), F.lit(False))


def coerce_date(text: Column) -> Column:
    """ISO 8601 text to a timestamp in UTC; null where it is no date of the years 1 to 9999."""
    text = text.cast("string")
    local = _local_date(text)
    sign = F.regexp_extract(text, _OFFSET, 1)
    hours, minutes = (F.regexp_extract(text, _OFFSET, i).try_cast("int") for i in (2, 3))
    offset = F.make_dt_interval(F.lit(0), hours, minutes)
    return F.when(sign == "+", local - offset).when(sign == "-", local + offset).otherwise(local)


def coerce_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text).try_cast("double")


def coerce_integer(text: Column) -> Column:
    """Whole numbers only; ``3.0`` is one, ``3.5`` is not."""
    number = coerce_number(text)
    whole = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
    return F.coalesce(whole, F.when(number == F.floor(number), number).try_cast("bigint"))


def coerce_boolean(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered.isin("true", "1"), F.lit(True)).when(lowered.isin("false", "0"), F.lit(False))


def coerce_text(value: Column) -> Column:
    return value.cast("string")


def coerce_tag(value: Column, dtype: T.DataType) -> Column:
    """A list becomes a list of strings, a single value a list of one."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: v.cast("string"))
    return F.when(value.isNotNull(), F.array(value.cast("string")))


COERCERS = {
    "date": coerce_date,
    "number": coerce_number,
    "integer": coerce_integer,
    "boolean": coerce_boolean,
}

CHECKS = {
    "date": is_date,
    "number": is_number,
    "integer": is_integer,
    "boolean": is_boolean,
}


def stored_value(value: Column, dtype: T.DataType, field_type: str) -> Column:
    """The value as it is stored in a field of that type. A value that cannot be stored fails the job."""
    target = SPARK_TYPES[field_type]
    if isinstance(dtype, T.NullType):
        return value.cast(target)
    if field_type == "tag":
        return coerce_tag(value, dtype)
    if field_type == "date":
        if not isinstance(dtype, T.StringType):
            return naive(value)
        parsed = coerce_date(value)
        broken = F.raise_error(F.concat(F.lit("invalid date: "), value)).cast(target)
        return F.when(value.isNotNull() & parsed.isNull(), broken).otherwise(parsed)
    if field_type == "boolean" and isinstance(dtype, T.StringType):
        return value != ""
    if field_type == "boolean" and isinstance(dtype, T.NumericType):
        return value != 0
    if field_type in ("object", "vector", "geo_point"):
        return F.to_json(value) if field_type == "object" and not isinstance(dtype, T.StringType) else value
    return value.cast(target)
