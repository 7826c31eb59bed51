"""Field filters and document selection.

Within one field all conditions are OR-ed, the bounds of one range are AND-ed, fields are AND-ed; labelled
queries are OR-ed and then AND-ed with filters and ids. Nothing given means every document.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.dates import PARTS
from docsieve.functions.text import InField, Word, all_true, any_true, match, match_any, where_matches, words_of
from docsieve.schema import ID, Field, fields_of

# Up to this many ids go into the plan as literals; more become a join, whose side Spark broadcasts if small.
MAX_LITERAL_IDS = 1000


@dataclass(frozen=True)
class Filter:
    values: Sequence[Any] | None = None
    gt: Any = None
    gte: Any = None
    lt: Any = None
    lte: Any = None
    exists: bool | None = None
    parts: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(spec: Any) -> Filter:
        """A filter from its shorthand: one value, a list of values, or a dict of conditions."""
        if isinstance(spec, Filter):
            return spec
        if isinstance(spec, Mapping):
            known = {"values", "gt", "gte", "lt", "lte", "exists"}
            parts = {k: v for k, v in spec.items() if k in PARTS}
            unknown = set(spec) - known - set(parts)
            if unknown:
                raise ValueError(f"unknown filter conditions: {sorted(unknown)}")
            return Filter(**{k: v for k, v in spec.items() if k in known}, parts=parts)
        return Filter(values=[spec] if isinstance(spec, str) else list(spec))


def id_list(typed: str) -> list[str]:
    """Ids from a pasted list, separated by commas or newlines."""
    return [part.strip() for part in re.split(r"[,\n]", typed) if part.strip()]


_MOMENT = re.compile(
    r"(?P<year>\d{4})(?:-(?P<month>\d{2})(?:-(?P<day>\d{2})"
    r"(?:[T ](?P<hour>\d{2})(?::(?P<minute>\d{2})(?::(?P<second>\d{2})(?P<fraction>[.,]\d+)?)?)?"
    r"(?P<zone>Z|[+-]\d{2}:?\d{2})?)?)?)?"
)


def time_span(value: Any) -> tuple[dt.datetime, dt.datetime | None]:
    """Start and end of the stretch of time a value names: a day for a date, a month for ``2018-02``,
    a single moment (end None) where it is exact. Zoned values are taken to UTC."""
    if isinstance(value, dt.datetime):
        exact = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        return exact, None
    if isinstance(value, dt.date):
        start = dt.datetime(value.year, value.month, value.day)
        return start, start + dt.timedelta(days=1)
    found = _MOMENT.fullmatch(str(value).strip())
    if not found:
        raise ValueError(f"{value!r} is not an ISO date")
    number = {k: int(v) for k, v in found.groupdict().items() if v and k not in ("fraction", "zone")}
    start = dt.datetime(number["year"], number.get("month", 1), number.get("day", 1),
                        number.get("hour", 0), number.get("minute", 0), number.get("second", 0))
    if found["fraction"]:
        start += dt.timedelta(microseconds=round(float("0." + found["fraction"][1:]) * 1e6))
    if found["zone"] and found["zone"] != "Z":
        zone = found["zone"].replace(":", "")
        offset = dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[3:5]))
        start -= offset if zone[0] == "+" else -offset
    if found["fraction"]:
        return start, None
    if "second" in number:
        return start, start + dt.timedelta(seconds=1)
    if "minute" in number:
        return start, start + dt.timedelta(minutes=1)
    if "hour" in number:
        return start, start + dt.timedelta(hours=1)
    if "day" in number:
        return start, start + dt.timedelta(days=1)
    if "month" in number:
        return start, dt.datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    return start, dt.datetime(start.year + 1, 1, 1)


def _time(value: dt.datetime, dtype: T.DataType) -> Column:
    # A cast string literal folds to a constant of the column's own type, which the scan can use.
    text = value.isoformat(sep=" ")
    if isinstance(dtype, T.DateType) and value.time() == dt.time():
        return F.lit(text[:10]).cast(dtype)
    if isinstance(dtype, T.TimestampType):
        return F.lit(f"{text}Z").cast(dtype)
    return F.lit(text).cast(T.TimestampNTZType())


def _time_bound(column: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    start, end = time_span(value)
    if op == "gte":
        return column >= _time(start, dtype)
    if op == "lt":
        return column < _time(start, dtype)
    if op == "gt":
        return column > _time(start, dtype) if end is None else column >= _time(end, dtype)
    return column <= _time(start, dtype) if end is None else column < _time(end, dtype)


def _literal(value: Any, settings: Field, dtype: T.DataType) -> Column:
    if settings.type in ("number", "integer"):
        if isinstance(value, str):
            value = float(value) if re.search(r"[.eE]", value) else int(value)
        return F.lit(value)
    if settings.type == "boolean":
        return F.lit(value if isinstance(value, bool) else str(value).lower() == "true")
    return F.lit(str(value))


def _values(df: DataFrame, name: str, settings: Field, values: Sequence[Any]) -> Column:
    column, dtype = F.col(name), df.schema[name].dataType
    if settings.type == "text":
        # An exact value is compared to single, lower-case words; anything else can never be one.
        one_word = [v for v in map(str, values) if words_of(v) == [v]]
        return any_true(match(df, InField(name, Word(v))) for v in one_word)
    if settings.type == "date":
        spans = [time_span(v) for v in values]
        return any_true(
            column == _time(a, dtype) if b is None else (column >= _time(a, dtype)) & (column < _time(b, dtype))
            for a, b in spans
        )
    literals = [_literal(v, settings, dtype) for v in values]
    if isinstance(dtype, T.ArrayType):
        return F.arrays_overlap(column, F.array(*literals))
    return column.isin(literals)


def _range(df: DataFrame, name: str, settings: Field, spec: Filter) -> Column | None:
    column, dtype = F.col(name), df.schema[name].dataType
    bounds = [(op, getattr(spec, op)) for op in ("gt", "gte", "lt", "lte") if getattr(spec, op) is not None]
    if not bounds:
        return None
    if settings.type == "date":
        return all_true(_time_bound(column, dtype, op, value) for op, value in bounds)
    compare = {
        "gt": lambda v: column > v,
        "gte": lambda v: column >= v,
        "lt": lambda v: column < v,
        "lte": lambda v: column <= v,
    }
    return all_true(compare[op](_literal(value, settings, dtype)) for op, value in bounds)


def field_condition(df: DataFrame, name: str, spec: Any) -> Column:
    """All conditions on one field, OR-ed."""
    settings = fields_of(df).get(name)
    if settings is None:
        raise ValueError(f"no such field: {name!r}")
    spec, column = Filter.of(spec), F.col(name)
    conditions = []
    if spec.values:
        conditions.append(_values(df, name, settings, spec.values))
    if spec.exists is not None:
        present = column.isNotNull()
        if isinstance(df.schema[name].dataType, T.ArrayType):
            present = present & (F.size(column) > 0)
        conditions.append(present if spec.exists else ~present)
    for part, value in spec.parts.items():
        conditions.append(PARTS[part](column) == F.lit(value))
    bounds = _range(df, name, settings, spec)
    if bounds is not None:
        conditions.append(bounds)
    return any_true(conditions) if conditions else F.lit(True)


def condition(df: DataFrame, queries=None, filters: Mapping[str, Any] | None = None) -> Column:
    """One Boolean Column for filters and queries; null where it cannot be decided, which a filter drops."""
    # Field filters come first: they are cheap and may reach the scan.
    parts = [field_condition(df, name, spec) for name, spec in (filters or {}).items()]
    if queries:
        parts.append(match_any(df, queries))
    return all_true(parts)


def _ids_frame(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(str(i),) for i in dict.fromkeys(ids)], f"{ID} string")


def select(
    df: DataFrame,
    queries=None,
    filters: Mapping[str, Any] | None = None,
    ids: Sequence[str] | str | DataFrame | None = None,
) -> DataFrame:
    """Documents that fit the queries, filters and ids. ``ids`` may also be a frame with an ``_id`` column."""
    if filters:
        df = df.where(condition(df, None, filters))
    if queries:
        df = where_matches(df, queries)
    if ids is None:
        return df
    if isinstance(ids, str):
        ids = id_list(ids)
    if isinstance(ids, DataFrame):
        return df.join(ids.select(ID), ID, "left_semi")
    if len(ids) <= MAX_LITERAL_IDS:
        return df.where(F.col(ID).isin([str(i) for i in ids]))
    return df.join(_ids_frame(df, ids), ID, "left_semi")


def mark_selected(
    df: DataFrame,
    name: str,
    queries=None,
    filters: Mapping[str, Any] | None = None,
    ids: Sequence[str] | str | DataFrame | None = None,
) -> DataFrame:
    """All documents, with a Boolean column telling which ones ``select`` would return; never null."""
    chosen = F.coalesce(condition(df, queries, filters), F.lit(False))
    if ids is None:
        return df.withColumn(name, chosen)
    if isinstance(ids, str):
        ids = id_list(ids)
    if not isinstance(ids, DataFrame) and len(ids) <= MAX_LITERAL_IDS:
        return df.withColumn(name, chosen & F.col(ID).isin([str(i) for i in ids]))
    listed = ids.select(ID).distinct() if isinstance(ids, DataFrame) else _ids_frame(df, ids)
    joined = df.join(listed.withColumn("__listed", F.lit(True)), ID, "left")
    return joined.withColumn(name, chosen & F.coalesce("__listed", F.lit(False))).drop("__listed")
