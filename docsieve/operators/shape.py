"""Shaping bucket rows for tables and charts, and going back from a bucket to its documents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import dates
from docsieve.functions.text import labelled
from docsieve.operators.aggregate import QUERY, Axis
from docsieve.operators.filters import Filter, select, time_span
from docsieve.schema import fields_of
from docsieve.session import keep

TOP_COLUMNS = 10


def top_columns(buckets: DataFrame, column_axis: str, target: str = "n", k: int = TOP_COLUMNS) -> DataFrame:
    """The ``k`` values of the second axis with the largest sums."""
    totals = buckets.groupBy(column_axis).agg(F.sum(target).alias("sum"))
    return totals.orderBy(F.desc("sum"), column_axis).limit(k)


def keep_top_columns(buckets: DataFrame, column_axis: str, target: str = "n", k: int = TOP_COLUMNS) -> DataFrame:
    """Bucket rows of the top columns only, before a pivot widens them. The buckets are counted once and kept."""
    buckets = keep(buckets, "buckets")
    # At most k rows, so this side is always small enough to send everywhere.
    top = F.broadcast(top_columns(buckets, column_axis, target, k).select(column_axis))
    return buckets.join(top, column_axis, "left_semi")


def pivot_wide(
    buckets: DataFrame,
    row_axis: str,
    column_axis: str,
    columns: Sequence[Any] | None = None,
    target: str = "n",
) -> DataFrame:
    """The second axis becomes columns; missing cells are 0. Without a column list all values are taken, those with the
    largest sums first; `keep_top_columns` cuts them before. Spark refuses more than ``spark.sql.pivotMaxValues``."""
    if columns is None:
        buckets = keep(buckets, "buckets")
        most = int(buckets.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        columns = [row[0] for row in top_columns(buckets, column_axis, target, most + 1).collect()]
        if len(columns) > most:
            raise ValueError(f"more than {most} values on {column_axis!r}")
    wide = buckets.groupBy(row_axis).pivot(column_axis, list(columns)).agg(F.sum(target))
    return wide.na.fill(0, subset=[str(c) for c in columns])


def _filled(domain: DataFrame, buckets: DataFrame, axis: str) -> DataFrame:
    values = [c for c in buckets.columns if c != axis]
    return domain.join(buckets, axis, "left").na.fill(0, subset=values).select(axis, *values)


def zero_fill_dates(buckets: DataFrame, axis: str, interval: str) -> DataFrame:
    """Add empty buckets between the first and the last. The buckets are counted once and kept."""
    if interval not in dates.STEPS:
        raise ValueError(f"no steps for interval {interval!r}")
    buckets = keep(buckets, "buckets")
    day = F.col(axis).cast("date")
    step = F.expr(f"interval {dates.STEPS[interval]}")
    ends = buckets.agg(F.min(day).alias("first"), F.max(day).alias("last")).where("first is not null")
    days = ends.select(F.explode(F.sequence("first", "last", step)).alias(axis))
    return _filled(days.withColumn(axis, F.col(axis).cast(buckets.schema[axis].dataType)), buckets, axis)


def zero_fill_parts(buckets: DataFrame, axis: str, part: str) -> DataFrame:
    """Add missing months, weekdays or dayparts; years or decades between the first and the last, for which the buckets
    are counted once and kept."""
    spark, dtype = buckets.sparkSession, buckets.schema[axis].dataType
    fixed = {"monthnr": range(1, 13), "dayofweek": dates.WEEKDAYS, "daypart": dates.DAYPARTS}
    if part in fixed:
        domain = spark.createDataFrame([(v,) for v in fixed[part]], [axis])
    elif part in ("yearnr", "decade"):
        buckets = keep(buckets, "buckets")
        ends = buckets.agg(F.min(axis).alias("first"), F.max(axis).alias("last")).where("first is not null")
        step = F.lit(10 if part == "decade" else 1)
        domain = ends.select(F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"), step)).alias(axis))
    else:
        return buckets
    return _filled(domain.withColumn(axis, F.col(axis).cast(dtype)), buckets, axis)


def label_parts(buckets: DataFrame, axis: str, part: str) -> DataFrame:
    """Month names for month numbers, and a ``rank`` that puts parts in calendar order."""
    return buckets.withColumns(
        {"rank": dates.part_rank(F.col(axis), part), axis: dates.label_parts(F.col(axis), part)}
    )


def in_part_order(buckets: DataFrame, axis: str, part: str) -> DataFrame:
    return label_parts(buckets, axis, part).orderBy("rank").drop("rank")


def _sum_of(columns: Sequence[str]):
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def sort_by_total(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows by the sum of their columns, largest first."""
    others = [F.col(c) for c in wide.columns if c not in columns]
    return wide.orderBy(_sum_of(columns).desc(), *others)


def column_stats(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: its sum, and the smallest and largest cell of the whole table."""
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]
    lows, highs = [F.min(c) for c in columns], [F.max(c) for c in columns]
    low = F.least(*lows) if len(columns) > 1 else lows[0]
    high = F.greatest(*highs) if len(columns) > 1 else highs[0]
    one = wide.agg(*sums, low.alias("low"), high.alias("high"))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"s{i}").alias("sum")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("c"), "low", "high").select("c.name", "c.sum", "low", "high")


def _bucket_end(start: dt.datetime, interval: str) -> dt.datetime:
    months = {"month": 1, "quarter": 3, "year": 12, "decade": 120}.get(interval)
    if months:
        total = start.year * 12 + start.month - 1 + months
        return start.replace(year=total // 12, month=total % 12 + 1)
    return start + {
        "minute": dt.timedelta(minutes=1),
        "hour": dt.timedelta(hours=1),
        "day": dt.timedelta(days=1),
        "week": dt.timedelta(days=7),
    }[interval]


def _start_of(value: Any, interval: str) -> dt.datetime:
    if interval == "decade":
        return dt.datetime(int(value), 1, 1)
    return time_span(value)[0]


def zoom_filter(value: Any, interval: str | None, existing: Any = None) -> Filter:
    """Filter on one field that gives the documents of a bucket; an existing range narrows it.

    Parts that recur (weekdays, month numbers ...) are refused, as they name no single stretch of time.
    """
    if interval is None:
        return Filter(values=[value])
    if interval not in (*dates.CALENDAR, "decade"):
        raise ValueError(f"cannot go back from a {interval} bucket to its documents")
    start = _start_of(value, interval)
    end, closed = _bucket_end(start, interval), False
    if existing is not None:
        spec = Filter.of(existing)
        lows = [time_span(spec.gte)[0]] if spec.gte is not None else []
        if spec.gt is not None:
            first, last = time_span(spec.gt)
            lows.append(last or first + dt.timedelta(microseconds=1))
        start = max([start, *lows])
        if spec.lt is not None:
            end = min(end, time_span(spec.lt)[0])
        if spec.lte is not None:
            first, last = time_span(spec.lte)
            if last is None and first < end:
                end, closed = first, True
            elif last is not None:
                end = min(end, last)
    return Filter(gte=start, lte=end) if closed else Filter(gte=start, lt=end)


def drill_down(
    df: DataFrame,
    axes: Sequence[str | Axis],
    bucket: Mapping[str, Any],
    queries=None,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Exactly the documents that were counted in a bucket."""
    fields, zoom, found = fields_of(df), {}, labelled(queries)
    for axis in map(Axis.of, axes):
        value = bucket[axis.label]
        if axis.field == QUERY:
            found = {value: found[value]}
        elif axis.interval is not None and fields[axis.field].type != "date":
            low, width = value, float(axis.interval)
            if isinstance(df.schema[axis.field].dataType, T.IntegralType) and width.is_integer():
                width = int(width)
            zoom[axis.field] = Filter(gte=low, lt=low + width)
        else:
            zoom[axis.field] = zoom_filter(value, axis.interval)
    # The bucket filter comes on top of the existing ones, so nothing that was left out before comes back.
    return select(select(df, None, filters), found, zoom)


# Shortest span, in days per wanted bucket, from which a coarser interval is used.
_SPANS = (("month", 30), ("quarter", 90), ("year", 365), ("decade", 3650))


def auto_interval(low: dt.datetime, high: dt.datetime, existing: Any = None, buckets: int = 20) -> str:
    """Interval that gives about ``buckets`` buckets between two moments, clipped by an existing filter."""
    if existing is not None:
        spec = Filter.of(existing)
        low = max([low, *[time_span(v)[0] for v in (spec.gt, spec.gte) if v is not None]])
        high = min([high, *[time_span(v)[0] for v in (spec.lt, spec.lte) if v is not None]])
    chosen = "day"
    for interval, days in _SPANS:
        if high - low > dt.timedelta(days=days * buckets):
            chosen = interval
    return chosen
