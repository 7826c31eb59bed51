"""Calendar buckets, date parts and number buckets. All work on timestamps without zone and need no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names in calendar and day order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAYPARTS = ("Morning", "Afternoon", "Evening", "Night")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

CALENDAR = ("minute", "hour", "day", "week", "month", "quarter", "year")
DATE_BUCKETS = ("day", "week", "month", "year")  # buckets given as a date, the others as a timestamp
# Intervals that a span of buckets can be counted through, and the length of each.
STEPS = {
    "day": "1 day",
    "week": "7 days",
    "month": "1 month",
    "quarter": "3 months",
    "year": "1 year",
}


def naive(ts: Column) -> Column:
    return ts.cast(T.TimestampNTZType())


def in_utc(ts: Column) -> Column:
    """A moment with zone as its time in UTC, without zone, whatever the session's zone is."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    start = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _day(ts: Column) -> Column:
    return ts.cast("date")


def dayofweek(ts: Column) -> Column:
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    return F.element_at(names, F.weekday(_day(ts)) + 1)


def daypart(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when(hour < 6, F.lit("Night"))
        .when(hour < 12, F.lit("Morning"))
        .when(hour < 18, F.lit("Afternoon"))
        .when(hour.isNotNull(), F.lit("Evening"))
    )


def monthnr(ts: Column) -> Column:
    return F.month(_day(ts))


def yearnr(ts: Column) -> Column:
    return F.year(_day(ts))


def decade(ts: Column) -> Column:
    year = F.year(_day(ts))
    return year - F.pmod(year, F.lit(10))


def dayofmonth(ts: Column) -> Column:
    return F.dayofmonth(_day(ts))


def weeknr(ts: Column) -> Column:
    return F.weekofyear(_day(ts))


PARTS = {
    "dayofweek": dayofweek,
    "daypart": daypart,
    "monthnr": monthnr,
    "yearnr": yearnr,
    "decade": decade,
    "dayofmonth": dayofmonth,
    "weeknr": weeknr,
}


def date_bucket(ts: Column, interval: str) -> Column:
    """Start of the calendar unit that holds ``ts``; weeks start on Monday."""
    if interval == "day":
        return _day(ts)
    if interval in ("week", "month", "year"):
        return F.trunc(_day(ts), interval)
    if interval == "quarter":
        return naive(F.trunc(_day(ts), "quarter"))
    if interval in ("hour", "minute"):
        minutes = F.minute(ts) if interval == "minute" else F.lit(0)
        return naive(_day(ts)) + F.make_dt_interval(F.lit(0), F.hour(ts), minutes, F.lit(0).cast("decimal(18,6)"))
    raise ValueError(f"unknown date interval {interval!r}")


def number_bucket(value: Column, dtype: T.DataType, width: str | int | float) -> Column:
    """Lower bound of the fixed-width bucket that holds ``value``; none for what is not a number."""
    width = float(width)
    if width <= 0:
        raise ValueError("a bucket needs a positive width")
    if isinstance(dtype, T.IntegralType) and width.is_integer():
        value = value.cast("bigint")
        return value - F.pmod(value, F.lit(int(width)).cast("bigint"))
    quotient = value / F.lit(width)
    # From 2 ** 53 on a quotient has no fraction, and beyond 2 ** 63 the floor would not fit its type.
    whole = F.when(F.abs(quotient) >= 2.0**53, quotient).otherwise(F.floor(quotient).cast("double"))
    return F.when(~F.isnan(quotient), whole * F.lit(width))


def micros(ts: Column) -> tuple[Column, Column]:
    """Days since 1970 and microseconds of the day; apart, both average without loss."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.datediff(_day(ts), F.lit("1970-01-01").cast("date")), seconds.cast("bigint") * 1_000_000 + fraction


def from_micros(value: Column) -> Column:
    days = F.floor(value / 86_400_000_000).cast("int")
    rest = value - days.cast("bigint") * 86_400_000_000
    start = naive(F.date_add(F.lit("1970-01-01").cast("date"), days))
    seconds = (rest.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def average(ts: Column) -> Column:
    """Mean of timestamps, as a timestamp."""
    days, rest = micros(ts)
    return from_micros(F.round(F.avg(days) * 86_400_000_000 + F.avg(rest)).cast("bigint"))


def label_parts(value: Column, part: str) -> Column:
    """Month number -> month name; other parts are their own label."""
    if part != "monthnr":
        return value.cast("string")
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), value.cast("int"))


def part_rank(value: Column, part: str) -> Column:
    """Sort key of a part: weekdays from Monday, dayparts from Morning, numbers by size."""
    names = {"dayofweek": WEEKDAYS, "daypart": DAYPARTS}.get(part)
    if names is None:
        return value.cast("int")
    return F.array_position(F.array(*[F.lit(n) for n in names]), value).cast("int")
