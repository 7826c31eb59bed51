"""Counting and summarising documents over axes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import dates
from docsieve.functions.text import all_true, label_matches, labelled
from docsieve.operators.filters import select
from docsieve.operators.order import Sort, order_by
from docsieve.schema import ID, col, fields_of
from docsieve.session import keep

QUERY = "_query"
MAX_VALUES = 2000
# Estimated medians may be off by one rank in this many.
_PRECISION = 50_000
# Up to here Spark ranks inside each task before the shuffle.
MAX_HITS = 1000
# Fixed value: an answer stops after the page that takes it beyond this many buckets.
PAGE_BUCKETS = 1000


@dataclass(frozen=True)
class Axis:
    """What to count over: a field, a calendar or number interval of it, a date part, or ``_query``."""

    field: str
    interval: str | int | float | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or (f"{self.field}_{self.interval}" if self.interval is not None else self.field)

    @staticmethod
    def of(spec: str | Axis) -> Axis:
        return Axis(spec) if isinstance(spec, str) else spec


@dataclass(frozen=True)
class Metric:
    """A summary of a field: sum, avg, min, max, value_count, cardinality, median_absolute_deviation.

    All are exact. ``cardinality_estimate`` and ``median_absolute_deviation_estimate`` are bounded sketches of the last two.
    """

    field: str
    function: str
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"{self.function}_{self.field}"


@dataclass(frozen=True)
class TopHits:
    """The first ``n`` documents of each bucket, as an array of records."""

    fields: Sequence[str]
    sort: Any = None
    n: int = 1
    name: str = "tophits"

    def __post_init__(self) -> None:
        if not 1 <= self.n <= MAX_HITS:
            raise ValueError(f"between 1 and {MAX_HITS} hits per bucket; drill_down gives all documents of one")


def axis_column(df: DataFrame, axis: Axis) -> Column:
    """The bucket a document falls into; an array axis gives one bucket per distinct element."""
    if axis.field == QUERY:
        return F.col(QUERY).alias(axis.label)
    settings = fields_of(df).get(axis.field)
    if settings is None:
        raise ValueError(f"no such field: {axis.field!r}")
    column, dtype = col(axis.field), df.schema[axis.field].dataType
    if axis.interval is not None and settings.type == "date":
        part = dates.PARTS.get(str(axis.interval))
        column = part(column) if part else dates.date_bucket(column, str(axis.interval))
    elif axis.interval is not None:
        column = dates.number_bucket(column, dtype, axis.interval)
    elif isinstance(dtype, T.ArrayType):
        column = F.explode(F.array_distinct(column))
    return column.alias(axis.label)


def _sketchable(column: Column, df: DataFrame, field: str) -> Column:
    """Sketches take whole numbers and strings; other values are counted by their digest."""
    if isinstance(df.schema[field].dataType, (T.IntegerType, T.LongType, T.StringType)):
        return column
    return F.when(column.isNotNull(), F.xxhash64(column))


def _metric(df: DataFrame, metric: Metric) -> Column:
    settings = fields_of(df).get(metric.field)
    if settings is None:
        raise ValueError(f"no such field: {metric.field!r}")
    column = F.col(metric.field)
    if metric.function == "avg" and settings.type == "date":
        return dates.average(column).alias(metric.label)
    functions = {
        "sum": F.sum,
        "avg": F.avg,
        "min": F.min,
        "max": F.max,
        "value_count": F.count,
        # Distinct values are combined in the tasks and dealt out by bucket and value.
        "cardinality": F.count_distinct,
        "cardinality_estimate": lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(_sketchable(c, df, metric.field), 14)),
    }
    if metric.function not in functions:
        raise ValueError(f"unknown function {metric.function!r}")
    return functions[metric.function](column).alias(metric.label)


def _base(df: DataFrame, axes: Sequence[Axis], queries, filters, ids) -> DataFrame:
    """Selected documents with their labels, where an axis asks for them."""
    by_query = [a for a in axes if a.field == QUERY]
    if len(by_query) > 1:
        raise ValueError("only one axis can count by query")
    if not by_query:
        return select(df, queries, filters, ids)
    if not labelled(queries):
        raise ValueError("counting by query needs queries")
    return label_matches(select(df, None, filters, ids), queries, QUERY)


def _axis_columns(base: DataFrame, axes: Sequence[Axis], keep: Sequence[str]) -> DataFrame:
    """Bucket columns next to the kept ones, without documents that lack a value on an axis."""
    taken = {a.label for a in axes}
    sources = {c: f"__{c}" if c in taken else c for c in dict.fromkeys(keep)}
    arrays = {f.name for f in base.schema.fields if isinstance(f.dataType, T.ArrayType)}
    exploded = [a for a in axes if a.field in arrays]
    plain = [a for a in axes if a not in exploded]
    columns = [F.col(c).alias(alias) for c, alias in sources.items()]
    if len(exploded) <= 1:
        out = base.select(*[axis_column(base, a) for a in axes], *columns)
    else:  # one generator per projection
        out = base.select(*[axis_column(base, a) for a in plain], *[a.field for a in exploded], *columns)
        for a in exploded:
            out = out.withColumn(a.label, F.explode(F.array_distinct(a.field)))
    # Plain conditions instead of dropna(), as only those reach the scan.
    return out.where(all_true(col(a.label).isNotNull() for a in axes))


def aggregate(
    df: DataFrame,
    axes: Sequence[str | Axis] = (),
    metrics: Sequence[Metric | TopHits] = (),
    queries=None,
    filters: Mapping[str, Any] | None = None,
    ids=None,
) -> DataFrame:
    """One row per bucket: the axes, the number of documents ``n``, and the metrics, in that order.

    Lazy, but for ``median_absolute_deviation``, which keeps the counts of the values.
    """
    axes = [Axis.of(a) for a in axes]
    base = _base(df, axes, queries, filters, ids)
    plain = [m for m in metrics if isinstance(m, Metric) and m.function not in _SPREADS]
    spreads = [m for m in metrics if isinstance(m, Metric) and m.function in _SPREADS]
    hits = [m for m in metrics if isinstance(m, TopHits)]
    labels = [a.label for a in axes]

    rows = _axis_columns(base, axes, [m.field for m in plain])
    renamed = {m.field: f"__{m.field}" for m in plain if m.field in labels}
    aggregates = [F.count(F.lit(1)).alias("n")]
    for m in plain:
        source = renamed.get(m.field)
        column = _metric(base, m)
        if source:  # the axis took the field's name, so the metric reads the kept copy
            copy = base.withColumn(source, F.col(m.field)).withMetadata(source, base.schema[m.field].metadata)
            column = _metric(copy, Metric(source, m.function, m.label))
        aggregates.append(column)
    result = rows.groupBy(*map(col, labels)).agg(*aggregates)
    for m in spreads:
        result = _attach(result, _SPREADS[m.function](base, axes, m), labels)
    for m in hits:
        result = _attach(result, _top_hits(base, axes, m), labels)
    names = [m.label if isinstance(m, Metric) else m.name for m in metrics]
    return result.select(*map(col, [*labels, "n", *names]))


def _attach(result: DataFrame, extra: DataFrame, labels: Sequence[str]) -> DataFrame:
    if labels:
        return result.join(extra, list(labels), "left")
    (value,) = extra.columns
    return result.withColumn(value, extra.scalar())


def _spread_rows(base: DataFrame, axes: Sequence[Axis], metric: Metric) -> tuple[DataFrame, Column]:
    """Buckets with the field, and the field as a number."""
    rows = _axis_columns(base, axes, [metric.field])
    source = f"__{metric.field}" if metric.field in [a.label for a in axes] else metric.field
    return rows, F.col(source).cast("double")


def _medians(counted: DataFrame, groups: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """From distinct values with their counts per group to each group's median, and the stored counts.

    Middle value, or the mean of the two middle ones. Values are laid out by ranges of group and value, and stored with
    the number of their range. The few sums of the ranges say in which one a middle rank lies, and only there are values
    ranked, so a group that holds most values is no matter of one task.
    """
    keys = list(map(col, groups))
    ranged = counted.repartitionByRange(*keys, "__value").withColumn("__range", F.spark_partition_id())
    stored = keep(ranged, "medians")
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored.groupBy(*keys, "__range").agg(F.sum("__count").alias("__sum"))
    ranges = ranges.withColumns({"__before": F.coalesce(F.sum("__sum").over(earlier), F.lit(0)), "__total": F.sum("__sum").over(group)})
    middle = {"__low": F.expr("(__total + 1) div 2"), "__high": F.expr("__total div 2 + 1")}
    ranges = ranges.withColumns(middle).where("__before < __high and __before + __sum >= __low")
    inside = Window.partitionBy(*keys, "__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = stored.join(ranges, [*groups, "__range"]).withColumn("__upto", F.col("__before") + F.sum("__count").over(inside))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("__upto") >= F.col(rank)) & (F.col("__upto") - F.col("__count") < F.col(rank)), F.col("__value")))

    median = ((at("__low") + at("__high")) / 2).alias(name)
    return ranked.groupBy(*keys).agg(median), stored.drop("__range")


def _spread(base: DataFrame, axes: Sequence[Axis], metric: Metric) -> DataFrame:
    """Median distance to the bucket's median, both exact."""
    rows, value = _spread_rows(base, axes, metric)
    # Without an axis all rows are one group.
    groups = [a.label for a in axes] or ["__all"]
    if not axes:
        rows = rows.withColumn("__all", F.lit(0))
    counted = rows.select(*map(col, groups), value.alias("__value")).where("__value is not null")
    counted = counted.groupBy(*map(col, groups), "__value").agg(F.count(F.lit(1)).alias("__count"))
    centre, stored = _medians(counted, groups, "__centre")
    # No hint: the bucket table is small or large as the axes decide, and Spark knows its size by then.
    distance = stored.join(centre, groups).withColumn("__value", F.abs(F.col("__value") - F.col("__centre")))
    counted = distance.groupBy(*map(col, groups), "__value").agg(F.sum("__count").alias("__count"))
    spread, _ = _medians(counted, groups, metric.label)
    return spread if axes else spread.drop("__all")


def _estimated_median(value: Column) -> Column:
    """Middle value, or the mean of the two middle ones: the sketch taken from below and from above."""
    below = F.approx_percentile(value, 0.5, _PRECISION)
    above = -F.approx_percentile(-value, 0.5, _PRECISION)
    return (below + above) / 2


def _estimated_spread(base: DataFrame, axes: Sequence[Axis], metric: Metric) -> DataFrame:
    """Median distance to the bucket's median. Both medians come from bounded sketches."""
    labels = [a.label for a in axes]
    rows, value = _spread_rows(base, axes, metric)
    centre = rows.groupBy(*map(col, labels)).agg(_estimated_median(value).alias("__centre"))
    if labels:
        distance = rows.join(centre, labels).withColumn("__distance", F.abs(value - F.col("__centre")))
    else:
        distance = rows.withColumn("__distance", F.abs(value - centre.scalar()))
    return distance.groupBy(*map(col, labels)).agg(_estimated_median(F.col("__distance")).alias(metric.label))


_SPREADS = {"median_absolute_deviation": _spread, "median_absolute_deviation_estimate": _estimated_spread}


def _top_hits(base: DataFrame, axes: Sequence[Axis], hits: TopHits) -> DataFrame:
    labels = [a.label for a in axes]
    sort = Sort.of(hits.sort)
    keep = list(dict.fromkeys([*hits.fields, *[s.field for s in sort], ID]))
    rows = _axis_columns(base, axes, keep)
    stored = {c: f"__{c}" if c in labels else c for c in keep}
    order = order_by([Sort(stored[s.field], s.descending) for s in sort], stored[ID])
    # rank <= n lets every task keep only its own first n rows of a bucket before the shuffle, so that a
    # bucket holding much of the data never travels to one task.
    partition = Window.partitionBy(*map(col, labels)) if labels else Window.partitionBy()
    ranked = rows.withColumn("__rank", F.row_number().over(partition.orderBy(*order))).where(F.col("__rank") <= hits.n)
    record = F.struct(F.col("__rank"), F.struct(*[F.col(stored[f]).alias(f) for f in hits.fields]).alias("hit"))
    listed = F.transform(F.array_sort(F.collect_list(record)), lambda r: r["hit"])
    return ranked.groupBy(*map(col, labels)).agg(listed.alias(hits.name))


def _is_ascending(axis: Axis) -> bool:
    return axis.interval is not None


def bucket_order(axes: Sequence[str | Axis]) -> list[Column]:
    """Bucketed and date-part axes ascending, plain axes descending."""
    axes = [Axis.of(a) for a in axes]
    return [col(a.label).asc() if _is_ascending(a) else col(a.label).desc() for a in axes]


def ordered(buckets: DataFrame, axes: Sequence[str | Axis]) -> DataFrame:
    return buckets.orderBy(*bucket_order(axes))


def bucket_page(
    buckets: DataFrame,
    axes: Sequence[str | Axis],
    after: Mapping[str, Any] | None = None,
    size: int = PAGE_BUCKETS,
) -> DataFrame:
    """The next ``size`` buckets behind the bucket key ``after``, in bucket order."""
    axes = [Axis.of(a) for a in axes]
    if after is not None:
        steps = []
        for i, axis in enumerate(axes):
            same = [col(a.label) == F.lit(after[a.label]) for a in axes[:i]]
            column, key = col(axis.label), F.lit(after[axis.label])
            steps.append(reduce(lambda a, b: a & b, [*same, column > key if _is_ascending(axis) else column < key]))
        buckets = buckets.where(reduce(lambda a, b: a | b, steps))
    return buckets.orderBy(*bucket_order(axes)).limit(size)


def field_stats(df: DataFrame, field: str) -> DataFrame:
    """Count, min, max, average and sum of a number or date, in one row."""
    settings, column = fields_of(df)[field], F.col(field)
    if settings.type == "date":
        days, rest = dates.micros(column)
        total = (F.sum(days).cast("double") * 86_400_000 + F.sum(F.floor(rest / 1000)).cast("double")).alias("sum")
        average = dates.average(column).alias("avg")
    elif settings.type in ("number", "integer"):
        total, average = F.sum(column).alias("sum"), F.avg(column).alias("avg")
    else:
        raise ValueError(f"{field!r} is a {settings.type} field and has no statistics")
    return df.agg(
        F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), average, total
    )


def field_values(df: DataFrame, field: str, size: int | None = None) -> DataFrame:
    """All distinct values with their counts, most frequent first; only the first ``size`` if that is given."""
    counts = aggregate(df, [Axis(field, name="value")]).orderBy(F.desc("n"), "value")
    return counts if size is None else counts.limit(size)


def list_field_values(df: DataFrame, field: str) -> list[Any]:
    """The values as a list; refused where there are more than 2,000."""
    rows = field_values(df, field, MAX_VALUES + 1).collect()
    if len(rows) > MAX_VALUES:
        raise ValueError(f"field {field!r} has more than {MAX_VALUES} values")
    return [row["value"] for row in rows]
