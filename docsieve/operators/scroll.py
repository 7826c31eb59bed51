"""Reading a sorted result piece by piece, at any depth.

A result is sorted once, by all tasks, and stored in ranges of the order. A manifest says how many rows each range has and
with which keys it begins and ends. A page far down, or the rows behind a cursor, are then read from the ranges they lie
in, and from nothing else. What is read does not change while the project does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.operators.order import RANDOM, Sort, order_by, random_key
from docsieve.schema import ID
from docsieve.session import keep, scratch_path

_RANGE, _AT = "__range", "__at"
# A row number inside a range has so many bits.
_BITS = 33


def with_id(sort: Any) -> list[Sort]:
    """Sort keys that tell all documents apart: the id settles ties."""
    keys = Sort.of(sort)
    return keys if ID in [k.field for k in keys] else [*keys, Sort(ID)]


def behind(keys: Sequence[Sort], after: Mapping[str, Any], seed: int = 0, of=F.col) -> Column:
    """Whether a row comes behind the row ``after`` (a dict of its sort keys and id); ``of`` gives a key's column.

    Rows without a key come last, as in every order.
    """
    steps, same = [], []
    for key in keys:
        if key.field == RANDOM:
            column, bound = of(RANDOM) if of is not F.col else random_key(seed), F.md5(F.lit(f"{after[ID]}:{seed}"))
        else:
            column, bound = of(key.field), F.lit(after[key.field])
        if key.field == RANDOM or after[key.field] is not None:
            further = (column < bound if key.descending else column > bound) | column.isNull()
            steps.append(reduce(lambda a, b: a & b, [*same, further]))
        # Nothing comes behind a missing key but rows that miss it, too.
        same = [*same, column.eqNullSafe(bound)]
    return reduce(lambda a, b: a | b, steps) if steps else F.lit(False)


@dataclass(frozen=True)
class Snapshot:
    """A sorted result in ranges. ``path`` holds it for other sessions, see `open_snapshot`."""

    spark: SparkSession
    path: str
    keys: tuple[Sort, ...]
    seed: int

    @cached_property
    def _rows(self) -> DataFrame:
        # Without rows there is no file to read the columns from.
        return self.spark.read.schema(T.StructType.fromJson(_spec(self.spark, self.path)["schema"])).parquet(f"{self.path}/rows")

    @cached_property
    def _manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    @cached_property
    def ranges(self) -> list[Row]:
        """One row per range (as many as the sort had tasks): its number, its rows, and the rows before it."""
        found, before = [], 0
        for row in self._manifest.select(_RANGE, "rows").orderBy(_RANGE).collect():
            found.append(Row(number=row[_RANGE], rows=row["rows"], before=before))
            before += row["rows"]
        return found

    @property
    def total(self) -> int:
        return self.ranges[-1].before + self.ranges[-1].rows if self.ranges else 0

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(_RANGE, _AT).drop(_RANGE, _AT)

    def rows(self, start: int, count: int) -> DataFrame:
        """``count`` rows from place ``start`` (0 is the first) on, in order; read from the ranges that hold them."""
        end = start + count
        held = [r for r in self.ranges if r.before < end and start < r.before + r.rows]
        if not held or count < 1:
            return self._shown(self._rows.where(F.lit(False)))
        first, last = held[0], held[-1]
        number, at = F.col(_RANGE), F.col(_AT)
        inside = number.between(first.number, last.number)
        inside &= (number > first.number) | (at >= start - first.before)
        inside &= (number < last.number) | (at < end - last.before)
        return self._shown(self._rows.where(inside))

    def after(self, cursor: Mapping[str, Any], size: int) -> DataFrame:
        """``size`` rows behind the row ``cursor`` (a dict of its sort keys and id), whether or not it is there."""
        later = behind(self.keys, cursor, self.seed, lambda name: F.col("last")[_key_name(self.keys, name)])
        found = self._manifest.where(later).agg(F.min(_RANGE).alias("first")).first()["first"]
        if found is None:
            return self.rows(0, 0)
        held, left = [], size
        for r in self.ranges:
            if r.number < found or left <= 0:
                continue
            # Of the first range any number of rows may be before the cursor.
            left -= r.rows if held else 0
            held.append(r.number)
        rows = self._rows.where(F.col(_RANGE).between(found, held[-1]))
        return self._shown(rows.where(behind(self.keys, cursor, self.seed)).orderBy(_RANGE, _AT).limit(size))

    def batches(self, size: int) -> Iterator[list[Row]]:
        """Batch after batch until the end, for a reader that takes one at a time; nothing is sorted again."""
        for start in range(0, self.total, size):
            yield self.rows(start, size).collect()


def _key_name(keys: Sequence[Sort], field: str) -> str:
    return f"key{[k.field for k in keys].index(field)}"


def snapshot(df: DataFrame, sort: Any = None, seed: int = 0, path: str | None = None) -> Snapshot:
    """Sort a result into ranges, in the shared folder or at ``path``. This runs at once.

    Ranges are those of Spark's sort, so adaptive execution sets their number by their size; the id settles ties, so many
    rows with one key are spread over several.
    """
    spark, keys = df.sparkSession, with_id(sort)
    path = path or scratch_path(spark, "snapshot")
    place = F.monotonically_increasing_id()
    ordered = df.orderBy(*order_by(keys, seed=seed)).withColumn("__place", place)
    ordered = ordered.withColumns(
        {_RANGE: F.shiftright("__place", _BITS).cast("int"), _AT: F.col("__place").bitwiseAND(F.lit((1 << _BITS) - 1))}
    )
    ordered.drop("__place").write.partitionBy(_RANGE).parquet(f"{path}/rows")
    values = [
        (random_key(seed) if k.field == RANDOM else F.col(k.field)).alias(_key_name(keys, k.field)) for k in keys
    ]
    schema = df.select("*", F.lit(0).cast("bigint").alias(_AT), F.lit(0).alias(_RANGE)).schema
    spec = {"sort": [[k.field, k.descending] for k in keys], "seed": seed, "schema": schema.jsonValue()}
    spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.parquet(f"{path}/spec")
    ends = {"first": F.min_by(F.struct(*values), _AT), "last": F.max_by(F.struct(*values), _AT)}
    counted = spark.read.schema(schema).parquet(f"{path}/rows").groupBy(_RANGE)
    manifest = counted.agg(F.count(F.lit(1)).alias("rows"), *[column.alias(name) for name, column in ends.items()])
    manifest.write.parquet(f"{path}/manifest")
    return Snapshot(spark, path, tuple(keys), seed)


def _spec(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/spec").first()["spec"])


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot stored before."""
    spec = _spec(spark, path)
    return Snapshot(spark, path, tuple(Sort(*key) for key in spec["sort"]), spec["seed"])


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """The rows of a sorted frame with their numbers in its order, from 1. Every task numbers its own rows, behind those
    of the tasks before it, which are counted first."""
    rows = keep(ordered.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("__place", _BITS)
    counts, before = [], 0
    for row in rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():
        counts.append((row["task"], before))
        before += row["n"]
    # One row per task of the sort.
    offsets = F.broadcast(ordered.sparkSession.createDataFrame(counts, "__task bigint, __before bigint"))
    place = F.col("__place").bitwiseAND(F.lit((1 << _BITS) - 1)) + F.col("__before") + 1
    joined = rows.join(offsets, task == F.col("__task"))
    return joined.withColumn(name, place).drop("__place", "__task", "__before")
