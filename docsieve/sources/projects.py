"""Reading one or several projects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.dates import in_utc
from docsieve.operators.filters import select
from docsieve.operators.search import sort_documents
from docsieve.operators.write import with_fields
from docsieve.schema import ID, Field, as_field, declare, merge_projects


def read_project(
    spark: SparkSession,
    path: str,
    id_columns: str | Sequence[str] = ID,
    fields: Mapping[str, str | Field] | None = None,
) -> DataFrame:
    """A Parquet table as a project. ``id_columns`` become ``_id``; only declared fields are kept, if any are.

    Declared dates with a zone are read as their time in UTC, so that buckets and filters mean the same everywhere.
    """
    df = spark.read.parquet(path)
    names = [id_columns] if isinstance(id_columns, str) else list(id_columns)
    parts = [F.col(n).cast("string") for n in names]
    key = parts[0] if len(parts) == 1 else F.concat_ws("-", *parts)
    rest = list(fields) if fields else [c for c in df.columns if c != ID and c not in names]
    dates = {n for n, f in (fields or {}).items() if as_field(f).type == "date"}
    zoned = {c.name for c in df.schema.fields if c.name in dates and isinstance(c.dataType, T.TimestampType)}
    df = df.select(key.alias(ID), *[in_utc(F.col(c)).alias(c) if c in zoned else c for c in rest])
    return declare(df, {n: as_field(f) for n, f in fields.items()}) if fields else df


def scan_project(
    df: DataFrame,
    queries=None,
    filters: Mapping[str, Any] | None = None,
    ids=None,
    sort: Any = None,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """All matching documents with the wanted fields; sorted only if asked for."""
    found = select(df, queries, filters, ids)
    found = sort_documents(found, sort) if sort else found
    columns = [c for c in found.columns if c == ID or ((include is None or c in include) and c not in exclude)]
    return found.select(*columns)


def scan_multi(projects: Sequence[DataFrame]) -> DataFrame:
    """Several projects as one. A field with two types is refused; one that a project lacks reads as null."""
    fields = merge_projects(projects)
    aligned = [with_fields(p, fields).select(ID, *fields) for p in projects]
    return declare(reduce(DataFrame.unionByName, aligned), fields)
