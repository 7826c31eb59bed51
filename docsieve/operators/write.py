"""Changing documents. Every operator turns a table into a new one; the caller stores the result.

A written batch is folded to one document per id, kept in the shared folder, and measured. A small batch is sent to
where the documents are. Of a larger one only the ids are sent, so that documents it does not touch stay where they are.
Only a batch whose ids alone are too many is joined by shuffling the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.coerce import stored_value
from docsieve.functions.ids import doc_hash
from docsieve.functions.text import normalise
from docsieve.functions.tags import tag_add, tag_add_changes, tag_remove, tag_remove_changes
from docsieve.operators.filters import mark_selected, select
from docsieve.schema import (
    ID,
    SPARK_TYPES,
    Field,
    as_field,
    declare,
    empty_column,
    extend_fields,
    fields_of,
    mark_words,
    words_columns,
)
from docsieve.session import keep

_CHOSEN = "__chosen"
_POSITION = "__position"
# Most bytes of a batch, and of its ids alone, that are sent to every executor.
MAX_SENT_ROWS = 32 << 20
MAX_SENT_IDS = 128 << 20


@dataclass(frozen=True)
class Written:
    """The new table, and the incoming ids that were refused."""

    table: DataFrame
    failures: DataFrame


def with_fields(df: DataFrame, fields: Mapping[str, Field]) -> DataFrame:
    """The table with all given fields, empty where new, and their settings attached."""
    missing = [empty_column(name, field) for name, field in fields.items() if name not in df.columns]
    return declare(df.select("*", *missing) if missing else df, fields)


def prepare(
    stored: DataFrame,
    incoming: DataFrame,
    operation: str = "index",
    fields: Mapping[str, str | Field] | None = None,
    position: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stored table and incoming documents with the same fields, values coerced and ids in place."""
    known = fields_of(stored)
    if fields:
        # The one case that needs a look at the data: identifiers may not be added to existing documents.
        adds_identifier = any(as_field(f).identifier for n, f in fields.items() if n not in known)
        first = adds_identifier and not any(f.identifier for f in known.values())
        known = extend_fields(known, fields, has_documents=first and not stored.isEmpty())
    unknown = set(incoming.columns) - set(known) - {ID, position}
    if unknown:
        raise ValueError(f"fields not declared: {sorted(unknown)}")
    identifiers = sorted(name for name, f in known.items() if f.identifier)
    if identifiers and ID in incoming.columns and operation != "update":
        raise ValueError(f"{ID} cannot be given, it follows from the identifiers {identifiers}")
    if not identifiers and ID not in incoming.columns:
        if operation in ("update", "upsert"):
            raise ValueError(f"{operation} needs {ID}")
        # Equal documents stay apart by their place in the input; give ``position`` where re-runs may differ.
        place = F.col(position) if position else F.monotonically_increasing_id()
        made = F.concat(F.to_json(F.struct(*incoming.columns)), place.cast("string"))
        incoming = incoming.withColumn(ID, F.sha2(made, 224))
    values = [
        stored_value(F.col(name), incoming.schema[name].dataType, known[name].type).alias(name)
        for name in incoming.columns
        if name in known
    ]
    if identifiers:
        present = [name for name in identifiers if name in incoming.columns]
        new_id = doc_hash(present).alias(ID)
    else:
        new_id = F.col(ID).cast("string").alias(ID)
    order = F.col(position) if position else F.xxhash64(*incoming.columns)
    incoming = incoming.select(new_id, *values, order.alias(_POSITION))
    if not position and operation != "create":
        repeated = incoming.where(F.col(ID).isNotNull()).groupBy(ID).count().where("count > 1")
        if not repeated.isEmpty():
            raise ValueError("an id comes more than once; give position, so that the last one is known")
    return with_fields(stored, known), incoming


def _without_id(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that have an id, and a null id for each of the others, which are failures."""
    return incoming.where(F.col(ID).isNotNull()), incoming.where(F.col(ID).isNull()).select(ID)


def _with_words(table: DataFrame, before: DataFrame) -> DataFrame:
    """The table with the stored words of ``before``, made anew where they are missing."""
    for text, column in words_columns(before).items():
        table = table.withColumn(column, F.coalesce(F.col(column), normalise(F.col(text))))
        table = mark_words(table, column, text)
    return table


def _last(incoming: DataFrame) -> DataFrame:
    """The last document of each id. Ranking first inside each task keeps a much repeated id small."""
    latest = Window.partitionBy(ID).orderBy(F.col(_POSITION).desc())
    return incoming.withColumn("__rank", F.row_number().over(latest)).where("__rank <= 1").drop("__rank", _POSITION)


def _overlay(incoming: DataFrame) -> DataFrame:
    """One document per id: per field the last value that is not null."""
    names = [c for c in incoming.columns if c not in (ID, _POSITION)]
    last = [F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col(_POSITION))).alias(n) for n in names]
    return incoming.groupBy(ID).agg(*last) if last else incoming.select(ID).distinct()


@dataclass(frozen=True)
class _Batch:
    """A kept batch with one document per id, and whether its rows or only its ids are small enough to be sent."""

    rows: DataFrame
    ids: DataFrame
    rows_sent: bool
    ids_sent: bool


def _width(field: T.StructField) -> Column:
    """Bytes of a value, roughly."""
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
    return F.lit(16)


def _keep_batch(folded: DataFrame) -> _Batch:
    rows = keep(folded, "batch")
    # 64 bytes for what a row costs beside its values.
    whole = reduce(lambda a, b: a + b, [_width(f) for f in rows.schema.fields])
    sizes = rows.agg(F.sum(F.octet_length(ID) + 64).alias("ids"), F.sum(whole + 64).alias("rows")).first()
    rows_sent, ids_sent = (sizes["rows"] or 0) <= MAX_SENT_ROWS, (sizes["ids"] or 0) <= MAX_SENT_IDS
    ids = rows.select(ID)
    return _Batch(rows, F.broadcast(ids) if ids_sent else ids, rows_sent, ids_sent)


def _stored_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that are both stored and incoming: never more than come in, so later joins against it stay small."""
    return stored.select(ID).join(ids, ID, "left_semi")


def upsert_join(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming ids, with a Boolean ``stored`` that tells which are there already."""
    known = _stored_ids(stored, incoming.select(ID)).withColumn("stored", F.lit(True))
    joined = incoming.select(ID).distinct().join(known, ID, "left")
    return joined.withColumn("stored", F.coalesce("stored", F.lit(False)))


def _union(upper: DataFrame, lower: DataFrame, fields: Mapping[str, Field]) -> DataFrame:
    return with_fields(upper.unionByName(lower, allowMissingColumns=True), fields)


def _patched(stored: DataFrame, batch: _Batch) -> DataFrame:
    """Stored documents with the values of the batch laid over them."""

    def overlaid(documents: DataFrame) -> DataFrame:
        names = [c for c in batch.rows.columns if c != ID]
        renamed = batch.rows.select(ID, *[F.col(n).alias(f"__new_{n}") for n in names])
        joined = documents.join(F.broadcast(renamed) if batch.rows_sent else renamed, ID, "left")
        columns = {c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in names else F.col(c) for c in stored.columns}
        for text, column in words_columns(stored).items():
            if text in names:  # the words of a new text are made later
                columns[column] = F.when(F.col(f"__new_{text}").isNull(), F.col(column))
        return joined.select(*[value.alias(c) for c, value in columns.items()])

    if batch.ids_sent and not batch.rows_sent:
        untouched = stored.join(batch.ids, ID, "left_anti")
        table = untouched.unionByName(overlaid(stored.join(batch.ids, ID, "left_semi")))
    else:
        table = overlaid(stored)
    return with_fields(table, fields_of(stored))


def write_index(stored: DataFrame, incoming: DataFrame, fields=None, position: str | None = None) -> Written:
    """Insert, or fully replace by id; fields the new document lacks are lost."""
    stored, incoming = prepare(stored, incoming, "index", fields, position)
    incoming, refused = _without_id(incoming)
    batch = _keep_batch(_last(incoming))
    kept = stored.join(batch.ids, ID, "left_anti")
    return Written(_with_words(_union(kept, batch.rows, fields_of(stored)), stored), refused)


def write_create(stored: DataFrame, incoming: DataFrame, fields=None, position: str | None = None) -> Written:
    """Insert only. Ids that exist, or come in a second time, are failures."""
    stored, incoming = prepare(stored, incoming, "create", fields, position)
    incoming, refused = _without_id(incoming)
    order = Window.partitionBy(ID).orderBy(F.col(_POSITION))
    first = incoming.withColumn("__rank", F.row_number().over(order)).where("__rank <= 1").drop("__rank", _POSITION)
    batch = _keep_batch(first)
    existing = _stored_ids(stored, batch.ids)
    repeated = incoming.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ID)
    table = _union(stored, batch.rows.join(existing, ID, "left_anti"), fields_of(stored))
    return Written(_with_words(table, stored), existing.union(repeated).distinct().union(refused))


def write_update(stored: DataFrame, incoming: DataFrame, fields=None, position: str | None = None) -> Written:
    """Change the given fields of stored documents. Unknown ids are failures."""
    stored, incoming = prepare(stored, incoming, "update", fields, position)
    incoming, refused = _without_id(incoming)
    batch = _keep_batch(_overlay(incoming))
    missing = batch.rows.select(ID).join(_stored_ids(stored, batch.ids), ID, "left_anti")
    return Written(_with_words(_patched(stored, batch), stored), missing.union(refused))


def write_upsert(stored: DataFrame, incoming: DataFrame, fields=None, position: str | None = None) -> Written:
    """As update, but unknown ids are inserted. A null never erases a value."""
    stored, incoming = prepare(stored, incoming, "upsert", fields, position)
    incoming, refused = _without_id(incoming)
    batch = _keep_batch(_overlay(incoming))
    inserted = batch.rows.join(_stored_ids(stored, batch.ids), ID, "left_anti")
    table = _union(_patched(stored, batch), inserted, fields_of(stored))
    return Written(_with_words(table, stored), refused)


OPERATIONS = {"index": write_index, "create": write_create, "update": write_update, "upsert": write_upsert}


def write(operation: str, stored: DataFrame, incoming: DataFrame, fields=None, position=None) -> Written:
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    return OPERATIONS[operation](stored, incoming, fields, position)


@dataclass(frozen=True)
class Edited:
    """The new table, and a one-row report of how many documents were ``updated`` out of ``total`` matches."""

    table: DataFrame
    report: DataFrame


def _report(marked: DataFrame, changed: Column) -> DataFrame:
    return marked.agg(
        F.count_if(F.col(_CHOSEN) & changed).alias("updated"),
        F.count_if(F.col(_CHOSEN)).alias("total"),
    )


def update_where(df: DataFrame, field: str, value: Any, queries=None, filters=None, ids=None) -> Edited:
    """Set one field to a constant on all matches; None removes it."""
    fields = fields_of(df)
    if field not in fields:
        raise ValueError(f"no such field: {field!r}")
    marked = mark_selected(df, _CHOSEN, queries, filters, ids)
    dtype = df.schema[field].dataType
    constant = F.lit(None).cast(dtype) if value is None else F.lit(value).cast(dtype)
    table = marked.withColumn(field, F.when(F.col(_CHOSEN), constant).otherwise(F.col(field)))
    words = words_columns(df).get(field)
    if words:
        table = table.withColumn(words, F.when(~F.col(_CHOSEN), F.col(words)))
    return Edited(_with_words(with_fields(table.drop(_CHOSEN), fields), df), _report(marked, F.lit(True)))


def delete_where(df: DataFrame, queries=None, filters=None, ids=None) -> Edited:
    """Delete all matches."""
    marked = mark_selected(df, _CHOSEN, queries, filters, ids)
    table = with_fields(marked.where(~F.col(_CHOSEN)).drop(_CHOSEN), fields_of(df))
    return Edited(table, _report(marked, F.lit(True)))


def tag_where(df: DataFrame, action: str, field: str, tag: str, queries=None, filters=None, ids=None) -> Edited:
    """Add or remove a tag on all matches. The field must hold tags or be new."""
    fields = fields_of(df)
    if fields.setdefault(field, Field("tag")).type != "tag":
        raise ValueError(f"{field!r} is not a tag field")
    steps = {"add": (tag_add, tag_add_changes), "remove": (tag_remove, tag_remove_changes)}
    if action not in steps:
        raise ValueError(f"unknown action {action!r}")
    change, changes = steps[action]
    marked = mark_selected(with_fields(df, fields), _CHOSEN, queries, filters, ids)
    tags = F.col(field)
    table = marked.withColumn(field, F.when(F.col(_CHOSEN), change(tags, tag)).otherwise(tags))
    return Edited(with_fields(table.drop(_CHOSEN), fields), _report(marked, changes(tags, tag)))


def copy_where(
    source: DataFrame,
    destination: DataFrame,
    queries=None,
    filters: Mapping[str, Any] | None = None,
    field_options: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Copy matches into another table. Per field: ``rename``, ``exclude``, or ``type`` for a new field.
    An id that exists in the destination is replaced. The matches are found once and kept."""
    options, known = field_options or {}, fields_of(destination)
    found, columns, added = select(source, queries, filters), [], {}
    for name, field in fields_of(source).items():
        option = options.get(name, {})
        if option.get("exclude"):
            continue
        target = option.get("rename") or name
        if target not in known:
            added[target] = Field(option.get("type") or field.type)
        target_type = known[target].type if target in known else added[target].type
        value = stored_value(F.col(name), source.schema[name].dataType, target_type)
        columns.append(value.cast(SPARK_TYPES[target_type]).alias(target))
    fields: dict[str, Field] = {**known, **added}
    copies = _keep_batch(found.select(ID, *columns))
    kept = destination.join(copies.ids, ID, "left_anti")
    return _with_words(_union(with_fields(kept, fields), copies.rows, fields), destination)


def ids_from_identifiers(df: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Documents with the id that follows from their identifier fields."""
    return df.withColumn(ID, doc_hash(identifiers))
