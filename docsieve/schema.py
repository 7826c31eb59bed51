"""Field types, their Spark types, and the rules for declaring, extending and merging them.

A project is a DataFrame whose columns carry their field settings in ``StructField.metadata``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = "_id"
_META = "docsieve"
_WORDS_OF = "docsieve_words_of"

# User field types and the storage types each may use; the first is the default.
STORAGE_TYPES: dict[str, tuple[str, ...]] = {
    "text": ("text", "annotated_text", "binary", "match_only_text"),
    "date": ("date",),
    "boolean": ("boolean",),
    "keyword": ("keyword", "constant_keyword", "wildcard"),
    "number": ("double", "float", "half_float", "scaled_float"),
    "integer": ("long", "integer", "byte", "short", "unsigned_long"),
    "object": ("flattened",),
    "vector": ("dense_vector",),
    "geo_point": ("geo_point",),
    "tag": ("keyword", "wildcard"),
    "url": ("keyword", "wildcard", "constant_keyword"),
    "image": ("keyword",),
    "video": ("keyword",),
    "audio": ("keyword",),
}

SPARK_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "date": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
    "keyword": T.StringType(),
    "number": T.DoubleType(),
    "integer": T.LongType(),
    "object": T.StringType(),
    "vector": T.ArrayType(T.FloatType()),
    "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "tag": T.ArrayType(T.StringType()),
    "url": T.StringType(),
    "image": T.StringType(),
    "video": T.StringType(),
    "audio": T.StringType(),
}

KEYWORD_LIKE = frozenset({"keyword", "url", "image", "video", "audio"})
MEDIA_TYPES = frozenset({"image", "video", "audio"})
NOT_AN_IDENTIFIER = frozenset({"tag", "vector"})


def col(name: str) -> Column:
    """A column by its plain name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Snippet:
    """How much of a text to show: a head when nothing matches, else fragments around the hits."""

    nomatch_chars: int = 100
    max_matches: int = 0
    match_chars: int = 50

    def __post_init__(self) -> None:
        if self.nomatch_chars < 1 or self.max_matches < 0 or self.match_chars < 1:
            raise ValueError("snippet sizes must be positive (max_matches may be 0)")

    def within(self, limit: Snippet) -> bool:
        return (
            self.nomatch_chars <= limit.nomatch_chars
            and self.max_matches <= limit.max_matches
            and self.match_chars <= limit.match_chars
        )

    def smallest(self, other: Snippet) -> Snippet:
        return Snippet(
            min(self.nomatch_chars, other.nomatch_chars),
            min(self.max_matches, other.max_matches),
            min(self.match_chars, other.match_chars),
        )


@dataclass(frozen=True)
class Field:
    """Settings of one field. ``access`` is what a limited reader may see: none, read or snippet."""

    type: str
    storage: str | None = None
    identifier: bool = False
    access: str = "none"
    max_snippet: Snippet | None = None

    def __post_init__(self) -> None:
        if self.type not in STORAGE_TYPES:
            raise ValueError(f"unknown field type {self.type!r}")
        storage = self.storage or STORAGE_TYPES[self.type][0]
        if storage not in STORAGE_TYPES[self.type]:
            raise ValueError(f"field type {self.type} cannot be stored as {storage}")
        object.__setattr__(self, "storage", storage)
        if self.identifier and self.type in NOT_AN_IDENTIFIER:
            raise ValueError(f"a {self.type} field cannot be an identifier")
        if self.access not in ("none", "read", "snippet"):
            raise ValueError(f"unknown access {self.access!r}")

    def to_metadata(self) -> dict[str, Any]:
        meta: dict[str, Any] = {
            "type": self.type,
            "storage": self.storage,
            "identifier": self.identifier,
            "access": self.access,
        }
        if self.max_snippet:
            s = self.max_snippet
            meta["max_snippet"] = [s.nomatch_chars, s.max_matches, s.match_chars]
        return meta

    @staticmethod
    def from_metadata(meta: Mapping[str, Any]) -> Field:
        limit = meta.get("max_snippet")
        return Field(
            meta["type"],
            meta.get("storage"),
            bool(meta.get("identifier", False)),
            meta.get("access", "none"),
            Snippet(*limit) if limit else None,
        )


def as_field(spec: str | Field) -> Field:
    return Field(spec) if isinstance(spec, str) else spec


def field_for(dtype: T.DataType) -> Field:
    """The field type taken for an undeclared column, from its Spark type alone."""
    if isinstance(dtype, T.StringType):
        return Field("keyword")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Field("date")
    if isinstance(dtype, T.BooleanType):
        return Field("boolean")
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return Field("number")
    if isinstance(dtype, T.IntegralType):
        return Field("integer")
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StringType):
            return Field("tag")
        if isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
            return Field("vector")
    return Field("object")


def declare(df: DataFrame, fields: Mapping[str, str | Field]) -> DataFrame:
    """Attach field settings to columns. Values are not touched; see ``functions.coerce`` for that."""
    unknown = set(fields) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    columns = []
    for column in df.schema.fields:
        spec = fields.get(column.name)
        meta = {**column.metadata, _META: as_field(spec).to_metadata()} if spec else column.metadata
        columns.append(col(column.name).alias(column.name, metadata=meta))
    return df.select(*columns)


def fields_of(df: DataFrame) -> dict[str, Field]:
    """Field settings of every column except ``_id`` and stored word columns."""
    found = {}
    for column in df.schema.fields:
        if column.name == ID or _WORDS_OF in column.metadata:
            continue
        meta = column.metadata.get(_META)
        found[column.name] = Field.from_metadata(meta) if meta else field_for(column.dataType)
    return found


def identifiers_of(df: DataFrame) -> list[str]:
    return sorted(name for name, field in fields_of(df).items() if field.identifier)


def words_columns(df: DataFrame) -> dict[str, str]:
    """Text field -> column holding its stored words, where there is one."""
    return {c.metadata[_WORDS_OF]: c.name for c in df.schema.fields if _WORDS_OF in c.metadata}


def mark_words(df: DataFrame, column: str, text_field: str) -> DataFrame:
    return df.withMetadata(column, {_WORDS_OF: text_field})


def empty_column(name: str, field: Field):
    return F.lit(None).cast(SPARK_TYPES[field.type]).alias(name, metadata={_META: field.to_metadata()})


def extend_fields(
    current: Mapping[str, Field], new: Mapping[str, str | Field], has_documents: bool
) -> dict[str, Field]:
    """Add fields. A known field may be declared again if storage and identifier flag agree."""
    merged = dict(current)
    had_identifiers = any(f.identifier for f in current.values())
    for name, spec in new.items():
        field = as_field(spec)
        known = current.get(name)
        if known is None:
            merged[name] = field
            if field.identifier and has_documents and not had_identifiers:
                raise ValueError("identifiers cannot be added: there are documents without them")
        elif known.storage != field.storage:
            raise ValueError(f"field {name!r} already exists with storage type {known.storage}")
        elif known.identifier != field.identifier:
            raise ValueError(f"field {name!r} already exists with identifier={known.identifier}")
    return merged


def change_type(current: Mapping[str, Field], name: str, new_type: str) -> dict[str, Field]:
    """Change the user type of a field to another that shares its storage type."""
    if name not in current:
        raise ValueError(f"field {name!r} does not exist")
    field = current[name]
    if field.storage not in STORAGE_TYPES.get(new_type, ()):
        raise ValueError(f"field {name!r} is stored as {field.storage}, which {new_type} cannot be")
    return {**current, name: replace(field, type=new_type)}


def merge_projects(projects: Sequence[DataFrame]) -> dict[str, Field]:
    """Fields over several projects; a field with two types is refused."""
    merged: dict[str, Field] = {}
    for project in projects:
        for name, field in fields_of(project).items():
            if merged.setdefault(name, field).type != field.type:
                raise ValueError(f"field {name!r} is {merged[name].type} in one project and {field.type} in another")
    return merged
