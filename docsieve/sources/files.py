"""CSV tables, project exports, folders of texts, and object stores."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docsieve.operators.objects import split_key
from docsieve.schema import ID, SPARK_TYPES, Field, Snippet, declare, fields_of
from docsieve.session import keep


_MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def column_name(name: str) -> str:
    """Field name for a column header."""
    return re.sub(r"^_", "", re.sub(r"[^a-z0-9]", "_", name.lower()))


def source_csv(spark: SparkSession, path: str, separator: str = ",", multiline: bool = True) -> DataFrame:
    """A table with a header, all values as strings, without rows whose cells are all empty.

    Cells may hold line breaks, and big files are split all the same: one job looks whether any line leaves a quote
    open. If none does, files are read line by line. Else lines are numbered by the record they belong to, see
    `_numbered_lines`, put together chunk by chunk and kept in the shared folder. Files whose quotes do not follow the rules (quotes
    inside bare cells) are read by one task each, as Spark does. With ``multiline=False`` nobody looks, and every line
    is a record.

    In a folder all files must have the same columns in the same order, else reading fails. A name that comes twice
    once it is simplified gets a number.
    """
    if not multiline:
        return _simple_names(_csv_reader(spark, separator, False).csv(path))
    whole = _csv_reader(spark, separator, True).csv(path)
    lines = _csv_lines(spark, path)
    # A carriage return inside a line would count as the end of a record, so such lines are put together as well.
    broken = (F.col("odd") == 1) | F.col("value").contains("\r")
    seen = lines.agg(
        F.coalesce(F.bool_or(broken), F.lit(False)).alias("broken"),
        F.coalesce(F.bool_and(_well_quoted(F.col("value"), separator) | broken), F.lit(True)).alias("regular"),
    ).first()
    if not seen["broken"]:
        return _simple_names(_csv_reader(spark, separator, not seen["regular"]).csv(path))
    records = _csv_records(keep(_csv_pieces(_numbered_lines(lines)), "csv-pieces", "zstd"))
    options = {"sep": separator, "escape": '"', "multiLine": "true"}
    schema = ", ".join(f"c{i} string" for i in range(len(whole.columns)))
    cells = F.from_csv("value", schema, options)
    header = F.when(F.col("number") == 1, F.to_json(cells))
    seen = records.agg(
        F.bool_and(_well_quoted(F.col("value"), separator)).alias("regular"),
        (F.min(header) == F.max(header)).alias("alike"),
    ).first()
    if not (seen["regular"] and seen["alike"]):
        return _simple_names(whole)
    rows = records.where("number > 1").select(cells.alias("cells")).select("cells.*")
    return _simple_names(rows.toDF(*whole.columns))


def _csv_reader(spark: SparkSession, separator: str, multiline: bool) -> DataFrameReader:
    reader = spark.read.option("header", True).option("sep", separator).option("multiLine", multiline)
    return reader.option("escape", '"').option("inferSchema", False).option("enforceSchema", False)


def _simple_names(df: DataFrame) -> DataFrame:
    names: list[str] = []
    for name in map(column_name, df.columns):
        number, new = 1, name
        while new in names:
            number += 1
            new = f"{name}_{number}"
        names.append(new)
    return df.toDF(*names).dropna(how="all")


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, chunk (place of a split in its file), place in the chunk, and whether their quotes are odd."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r\z", "").alias("value"),
        F.col("value").endswith("\r").alias("returned"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        # Lines of a chunk come in order, and the numbers given in a task rise.
        F.monotonically_increasing_id().alias("place"),
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.withColumn("odd", F.pmod(quotes, F.lit(2)))


def _well_quoted(record: Column, separator: str) -> Column:
    """Whether all quotes of a record surround whole cells or are doubled, and no bare cell holds a carriage return."""
    border = re.escape(separator)
    bare = F.replace(record, F.lit('""'), F.lit(""))
    bare = F.regexp_replace(bare, rf'(^|{border})"[^"]*"(?={border}|\z)', "$1")
    return ~bare.contains('"') & ~bare.contains("\r")


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines with the ``number`` of their record in the file, from 1, and whether it has ``begun`` in this chunk.

    A line begins a record where the quotes before it are even. Inside a chunk they are counted from its start; whether
    that start lies in a cell, and how many records begin before it, follows from sums over the chunks before, a row
    each. So no task holds more than a chunk, and a file that cannot be split is one chunk.
    """
    chunk = ["file", "chunk"]
    before = Window.partitionBy(*chunk).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*chunk).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)

    def inside(df: DataFrame) -> DataFrame:
        return df.withColumn("inner", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))

    # The records that begin in a chunk, by the parity it starts with.
    sums = inside(lines.select(*chunk, "place", "odd")).groupBy(*chunk).agg(
        F.sum("odd").alias("odds"), F.count_if(F.col("inner") == 0).alias("even_0"), F.count_if(F.col("inner") == 1).alias("even_1")
    )
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("open", F.pmod(F.coalesce(F.sum("odds").over(earlier), F.lit(0)), F.lit(2)))
    begun = F.when(F.col("open") == 0, F.col("even_0")).otherwise(F.col("even_1"))
    sums = sums.select(*chunk, "open", begun.alias("begun")).withColumn("done", F.coalesce(F.sum("begun").over(earlier), F.lit(0)))
    joined = inside(lines).join(sums.drop("begun"), chunk)
    number = F.col("done") + F.sum((F.col("inner") == F.col("open")).cast("bigint")).over(upto)
    numbered = joined.withColumn("number", number)
    return numbered.select("value", "returned", "odd", *chunk, "place", "number", (F.col("number") > F.col("done")).alias("begun"))


def _csv_pieces(lines: DataFrame) -> DataFrame:
    """The part of each record that lies in one chunk, and whether it is the ``whole`` record. Nothing is shuffled."""
    line = F.struct("place", "value", "returned")
    pieces = lines.groupBy("file", "chunk", "number").agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        (F.bool_or("begun") & (F.pmod(F.sum("odd"), F.lit(2)) == 0)).alias("whole"),
    )
    text = F.transform("lines", lambda p: F.concat(p["value"], F.when(p["returned"], "\r\n").otherwise("\n")))
    pieces = pieces.select("file", "chunk", "number", "whole", F.array_join(text, "").alias("value"))
    return pieces.sortWithinPartitions("file", "chunk", "number")


def _csv_records(pieces: DataFrame) -> DataFrame:
    """Records with their ``number``. Only what goes on in another chunk, two pieces a chunk at most, is brought together."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "value")))
    joined = F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value")
    others = pieces.where("not whole").groupBy("file", "number").agg(joined)
    records = pieces.where("whole").select("number", "value").unionByName(others.select("number", "value"))
    return records.withColumn("value", F.regexp_replace("value", r"\r?\n\z", ""))


def sink_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """Write a selection or bucket rows with a header. Arrays become JSON."""
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else f.name
        for f in df.schema.fields
    ]
    writer = df.select(*columns).write.option("header", True).option("sep", separator)
    writer = writer.option("escape", '"').option("quoteAll", True).option("timestampNTZFormat", _MOMENT)
    writer.mode("overwrite").csv(path)


# Types of the tagged lines in an export.
_SETTINGS, _FIELD, _ROLE, _DOCUMENT = "settings", "field", "user_role", "document"
# The folders of an export: documents, and all other lines.
_PART, _HEAD = "part", "head"


def _field_line(name: str, field: Field) -> dict[str, Any]:
    limit = field.max_snippet
    snippet = limit and {
        "nomatch_chars": limit.nomatch_chars,
        "max_matches": limit.max_matches,
        "match_chars": limit.match_chars,
    }
    return {
        "_type": _FIELD,
        "name": name,
        "type": field.type,
        "elastic_type": field.storage,
        "identifier": field.identifier,
        "metareader": {"access": field.access, "max_snippet": snippet},
        "client_settings": {},
    }


def sink_export(
    df: DataFrame,
    path: str,
    settings: Mapping[str, Any] | None = None,
    roles: Iterable[tuple[str, str]] = (),
    compression: str | None = "gzip",
) -> None:
    """Write a project as tagged JSON lines: settings, fields, roles (none that give no access) and documents.

    Documents lie in a folder of their own beside the other lines, so that these are found without reading documents.
    """
    spark, fields = df.sparkSession, fields_of(df)
    head: list[dict[str, Any]] = [{"_type": _SETTINGS, **(settings or {})}]
    head += [_field_line(name, field) for name, field in fields.items()]
    head += [{"_type": _ROLE, "email": email, "role": role} for email, role in roles if role != "NONE"]
    lines = spark.createDataFrame([(json.dumps(line), _HEAD) for line in head], f"value string, {_PART} string").coalesce(1)
    values = [_as_json(df, name, field) for name, field in fields.items()]
    record = F.struct(F.lit(_DOCUMENT).alias("_type"), F.col(ID), *values)
    documents = df.select(F.to_json(record, {"timestampNTZFormat": _MOMENT}).alias("value"))

    def writer(rows: DataFrame):
        made = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        return made.option("compression", compression) if compression else made

    writer(lines).partitionBy(_PART).text(path)
    writer(documents).text(f"{path}/{_PART}={_DOCUMENT}")


def _as_json(df: DataFrame, name: str, field: Field):
    if field.type == "object" and isinstance(df.schema[name].dataType, T.StringType):
        return F.try_parse_json(name).alias(name)
    return F.col(name)


_LEADING_TYPE = r'^\s*\{\s*"_type"\s*:\s*"(\w+)"'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an export with their type. It is the first key of a line; only where it is not, the line is parsed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    leading = F.nullif(F.regexp_extract("value", _LEADING_TYPE, 1), F.lit(""))
    return lines.withColumn("line_type", F.coalesce(leading, F.get_json_object("value", "$._type")))


def _part(lines: DataFrame, name: str) -> DataFrame:
    """Lines in one folder of the export; all lines if it is not laid out in folders."""
    return lines.where(F.col(_PART) == name) if _PART in lines.columns else lines


def _head(lines: DataFrame, line_type: str) -> DataFrame:
    return _part(lines, _HEAD).where(F.col("line_type") == line_type).select("value")


def _field(line: Mapping[str, Any]) -> Field:
    reader = line.get("metareader") or {}
    limit = reader.get("max_snippet")
    return Field(
        line["type"],
        line.get("elastic_type"),
        bool(line.get("identifier")),
        reader.get("access", "none"),
        Snippet(**limit) if limit else None,
    )


def _fields(texts: Iterable[str]) -> dict[str, Field]:
    lines = map(json.loads, texts)
    return {line["name"]: _field(line) for line in lines}


def export_fields(lines: DataFrame) -> dict[str, Field]:
    """Field settings from the few field lines of an export."""
    return _fields(row["value"] for row in _head(lines, _FIELD).collect())


def export_roles(lines: DataFrame) -> DataFrame:
    """Role rules of an export, without those that give no access."""
    roles = _head(lines, _ROLE).select(
        F.get_json_object("value", "$.email").alias("email"), F.get_json_object("value", "$.role").alias("role")
    )
    return roles.where("role <> 'NONE'")


def export_settings(lines: DataFrame) -> dict[str, Any] | None:
    row = _head(lines, _SETTINGS).first()
    if row is None:
        return None
    settings = json.loads(row["value"])
    settings.pop("_type")
    return settings


def _fields_or_keys(lines: DataFrame) -> dict[str, Field]:
    """What the field lines declare; if there are none, the keys of all documents as strings. Both in one reading.

    Lines and keys are made distinct in the tasks first, so the driver gets a row per field.
    """
    items = F.when(F.col("line_type") == _FIELD, F.array("value")).when(F.col("line_type") == _DOCUMENT, F.json_object_keys("value"))
    found = lines.select("line_type", F.explode(items).alias("item")).distinct().collect()
    declared = _fields(row["item"] for row in found if row["line_type"] == _FIELD)
    keys = sorted(row["item"] for row in found if row["line_type"] == _DOCUMENT)
    return declared or {key: Field("keyword") for key in keys if key not in ("_type", ID)}


def source_export(spark: SparkSession, path: str, fields: Mapping[str, Field] | None = None) -> DataFrame:
    """Documents of an export, plain or gzip, with the fields its own field lines declare.

    Documents are read only once if ``fields`` are given or the export is one of ``sink_export``; other files are
    looked through for field lines before. Without field lines, the union of the keys of all documents makes string
    fields. Ids that follow from identifiers are left out, to be made again when the documents are written.
    """
    lines = read_lines(spark, path)
    if not fields and _PART in lines.columns:
        fields = export_fields(lines)
    fields = fields or _fields_or_keys(lines)
    documents = _part(lines, _DOCUMENT).where(F.col("line_type") == _DOCUMENT)
    schema = T.StructType([T.StructField(ID, T.StringType())])
    for name, field in fields.items():
        dtype = T.VariantType() if field.type == "object" else SPARK_TYPES[field.type]
        schema.add(T.StructField(name, dtype))
    parsed = documents.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    objects = {n: F.to_json(F.col(n)) for n, f in fields.items() if f.type == "object"}
    parsed = parsed.withColumns(objects) if objects else parsed
    if any(f.identifier for f in fields.values()):
        parsed = parsed.drop(ID)
    return declare(parsed, fields)


def _plain_path(path: str) -> str:
    """A path without the scheme of its file system."""
    return re.sub(r"^\w+:/*", "/", path)


def source_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``.txt`` file below a folder: filename, folder (if any file has one), text, date of change."""
    root = path.rstrip("/")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    files = reader.text(root, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    plain = F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B")))
    # The part behind the chosen folder, whatever scheme the file system puts before it.
    below = F.substring_index(plain, _plain_path(root) + "/", -1)
    rows = files.select(
        F.regexp_replace(F.substring_index(below, "/", -1), r"\.[^.]+$", "").alias("filename"),
        F.regexp_extract(below, r"^(.*)/[^/]*$", 1).alias("folder"),
        F.col("value").alias("text"),
        F.to_date("file_modification_time").alias("date"),
    ).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    # Most folders without subfolders are told by their file names alone, which reads no text.
    names = reader.format("binaryFile").load(root).select(F.substring_index("path", _plain_path(root) + "/", -1).alias("name"))
    if names.where(F.col("name").contains("/")).isEmpty() or rows.where("folder <> ''").isEmpty():
        return rows.drop("folder")
    return rows.withColumn("folder", F.when(F.col("folder") == "", F.lit(".")).otherwise(F.col("folder")))


def scan_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Files of a store below a prefix: key, size, time of change. File contents are not read."""
    base = root.rstrip("/")
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{base}/{prefix}".rstrip("/"))
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    key = F.substring_index(F.col("path"), _plain_path(base) + "/", -1)
    return found.select(key.alias("key"), "size", "modified")


def store_listing(objects: DataFrame) -> DataFrame:
    """Listed keys as register entries."""
    return objects.select(*[c.alias(n) for n, c in split_key(F.col("key")).items()], "size")


def export_batches(df: DataFrame, path: str, size: int, columns: Sequence[str] | None = None) -> None:
    """The whole result as files of at most ``size`` rows, written by all tasks at once."""
    chosen = df.select(*columns) if columns else df
    chosen.write.mode("overwrite").option("maxRecordsPerFile", size).parquet(path)
