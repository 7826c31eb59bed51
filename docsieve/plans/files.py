"""Queries that write to files and read them back, and the stream of document batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators.aggregate import Axis, aggregate
from docsieve.plans.corpora import (
    DOCUMENTS,
    EVENTS,
    ORDERS,
    RATED_DOCUMENTS,
    documents,
    events,
    orders,
    rated_documents,
    table,
)
from docsieve.plans.registry import query
from docsieve.schema import declare, fields_of
from docsieve.session import scratch_path
from docsieve.sources.files import (
    export_batches,
    export_fields,
    read_lines,
    scan_objects,
    sink_csv,
    sink_export,
    source_csv,
    source_export,
    source_text_folder,
    store_listing,
)
from docsieve.streaming.ingest import compact, fold, ingest, take, watch_documents


@query("source_csv", f"SELECT _id AS id, text, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM {DOCUMENTS}")
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sink_csv(documents(spark, sf_dir), path)
    return source_csv(spark, path).select("id", "text", "lang", "n_chars")


@query(
    "sink_csv",
    f"""SELECT o_orderstatus, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS o_orderdate_month,
          CAST(count(*) AS VARCHAR) AS n FROM {ORDERS} GROUP BY ALL""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    sink_csv(aggregate(orders(spark, sf_dir), ["o_orderstatus", Axis("o_orderdate", "month")]), path, "\t")
    return source_csv(spark, path, "\t", multiline=False)


@query("sink_export", f"SELECT '_document' AS kind, count(*) AS n FROM {RATED_DOCUMENTS} UNION ALL SELECT '_field', 6")
def _(spark, sf_dir):
    path = scratch_path(spark, "export")
    sink_export(rated_documents(spark, sf_dir), path, {"id": "docs"}, [("a@b.example", "ADMIN"), ("*", "NONE")])
    lines = read_lines(spark, path).where("line_type in ('document', 'field')")
    return lines.groupBy(F.concat(F.lit("_"), "line_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_export",
    f"SELECT _id, text, lang, source, n_chars, coalesce(quality, -1) AS quality FROM {RATED_DOCUMENTS}",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "export")
    sink_export(rated_documents(spark, sf_dir), path)
    documents_back = source_export(spark, path)
    quality = F.coalesce("quality", F.lit(-1).cast("bigint")).alias("quality")
    return documents_back.select("_id", "text", "lang", "source", "n_chars", quality)


@query("source_export_dates", f"SELECT _id, ts, event_type, value, replace(props, ' ', '') AS props FROM {EVENTS}")
def _(spark, sf_dir):
    path = scratch_path(spark, "export")
    sink_export(events(spark, sf_dir), path, compression=None)
    return source_export(spark, path).select("_id", "ts", "event_type", "value", "props")


@query(
    "object_json",
    f"SELECT _id, props, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k FROM {EVENTS}",
)
def _(spark, sf_dir):
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return events(spark, sf_dir).select("_id", "props", value.alias("k"))


def _text_store(spark, sf_dir) -> str:
    """Documents as text files, in one folder per language and source."""
    path = f"{scratch_path(spark, 'store')}/docs/text"
    table(spark, sf_dir, "documents").select("text", "lang", "source").write.partitionBy("lang", "source").option(
        "maxRecordsPerFile", 1000
    ).text(path)
    return path


@query(
    "source_text_folder",
    "SELECT 'lang=' || lang || '/source=' || source AS folder, CAST(sum(length(text) + 1) AS BIGINT) AS chars"
    " FROM documents GROUP BY ALL",
)
def _(spark, sf_dir):
    files = source_text_folder(spark, _text_store(spark, sf_dir))
    return files.groupBy("folder").agg(F.sum(F.length("text")).alias("chars"))


@query(
    "scan_objects",
    "SELECT 'docs' AS index, 'text' AS field, 'lang=' || lang || '/source=' || source AS folder,"
    " CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents WHERE lang = 'en' GROUP BY ALL",
)
def _(spark, sf_dir):
    root = _text_store(spark, sf_dir).removesuffix("/docs/text")
    listed = store_listing(scan_objects(spark, root, "docs/text/lang=en"))
    folder = F.regexp_extract("filepath", "^(.*)/", 1).alias("folder")
    return listed.groupBy("index", "field", folder).agg(F.sum("size").alias("size"))


@query("export_batches", f"SELECT _id, lang, n_chars FROM {DOCUMENTS}")
def _(spark, sf_dir):
    path = scratch_path(spark, "batches")
    export_batches(documents(spark, sf_dir), path, 200, ["_id", "lang", "n_chars"])
    return spark.read.parquet(path)


@query("export_fields", "SELECT 'ts' AS name, 'date' AS type UNION ALL SELECT * FROM (VALUES ('event_type', 'keyword'),"
       " ('value', 'number'), ('user_id', 'integer'), ('props', 'object'))")  # fmt: skip
def _(spark, sf_dir):
    path = scratch_path(spark, "export")
    sink_export(events(spark, sf_dir), path)
    found = export_fields(read_lines(spark, path))
    return spark.createDataFrame([(n, f.type) for n, f in found.items()], "name string, type string")


@query("ingest_batches", f"SELECT _id, ts, event_type, value FROM {EVENTS}")
def _(spark, sf_dir):
    # Half of the fields are stored, the stream brings the rest; sending it twice changes nothing.
    full = events(spark, sf_dir)
    stored = declare(full.select("_id", "ts"), {"ts": "date"})
    sent, staging = scratch_path(spark, "sent"), scratch_path(spark, "staging")
    rest = full.select("_id", "event_type", "value")
    rest.write.parquet(sent)
    for _ in range(2):
        stream = watch_documents(spark, sent, rest.schema)
        ingest(stream, staging, scratch_path(spark, "progress")).awaitTermination()
    new = {n: f for n, f in fields_of(full).items() if n in ("event_type", "value")}
    return fold(stored, staging, "upsert", new).table.select("_id", "ts", "event_type", "value")


@query(
    "ingest_resent",
    f"SELECT _id, CASE WHEN CAST(_id AS BIGINT) % 3 = 0 THEN 'second' ELSE 'first' END AS event_type, value FROM {EVENTS}",
)
def _(spark, sf_dir):
    # One source sends all, another a third of them later; then the first one's batch comes again, twice.
    full = events(spark, sf_dir)
    stored = declare(full.select("_id", "value"), {"value": "number"})
    staging, new = scratch_path(spark, "staging"), {"event_type": "keyword"}
    first = full.select("_id", F.lit("first").alias("event_type"))
    second = first.where("CAST(_id AS BIGINT) % 3 = 0").withColumn("event_type", F.lit("second"))
    take(first, staging, "one", 0)
    take(second, staging, "two", 0)
    take(first, staging, "one", 0)
    compact(stored, staging, "upsert", new)
    take(first, staging, "one", 0)
    return fold(stored, staging, "upsert", new).table.select("_id", "event_type", "value")
