"""Queries that change documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions.coerce import coerce_text, stored_value
from docsieve.functions.ids import doc_hash
from docsieve.functions.tags import tag_add, tag_remove
from docsieve.operators.write import (
    copy_where,
    delete_where,
    tag_where,
    update_where,
    upsert_join,
    write_create,
    write_index,
    write_update,
    write_upsert,
)
from docsieve.plans.corpora import (
    CONVERSATIONS,
    DOCUMENTS,
    ORDERS,
    RATED_DOCUMENTS,
    TAGGED_ORDERS,
    benchmark,
    conversations,
    documents,
    joined_sql,
    orders,
    rated_documents,
    table,
    tagged_orders,
)
from docsieve.plans.registry import query
from docsieve.schema import Field, declare

N = joined_sql("text")


def changes(spark, sf_dir):
    """A batch of changes: rated documents, some of them twice, and new documents from the benchmark."""
    rated = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("_id"),
        F.lit("rated").alias("source"),
        F.when(F.col("quality") == 1, F.lit("good")).alias("lang"),
        F.lit(None).cast("string").alias("text"),
        F.lit(1).alias("position"),
        F.col("toxic"),
    )
    again = rated.where("toxic = 1").withColumns(
        {"source": F.lit("flagged"), "lang": F.lit(None).cast("string"), "position": F.lit(2)}
    )
    new = benchmark(spark, sf_dir).select(
        F.concat(F.lit("b"), "_id").alias("_id"),
        F.lit("bench").alias("source"),
        F.lit(None).cast("string").alias("lang"),
        "text",
        F.lit(3).alias("position"),
    )
    return rated.drop("toxic").unionByName(again.drop("toxic")).unionByName(new)


_CHANGES = """(SELECT CAST(doc_id AS VARCHAR) AS _id, 'rated' AS source, CASE WHEN quality = 1 THEN 'good' END AS lang,
      CAST(NULL AS VARCHAR) AS text, 1 AS position FROM labels
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'flagged', NULL, NULL, 2 FROM labels WHERE toxic = 1
    UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), 'bench', NULL, text, 3 FROM benchmark)"""
_LAST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY position DESC) AS r
    FROM {_CHANGES}) WHERE r = 1)"""
_OVERLAY = f"""(SELECT _id, arg_max(source, position) FILTER (source IS NOT NULL) AS source,
    arg_max(lang, position) FILTER (lang IS NOT NULL) AS lang,
    arg_max(text, position) FILTER (text IS NOT NULL) AS text FROM {_CHANGES} GROUP BY _id)"""


def _shown(df):
    return df.select("_id", "source", "lang", F.md5("text").alias("text"), F.coalesce("n_chars", F.lit(-1)).alias("n"))


_SHOW = "_id, source, lang, md5(text) AS text, coalesce(n_chars, -1) AS n"


@query("upsert_join", f"SELECT DISTINCT _id, _id IN (SELECT _id FROM {DOCUMENTS}) AS stored FROM {_CHANGES}")
def _(spark, sf_dir):
    return upsert_join(documents(spark, sf_dir), changes(spark, sf_dir))


@query(
    "write_index",
    f"""SELECT {_SHOW} FROM (
          SELECT _id, source, lang, text, n_chars FROM {DOCUMENTS} WHERE _id NOT IN (SELECT _id FROM {_CHANGES})
          UNION ALL SELECT _id, source, lang, text, NULL FROM {_LAST})""",
)
def _(spark, sf_dir):
    return _shown(write_index(documents(spark, sf_dir), changes(spark, sf_dir), position="position").table)


@query(
    "write_create",
    f"""SELECT {_SHOW} FROM (
          SELECT _id, source, lang, text, n_chars FROM {DOCUMENTS}
          UNION ALL SELECT _id, source, lang, text, NULL FROM {_LAST} WHERE _id NOT IN (SELECT _id FROM {DOCUMENTS}))""",
)
def _(spark, sf_dir):
    return _shown(write_create(documents(spark, sf_dir), changes(spark, sf_dir), position="position").table)


@query(
    "write_create_failures",
    f"SELECT DISTINCT _id FROM {_CHANGES} WHERE _id IN (SELECT _id FROM {DOCUMENTS})",
)
def _(spark, sf_dir):
    return write_create(documents(spark, sf_dir), changes(spark, sf_dir), position="position").failures


@query(
    "write_update",
    f"""SELECT {_SHOW} FROM (
          SELECT d._id, coalesce(c.source, d.source) AS source, coalesce(c.lang, d.lang) AS lang,
            coalesce(c.text, d.text) AS text, d.n_chars
          FROM {DOCUMENTS} d LEFT JOIN {_OVERLAY} c ON d._id = c._id)""",
)
def _(spark, sf_dir):
    return _shown(write_update(documents(spark, sf_dir), changes(spark, sf_dir), position="position").table)


@query(
    "write_update_failures",
    f"SELECT DISTINCT _id FROM {_CHANGES} WHERE _id NOT IN (SELECT _id FROM {DOCUMENTS})",
)
def _(spark, sf_dir):
    return write_update(documents(spark, sf_dir), changes(spark, sf_dir), position="position").failures


_UPSERTED = f"""(SELECT coalesce(d._id, c._id) AS _id, coalesce(c.source, d.source) AS source,
      coalesce(c.lang, d.lang) AS lang, coalesce(c.text, d.text) AS text, d.n_chars
    FROM {DOCUMENTS} d FULL JOIN {_OVERLAY} c ON d._id = c._id)"""


@query("write_upsert", f"SELECT {_SHOW} FROM {_UPSERTED}")
def _(spark, sf_dir):
    return _shown(write_upsert(documents(spark, sf_dir), changes(spark, sf_dir), position="position").table)


@query(
    "write_with_ids",
    f"""SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r
        FROM {CONVERSATIONS}) WHERE r = 1""",
)
def _(spark, sf_dir):
    # The id follows from conversation and role: a later turn replaces an earlier one, in the batch and in the store.
    turns = conversations(spark, sf_dir).select("conv_id", "role", "text", "turn")
    fields = {
        "conv_id": Field("integer", identifier=True),
        "role": Field("keyword", identifier=True),
        "text": Field("text"),
    }
    empty = declare(turns.drop("turn").limit(0).withColumn("_id", F.lit("")), fields)
    first = write_index(empty, turns.where("role = 'user'"), position="turn").table
    return write_index(first, turns, position="turn").table.select("conv_id", "role", "text")


@query("doc_hash", f"SELECT conv_id, role, count(*) AS n FROM {CONVERSATIONS} GROUP BY conv_id, role")
def _(spark, sf_dir):
    made = conversations(spark, sf_dir).withColumn("made_id", doc_hash(["role", "conv_id"]))
    grouped = made.groupBy("made_id").agg(
        F.min("conv_id").alias("conv_id"), F.max("role").alias("role"), F.count(F.lit(1)).alias("n")
    )
    return grouped.drop("made_id")


_OLD_ENGLISH = f"(lang = 'en' AND n_chars < 2000 AND contains({N}, ' the '))"


@query(
    "update_where",
    f"SELECT _id, CASE WHEN {_OLD_ENGLISH} THEN 'short' ELSE source END AS source, lang FROM {DOCUMENTS}",
)
def _(spark, sf_dir):
    filters = {"lang": "en", "n_chars": {"lt": 2000}}
    edited = update_where(documents(spark, sf_dir), "source", "short", "the", filters)
    return edited.table.select("_id", "source", "lang")


@query(
    "update_where_report",
    f"SELECT count(*) FILTER ({_OLD_ENGLISH}) AS updated, count(*) FILTER ({_OLD_ENGLISH}) AS total FROM {DOCUMENTS}",
)
def _(spark, sf_dir):
    filters = {"lang": "en", "n_chars": {"lt": 2000}}
    return update_where(documents(spark, sf_dir), "source", "short", "the", filters).report


@query(
    "update_where_null",
    f"""SELECT _id, CASE WHEN quality = 0 THEN NULL ELSE lang END AS lang, source FROM {RATED_DOCUMENTS}""",
)
def _(spark, sf_dir):
    edited = update_where(rated_documents(spark, sf_dir), "lang", None, filters={"quality": [0]})
    return edited.table.select("_id", "lang", "source")


@query("delete_where", f"SELECT _id, lang FROM {RATED_DOCUMENTS} WHERE NOT coalesce(toxic = 1, false)")
def _(spark, sf_dir):
    return delete_where(rated_documents(spark, sf_dir), filters={"toxic": [1]}).table.select("_id", "lang")


@query(
    "delete_where_report",
    f"SELECT count(*) AS updated, count(*) AS total FROM {RATED_DOCUMENTS} WHERE toxic = 1",
)
def _(spark, sf_dir):
    return delete_where(rated_documents(spark, sf_dir), filters={"toxic": [1]}).report


_CHOSEN = "(o_totalprice >= 250000 AND o_orderstatus IN ('P', 'F'))"
_FILTERS = {"o_totalprice": {"gte": 250000}, "o_orderstatus": ["P", "F"]}


@query(
    "tag_where",
    f"""SELECT _id, array_to_string(CASE WHEN {_CHOSEN} AND NOT list_contains(tags, 'LOW')
          THEN list_append(tags, 'LOW') ELSE tags END, ',') AS tags FROM {TAGGED_ORDERS}""",
)
def _(spark, sf_dir):
    edited = tag_where(tagged_orders(spark, sf_dir), "add", "tags", "LOW", filters=_FILTERS)
    return edited.table.select("_id", F.array_join("tags", ",").alias("tags"))


@query(
    "tag_where_report",
    f"""SELECT count(*) FILTER ({_CHOSEN} AND NOT list_contains(tags, 'LOW')) AS updated,
          count(*) FILTER ({_CHOSEN}) AS total FROM {TAGGED_ORDERS}""",
)
def _(spark, sf_dir):
    return tag_where(tagged_orders(spark, sf_dir), "add", "tags", "LOW", filters=_FILTERS).report


@query(
    "tag_where_remove",
    f"""SELECT _id, coalesce(array_to_string(CASE WHEN {_CHOSEN} THEN list_filter(tags, lambda t: t <> 'P')
          ELSE tags END, ','), '') AS tags FROM {TAGGED_ORDERS}""",
)
def _(spark, sf_dir):
    edited = tag_where(tagged_orders(spark, sf_dir), "remove", "tags", "P", filters=_FILTERS)
    return edited.table.select("_id", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


@query(
    "tag_add",
    f"""SELECT _id, array_to_string(CASE WHEN list_contains(tags, 'F') THEN tags ELSE list_append(tags, 'F') END, ',')
          AS tags FROM {TAGGED_ORDERS}""",
)
def _(spark, sf_dir):
    return tagged_orders(spark, sf_dir).select("_id", F.array_join(tag_add(F.col("tags"), "F"), ",").alias("tags"))


@query(
    "tag_remove",
    f"SELECT _id, array_to_string(list_filter(tags, lambda t: t <> 'O'), ',') AS tags FROM {TAGGED_ORDERS}",
)
def _(spark, sf_dir):
    return tagged_orders(spark, sf_dir).select("_id", F.array_join(tag_remove(F.col("tags"), "O"), ",").alias("tags"))


@query(
    "coerce_tag",
    f"SELECT _id, o_orderstatus AS one, array_to_string(list_transform(tags, lambda t: t), '+') AS many FROM {TAGGED_ORDERS}",
)
def _(spark, sf_dir):
    df = tagged_orders(spark, sf_dir)
    one = stored_value(F.col("o_orderstatus"), df.schema["o_orderstatus"].dataType, "tag")
    many = stored_value(F.col("tags"), df.schema["tags"].dataType, "tag")
    return df.select("_id", F.array_join(one, "+").alias("one"), F.array_join(many, "+").alias("many"))


@query("coerce_text", f"SELECT _id, CAST(o_custkey AS VARCHAR) AS text FROM {ORDERS}")
def _(spark, sf_dir):
    return orders(spark, sf_dir).select("_id", coerce_text(F.col("o_custkey")).alias("text"))


@query(
    "copy_where",
    f"""SELECT _id, body, lang, coalesce(length, '') AS length FROM (
          SELECT c._id, c.text AS body, NULL AS lang, NULL AS length FROM {CONVERSATIONS} c
          UNION ALL SELECT _id, text, lang, CAST(n_chars AS VARCHAR) FROM {DOCUMENTS}
          WHERE lang = 'en' AND contains({N}, ' of the '))""",
)
def _(spark, sf_dir):
    destination = conversations(spark, sf_dir).select("_id", F.col("text").alias("body"))
    options = {
        "text": {"rename": "body"},
        "source": {"exclude": True},
        "n_chars": {"rename": "length", "type": "keyword"},
    }
    copied = copy_where(
        documents(spark, sf_dir),
        declare(destination, {"body": "text"}),
        queries='"of the"',
        filters={"lang": "en"},
        field_options=options,
    )
    return copied.withColumn("length", F.coalesce("length", F.lit("")))
