"""Queries that profile and validate incoming tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions import coerce
from docsieve.operators.validate import (
    coerce_rows,
    find_duplicates,
    infer_types,
    invalid_examples,
    missing_media,
    validate_columns,
)
from docsieve.plans.corpora import DOCUMENTS, documents, table
from docsieve.plans.registry import query


def raw_orders(spark, sf_dir):
    """Orders as they would come from a file: strings, some of them broken."""
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(price > 480000, F.lit("unknown")).when(price > 470000, F.lit("2001-02-30")).otherwise(day).alias("day"),
        F.concat(day, F.lit("T10:30:00+02:00")).alias("moment"),
        F.when(price < 20000, F.lit("")).otherwise(price.cast("string")).alias("price"),
        F.concat(F.lit("0"), key.cast("string")).alias("code"),
        F.when(price > 490000, F.lit("3.5")).otherwise(key.cast("string")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", F.lit("True")).otherwise(F.lit("false")).alias("done"),
        F.when(price > 495000, F.lit("yes")).otherwise(F.lit("0")).alias("flag"),
        F.concat(F.lit("https://shop.example/"), F.col("o_orderkey").cast("string")).alias("link"),
        F.regexp_replace("o_orderpriority", "-", " ").alias("priority"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), day).alias("note"),
    )


RAW_ORDERS = """(SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
      CASE WHEN o_totalprice > 480000 THEN 'unknown' WHEN o_totalprice > 470000 THEN '2001-02-30'
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
      strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00+02:00' AS moment,
      CASE WHEN o_totalprice < 20000 THEN '' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
      '0' || CAST(o_custkey AS VARCHAR) AS code,
      CASE WHEN o_totalprice > 490000 THEN '3.5' ELSE CAST(o_custkey AS VARCHAR) END AS amount,
      CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'false' END AS done,
      CASE WHEN o_totalprice > 495000 THEN 'yes' ELSE '0' END AS flag,
      'https://shop.example/' || CAST(o_orderkey AS VARCHAR) AS link,
      replace(o_orderpriority, '-', ' ') AS priority,
      'order ' || CAST(o_orderkey AS VARCHAR) || ' of ' || strftime(o_orderdate, '%Y-%m-%d') AS note
    FROM orders)"""
_COLUMNS = "order_id day moment price code amount done flag link priority note".split()
_ISO = r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?"


def _is_date(column: str) -> str:
    return f"(regexp_full_match({column}, '{_ISO}') AND try_cast({column} AS TIMESTAMPTZ) IS NOT NULL)"


def _is_number(column: str) -> str:
    return rf"regexp_full_match({column}, '-?(0|[1-9]\d*)(\.\d*)?([eE][+-]?\d+)?')"


_DATE, _NUMBER = _is_date("v"), _is_number("v")
_INTEGER = f"coalesce({_NUMBER} AND try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE)), false)"
_BOOLEAN = "lower(v) IN ('true', 'false', '1', '0')"


def _long(columns) -> str:
    parts = [f"SELECT order_id, '{c}' AS name, {c} AS v FROM {RAW_ORDERS}" for c in columns]
    return f"({' UNION ALL '.join(parts)})"


@query(
    "infer_types",
    f"""SELECT name AS "column", CASE
          WHEN count(*) FILTER (NOT {_DATE}) / count(*) < 0.2 THEN 'date'
          WHEN count(*) FILTER (NOT {_NUMBER}) / count(*) < 0.2
            THEN CASE WHEN count(*) FILTER (NOT {_INTEGER}) = 0 THEN 'integer' ELSE 'number' END
          WHEN bool_and(regexp_full_match(v, 'https?://\\S+')) THEN 'url'
          WHEN bool_and({_BOOLEAN}) THEN 'boolean'
          WHEN count(DISTINCT v) / count(*) < 0.5 AND max(length(v)) <= 100 THEN 'keyword'
          WHEN NOT bool_or(contains(v, ' ')) THEN 'keyword' ELSE 'text' END AS type
        FROM {_long(_COLUMNS)} GROUP BY name""",
)
def _(spark, sf_dir):
    return infer_types(raw_orders(spark, sf_dir))


_TYPES = {
    "order_id": "integer",
    "day": "date",
    "price": "number",
    "code": "keyword",
    "amount": "integer",
    "done": "boolean",
    "flag": "boolean",
    "priority": "keyword",
    "note": "text",
}
_BROKEN = f"""CASE type WHEN 'date' THEN NOT {_DATE} WHEN 'number' THEN NOT {_NUMBER} WHEN 'integer' THEN NOT {_INTEGER}
    WHEN 'boolean' THEN NOT {_BOOLEAN} WHEN 'keyword' THEN length(v) > 256 OR v = '' ELSE v = '' END"""
_TYPED = f"""(SELECT *, CASE name {" ".join(f"WHEN '{c}' THEN '{t}'" for c, t in _TYPES.items())} END AS type
    FROM {_long(_TYPES)})"""


@query(
    "validate_columns",
    f"""SELECT name AS "column", type,
          CASE WHEN bad > 0 THEN 'Type invalid' WHEN numeric THEN 'Type warning' ELSE 'Ready' END AS status,
          CASE WHEN bad > 0 AND type IN ('text', 'keyword') THEN 'empty' WHEN bad > 0 THEN 'invalid ' || type
            WHEN numeric THEN 'all numeric' ELSE '' END AS problem, bad AS n
        FROM (SELECT name, type, count(*) FILTER ({_BROKEN}) AS bad,
            type IN ('text', 'keyword') AND bool_and({_NUMBER}) AS numeric FROM {_TYPED} GROUP BY name, type)""",
)
def _(spark, sf_dir):
    return validate_columns(raw_orders(spark, sf_dir), _TYPES)


@query(
    "invalid_examples",
    f"""SELECT name AS "column", CAST(rank AS INTEGER) AS rank, v AS value FROM (
          SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY order_id) AS rank FROM {_TYPED}
          WHERE {_BROKEN} AND name <> 'order_id') WHERE rank <= 100""",
)
def _(spark, sf_dir):
    return invalid_examples(raw_orders(spark, sf_dir), _TYPES, order=["order_id"])


@query(
    "coerce_rows",
    f"""SELECT order_id, CASE WHEN {_is_date("day")} THEN CAST(day AS TIMESTAMP) END AS day,
          coalesce(CASE WHEN {_is_number("price")} THEN CAST(price AS DOUBLE) END, -1) AS price,
          CASE lower(done) WHEN 'true' THEN true WHEN 'false' THEN false END AS done, note FROM {RAW_ORDERS}""",
)
def _(spark, sf_dir):
    types = {"order_id": "keyword", "day": "date", "price": "number", "done": "boolean", "note": "text"}
    rows = coerce_rows(raw_orders(spark, sf_dir), types)
    return rows.withColumn("price", F.coalesce("price", F.lit(-1.0)))


@query(
    "coerce_date",
    f"""SELECT order_id, CAST(strptime(left(moment, 10), '%Y-%m-%d') AS TIMESTAMP) + INTERVAL 510 MINUTE AS moment,
          try_cast(day AS TIMESTAMP) AS day FROM {RAW_ORDERS}""",
)
def _(spark, sf_dir):
    raw = raw_orders(spark, sf_dir)
    moments = {name: coerce.coerce_date(F.col(name)).alias(name) for name in ("moment", "day")}
    return raw.select("order_id", *moments.values())


@query(
    "coerce_number",
    f"SELECT order_id, coalesce(try_cast(price AS DOUBLE), -1) AS price FROM {RAW_ORDERS}",
)
def _(spark, sf_dir):
    price = F.coalesce(coerce.coerce_number(F.col("price")), F.lit(-1.0))
    return raw_orders(spark, sf_dir).select("order_id", price.alias("price"))


@query(
    "coerce_integer",
    f"""SELECT order_id, CASE WHEN contains(amount, '.') THEN -1 ELSE CAST(amount AS BIGINT) END AS amount
        FROM {RAW_ORDERS}""",
)
def _(spark, sf_dir):
    amount = F.coalesce(coerce.coerce_integer(F.col("amount")), F.lit(-1).cast("bigint"))
    return raw_orders(spark, sf_dir).select("order_id", amount.alias("amount"))


@query(
    "coerce_boolean",
    f"""SELECT order_id, lower(done) = 'true' AS done, CASE WHEN flag = '0' THEN 'no' ELSE 'not a boolean' END AS flag
        FROM {RAW_ORDERS}""",
)
def _(spark, sf_dir):
    flag = coerce.coerce_boolean(F.col("flag"))
    shown = F.when(flag, F.lit("yes")).when(~flag, F.lit("no")).otherwise(F.lit("not a boolean"))
    done = coerce.coerce_boolean(F.col("done"))
    return raw_orders(spark, sf_dir).select("order_id", done.alias("done"), shown.alias("flag"))


@query(
    "find_duplicates",
    f"""SELECT md5(text) AS digest, lang, count(*) AS "rows" FROM {DOCUMENTS} GROUP BY text, lang HAVING count(*) > 1""",
)
def _(spark, sf_dir):
    return find_duplicates(documents(spark, sf_dir), ["text", "lang"]).select(F.md5("text").alias("digest"), "lang", "rows")


def media_links(spark, sf_dir):
    """Documents that point to picture files, by source; some are links elsewhere or have another extension."""
    ending = (
        F.when(F.col("lang") == "en", F.lit(".png"))
        .when(F.col("lang") == "fr", F.lit(".JPG"))
        .when(F.col("lang") == "de", F.lit(".mp4"))
        .otherwise(F.lit(".txt"))
    )
    local = F.concat(F.col("source"), F.lit("/"), F.col("lang"), ending)
    link = F.when(F.col("n_chars") > 10000, F.concat(F.lit("https://media.example/"), local)).otherwise(local)
    return documents(spark, sf_dir).select("_id", link.alias("picture"))


_LINKS = f"""(SELECT _id, CASE WHEN n_chars > 10000 THEN 'https://media.example/' ELSE '' END || source || '/' || lang
      || CASE lang WHEN 'en' THEN '.png' WHEN 'fr' THEN '.JPG' WHEN 'de' THEN '.mp4' ELSE '.txt' END AS picture
    FROM {DOCUMENTS})"""


@query(
    "missing_media",
    f"""SELECT picture, count(*) AS n FROM {_LINKS}
        WHERE NOT starts_with(picture, 'http') AND (NOT regexp_matches(picture, '[.](png|JPG)$')
          OR picture NOT IN (SELECT source || '/en.png' FROM documents d JOIN labels l ON d.doc_id = l.doc_id
            WHERE toxic = 1))
        GROUP BY picture""",
)
def _(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("_id"))
    listed = documents(spark, sf_dir).join(toxic, "_id").select(F.concat("source", F.lit("/en.png")).alias("filepath"))
    return missing_media(media_links(spark, sf_dir), "picture", "image", listed.distinct())
