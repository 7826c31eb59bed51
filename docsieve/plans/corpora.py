"""The test tables as projects, and the SQL that reads the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.schema import ID, Field, Snippet, declare
from docsieve.sources.projects import read_project

DOCUMENT_FIELDS = {"text": "text", "lang": "keyword", "source": "keyword", "n_chars": "integer"}
EVENT_FIELDS = {"ts": "date", "event_type": "keyword", "value": "number", "user_id": "integer", "props": "object"}
ORDER_FIELDS = {
    "o_orderdate": "date",
    "o_orderstatus": "keyword",
    "o_totalprice": "number",
    "o_orderpriority": "keyword",
    "o_custkey": "integer",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_project(spark, f"{sf_dir}/documents.parquet", "doc_id", DOCUMENT_FIELDS)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"conv_id": "integer", "turn": "integer", "role": "keyword", "text": "text"}
    return read_project(spark, f"{sf_dir}/conversations.parquet", ["conv_id", "turn"], fields)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_project(spark, f"{sf_dir}/benchmark.parquet", "item_id", {"text": "text"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_project(spark, f"{sf_dir}/events.parquet", "event_id", EVENT_FIELDS)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_project(spark, f"{sf_dir}/orders.parquet", "o_orderkey", ORDER_FIELDS)


def tagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the parts of their priority and their status as tags."""
    parts = F.split(F.concat_ws("-", "o_orderpriority", "o_orderstatus"), "-")
    return declare(orders(spark, sf_dir).withColumn("tags", parts), {"tags": "tag"})


def rated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the two labels that only some of them have."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias(ID),
        F.col("quality").cast("bigint").alias("quality"),
        F.col("toxic").cast("bigint").alias("toxic"),
    )
    joined = documents(spark, sf_dir).join(labels, ID, "left")
    return declare(joined, {**DOCUMENT_FIELDS, "quality": "integer", "toxic": "integer"})


def limited_fields() -> dict[str, Field]:
    """Document fields with access rules for readers who may not see everything."""
    return {
        "text": Field("text", access="snippet", max_snippet=Snippet(40, 2, 30)),
        "lang": Field("keyword", access="read"),
        "source": Field("keyword"),
        "n_chars": Field("integer", access="read"),
    }


DOCUMENTS = "(SELECT CAST(doc_id AS VARCHAR) AS _id, text, lang, source, n_chars FROM documents)"
CONVERSATIONS = (
    "(SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS _id, conv_id, turn, role, text"
    " FROM conversations)"
)
BENCHMARK = "(SELECT CAST(item_id AS VARCHAR) AS _id, text FROM benchmark)"
EVENTS = "(SELECT CAST(event_id AS VARCHAR) AS _id, ts, event_type, value, user_id, props FROM events)"
ORDERS = (
    "(SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderdate, o_orderstatus, o_totalprice, o_orderpriority, o_custkey"
    " FROM orders)"
)
TAGGED_ORDERS = (
    "(SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderdate, o_orderstatus, o_totalprice, o_orderpriority, o_custkey,"
    " string_split(o_orderpriority || '-' || o_orderstatus, '-') AS tags FROM orders)"
)
RATED_DOCUMENTS = (
    "(SELECT CAST(d.doc_id AS VARCHAR) AS _id, d.text, d.lang, d.source, d.n_chars,"
    " CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)

_WORD = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"


def words_sql(column: str) -> str:
    """List of the lower-case words of a text."""
    return f"regexp_extract_all(lower({column}), '{_WORD}')"


def joined_sql(column: str) -> str:
    """Words of a text joined and surrounded by blanks."""
    return f"(' ' || array_to_string({words_sql(column)}, ' ') || ' ')"


def pieces_sql(column: str) -> str:
    """A text as the list of its words, in their own case, and of the single characters between them."""
    return rf"regexp_extract_all({column}, '(?:{_WORD})|(?s:[^\p{{L}}\p{{M}}\p{{N}}_])')"
