"""Queries that shape bucket rows, and that go back from a bucket to its documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docsieve.operators.aggregate import Axis, aggregate, field_stats
from docsieve.operators.scroll import numbered
from docsieve.operators.shape import (
    auto_interval,
    column_stats,
    drill_down,
    in_part_order,
    keep_top_columns,
    label_parts,
    pivot_wide,
    sort_by_total,
    zero_fill_dates,
    zero_fill_parts,
)
from docsieve.plans.corpora import DOCUMENTS, EVENTS, ORDERS, documents, events, joined_sql, orders
from docsieve.plans.registry import query

N = joined_sql("text")
LANGS = ["en", "de", "fr", "es"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _cells(column: str, values, rows: str) -> str:
    cells = ", ".join(f"CAST(count(*) FILTER ({column} = '{v}') AS BIGINT) AS \"{v}\"" for v in values)
    return f"{rows}, {cells}"


@query("pivot_wide", f"SELECT {_cells('lang', LANGS, 'source')} FROM {DOCUMENTS} GROUP BY source")
def _(spark, sf_dir):
    buckets = aggregate(documents(spark, sf_dir), ["source", "lang"])
    return pivot_wide(buckets, "source", "lang", LANGS)


@query(
    "zero_fill_dates",
    f"""WITH hits AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate_month, count(*) AS n
          FROM {ORDERS} WHERE o_totalprice > 495000 GROUP BY ALL),
        months AS (SELECT CAST(unnest(generate_series(min(o_orderdate_month), max(o_orderdate_month),
          INTERVAL 1 MONTH)) AS DATE) AS o_orderdate_month FROM hits)
        SELECT o_orderdate_month, coalesce(n, 0) AS n FROM months LEFT JOIN hits USING (o_orderdate_month)""",
)
def _(spark, sf_dir):
    axes, filters = [Axis("o_orderdate", "month")], {"o_totalprice": {"gt": 495000}}
    return zero_fill_dates(aggregate(orders(spark, sf_dir), axes, filters=filters), "o_orderdate_month", "month")


@query(
    "zero_fill_parts",
    f"""WITH hits AS (SELECT month(ts) AS ts_monthnr, count(*) AS n FROM {EVENTS} GROUP BY ALL)
        SELECT CAST(m AS INTEGER) AS ts_monthnr, coalesce(n, 0) AS n
        FROM (SELECT unnest(range(1, 13)) AS m) LEFT JOIN hits ON m = ts_monthnr""",
)
def _(spark, sf_dir):
    buckets = aggregate(events(spark, sf_dir), [Axis("ts", "monthnr")])
    return zero_fill_parts(buckets, "ts_monthnr", "monthnr")


@query(
    "zero_fill_decades",
    f"""WITH hits AS (SELECT (year(o_orderdate) // 10) * 10 AS o_orderdate_decade, count(*) AS n
          FROM {ORDERS} GROUP BY ALL)
        SELECT CAST(d AS INTEGER) AS o_orderdate_decade, coalesce(n, 0) AS n
        FROM (SELECT unnest(range(min(o_orderdate_decade), max(o_orderdate_decade) + 1, 10)) AS d FROM hits)
        LEFT JOIN hits ON d = o_orderdate_decade""",
)
def _(spark, sf_dir):
    buckets = aggregate(orders(spark, sf_dir), [Axis("o_orderdate", "decade")])
    return zero_fill_parts(buckets, "o_orderdate_decade", "decade")


@query(
    "label_parts",
    f"""SELECT monthname(o_orderdate) AS o_orderdate_monthnr, CAST(month(o_orderdate) AS INTEGER) AS rank,
          count(*) AS n FROM {ORDERS} GROUP BY ALL""",
)
def _(spark, sf_dir):
    buckets = aggregate(orders(spark, sf_dir), [Axis("o_orderdate", "monthnr")])
    return label_parts(buckets, "o_orderdate_monthnr", "monthnr")


@query(
    "order_parts",
    f"""SELECT dayname(ts) AS ts_dayofweek, count(*) AS n, CAST(isodow(min(ts)) AS BIGINT) AS place
        FROM {EVENTS} GROUP BY dayname(ts)""",
)
def _(spark, sf_dir):
    buckets = aggregate(events(spark, sf_dir), [Axis("ts", "dayofweek")])
    return numbered(in_part_order(buckets, "ts_dayofweek", "dayofweek"), "place")


@query(
    "sort_by_total",
    f"""SELECT *, row_number() OVER (ORDER BY "en" + "de" + "fr" + "es" DESC, source) AS place
        FROM (SELECT {_cells("lang", LANGS, "source")} FROM {DOCUMENTS} GROUP BY source)""",
)
def _(spark, sf_dir):
    wide = pivot_wide(aggregate(documents(spark, sf_dir), ["source", "lang"]), "source", "lang", LANGS)
    return numbered(sort_by_total(wide, LANGS), "place")


@query(
    "column_stats",
    f"""WITH wide AS (SELECT {_cells("lang", LANGS, "source")} FROM {DOCUMENTS} GROUP BY source),
        long AS (SELECT name, cell FROM (UNPIVOT wide ON "en", "de", "fr", "es" INTO NAME name VALUE cell))
        SELECT name, CAST(sum(cell) AS BIGINT) AS sum, (SELECT min(cell) FROM long) AS low,
          (SELECT max(cell) FROM long) AS high FROM long GROUP BY name""",
)
def _(spark, sf_dir):
    wide = pivot_wide(aggregate(documents(spark, sf_dir), ["source", "lang"]), "source", "lang", LANGS)
    return column_stats(wide, LANGS)


@query(
    "top_columns",
    f"""WITH cells AS (SELECT lang, source, count(*) AS n FROM {DOCUMENTS} GROUP BY ALL),
        top AS (SELECT source FROM cells GROUP BY source ORDER BY sum(n) DESC, source LIMIT 10)
        SELECT lang, source, n FROM cells WHERE source IN (SELECT source FROM top)""",
)
def _(spark, sf_dir):
    return keep_top_columns(aggregate(documents(spark, sf_dir), ["lang", "source"]), "source")


@query(
    "drill_down",
    f"""SELECT _id, ts, event_type FROM {EVENTS} WHERE event_type = 'click'
        AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND CAST(ts AS DATE) <= DATE '2024-01-12'""",
)
def _(spark, sf_dir):
    axes = [Axis("ts", "week"), "event_type"]
    bucket = {"ts_week": dt.date(2024, 1, 8), "event_type": "click"}
    found = drill_down(events(spark, sf_dir), axes, bucket, filters={"ts": {"lte": "2024-01-12"}})
    return found.select("_id", "ts", "event_type")


@query(
    "drill_down_query",
    f"SELECT _id, lang FROM {DOCUMENTS} WHERE contains({N}, ' eau') AND n_chars >= 1000 AND n_chars < 2000",
)
def _(spark, sf_dir):
    axes, bucket = ["_query", Axis("n_chars", 1000)], {"_query": "pre", "n_chars_1000": 1000}
    found = drill_down(documents(spark, sf_dir), axes, bucket, queries={"func": "the", "pre": "eau*"})
    return found.select("_id", "lang")


@query(
    "auto_interval",
    f"""SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS bucket, 'quarter' AS unit, count(*) AS n
        FROM {ORDERS} GROUP BY ALL""",
)
def _(spark, sf_dir):
    df = orders(spark, sf_dir)
    ends = field_stats(df, "o_orderdate").first()
    interval = auto_interval(ends["min"], ends["max"])
    buckets = aggregate(df, [Axis("o_orderdate", interval, "bucket")])
    return buckets.withColumn("unit", F.lit(interval))
