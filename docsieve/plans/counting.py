"""Queries that count and summarise documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions.dates import PARTS
from docsieve.operators.aggregate import (
    Axis,
    Metric,
    TopHits,
    aggregate,
    bucket_page,
    field_stats,
    field_values,
    ordered,
)
from docsieve.operators.scroll import numbered
from docsieve.plans.corpora import (
    BENCHMARK,
    CONVERSATIONS,
    DOCUMENTS,
    EVENTS,
    ORDERS,
    RATED_DOCUMENTS,
    TAGGED_ORDERS,
    benchmark,
    conversations,
    documents,
    events,
    joined_sql,
    orders,
    rated_documents,
    tagged_orders,
)
from docsieve.plans.registry import query
from docsieve.sources.projects import scan_multi

N = joined_sql("text")


@query("agg_count", f"SELECT count(*) AS n FROM {DOCUMENTS}")
def _(spark, sf_dir):
    return aggregate(documents(spark, sf_dir))


@query("agg_terms", f"SELECT source, count(*) AS n FROM {DOCUMENTS} GROUP BY source")
def _(spark, sf_dir):
    return aggregate(documents(spark, sf_dir), ["source"])


@query("agg_terms_number", f"SELECT quality, count(*) AS n FROM {RATED_DOCUMENTS} WHERE quality IS NOT NULL GROUP BY quality")
def _(spark, sf_dir):
    return aggregate(rated_documents(spark, sf_dir), ["quality"])


@query(
    "agg_terms_tag",
    f"SELECT tags, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tags FROM {TAGGED_ORDERS}) GROUP BY tags",
)
def _(spark, sf_dir):
    return aggregate(tagged_orders(spark, sf_dir), ["tags"])


@query(
    "agg_multi_axis",
    f"""SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_yearnr, o_orderpriority, count(*) AS n
        FROM {ORDERS} GROUP BY ALL""",
)
def _(spark, sf_dir):
    return aggregate(orders(spark, sf_dir), ["o_orderstatus", Axis("o_orderdate", "yearnr"), "o_orderpriority"])


def _bucket(interval: str, sql: str) -> None:
    @query(
        f"agg_date_bucket_{interval}",
        f"SELECT {sql} AS o_orderdate_{interval}, count(*) AS n FROM {ORDERS} GROUP BY ALL",
    )
    def _(spark, sf_dir):
        return aggregate(orders(spark, sf_dir), [Axis("o_orderdate", interval)])


for _unit in ("day", "week", "month", "year"):
    _bucket(_unit, f"CAST(date_trunc('{_unit}', o_orderdate) AS DATE)")
_bucket("quarter", "CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP)")


@query(
    "agg_date_bucket",
    f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts_hour, event_type, count(*) AS n
        FROM {EVENTS} GROUP BY ALL""",
)
def _(spark, sf_dir):
    return aggregate(events(spark, sf_dir), [Axis("ts", "hour"), "event_type"])


@query(
    "agg_number_bucket",
    f"""SELECT floor(o_totalprice / 50000.0) * 50000.0 AS price, (o_custkey // 100) * 100 AS customers, count(*) AS n
        FROM {ORDERS} GROUP BY ALL""",
)
def _(spark, sf_dir):
    axes = [Axis("o_totalprice", 50000, "price"), Axis("o_custkey", 100, "customers")]
    return aggregate(orders(spark, sf_dir), axes)


_PART_SQL = {
    "dayofweek": "dayname(ts)",
    "daypart": "CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning'"
    " WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END",
    "monthnr": "CAST(month(ts) AS INTEGER)",
    "yearnr": "CAST(year(ts) AS INTEGER)",
    "decade": "CAST((year(ts) // 10) * 10 AS INTEGER)",
    "dayofmonth": "CAST(day(ts) AS INTEGER)",
    "weeknr": "CAST(week(ts) AS INTEGER)",
}


def _part(part: str) -> None:
    @query(f"part_{part}", f"SELECT _id, {_PART_SQL[part]} AS part FROM {EVENTS}")
    def _(spark, sf_dir):
        return events(spark, sf_dir).select("_id", PARTS[part](F.col("ts")).alias("part"))


for _name in _PART_SQL:
    _part(_name)


@query(
    "agg_datepart",
    f"""SELECT {_PART_SQL["dayofweek"]} AS ts_dayofweek, {_PART_SQL["daypart"]} AS ts_daypart,
          {_PART_SQL["weeknr"]} AS ts_weeknr, count(*) AS n FROM {EVENTS} GROUP BY ALL""",
)
def _(spark, sf_dir):
    return aggregate(events(spark, sf_dir), [Axis("ts", p) for p in ("dayofweek", "daypart", "weeknr")])


@query(
    "agg_by_query",
    f"""WITH d AS (SELECT {N} AS words FROM {DOCUMENTS})
        SELECT 'that' AS _query, count(*) AS n FROM d WHERE contains(words, ' that ')
        UNION ALL SELECT 'start', count(*) FROM d WHERE contains(words, ' eau')
        UNION ALL SELECT 'phrase', count(*) FROM d WHERE contains(words, ' of the ')
        UNION ALL SELECT 'both', count(*) FROM d WHERE contains(words, ' der ') AND contains(words, ' und ')""",
)
def _(spark, sf_dir):
    queries = {"that": "that", "start": "eau*", "phrase": '"of the"', "both": "der AND und"}
    return aggregate(documents(spark, sf_dir), ["_query"], queries=queries)


@query(
    "agg_by_query_axis",
    f"""WITH d AS (SELECT {N} AS words, lang, n_chars FROM {DOCUMENTS}),
        hits AS (SELECT 'func' AS _query, * FROM d WHERE contains(words, ' the ')
          UNION ALL SELECT 'pre', * FROM d WHERE contains(words, ' eau')
          UNION ALL SELECT 'phrase', * FROM d WHERE contains(words, ' of the '))
        SELECT _query, lang, count(*) AS n, avg(n_chars) AS avg_n_chars FROM hits GROUP BY _query, lang""",
)
def _(spark, sf_dir):
    queries = {"func": "the", "pre": "eau*", "phrase": '"of the"'}
    return aggregate(documents(spark, sf_dir), ["_query", "lang"], [Metric("n_chars", "avg")], queries=queries)


_MANY_WORDS = (
    "the of ci de and to in la en a der is that n que on it for le er as was be die with re ou an des und by es this "
    "et are ch at st from les"
).split()


@query(
    "agg_by_query_many",
    f"""WITH w AS (SELECT _id, lang, unnest(list_distinct(regexp_extract_all(lower(text),
          '[\\p{{L}}\\p{{M}}\\p{{N}}_]+(?:[''’.][\\p{{L}}\\p{{M}}\\p{{N}}_]+)*'))) AS _query FROM {DOCUMENTS})
        SELECT _query, lang, count(*) AS n FROM w
        WHERE _query IN ({", ".join(f"'{w}'" for w in _MANY_WORDS)}) OR _query = lang GROUP BY _query, lang""",
)
def _(spark, sf_dir):
    # Forty labels in one pass over the texts. Only the text field is asked.
    queries = {w: f"text:{w}" for w in _MANY_WORDS}
    return aggregate(documents(spark, sf_dir), ["_query", "lang"], queries=queries)


@query(
    "agg_metrics",
    f"""SELECT event_type, count(*) AS n, round(sum(value), 2) AS sum_value, round(avg(value), 6) AS mean,
          min(value) AS min_value, max(value) AS max_value, CAST(sum(user_id) AS BIGINT) AS sum_user_id
        FROM {EVENTS} GROUP BY event_type""",
)
def _(spark, sf_dir):
    metrics = [
        Metric("value", "sum"),
        Metric("value", "avg", "mean"),
        Metric("value", "min"),
        Metric("value", "max"),
        Metric("user_id", "sum"),
    ]
    result = aggregate(events(spark, sf_dir), ["event_type"], metrics)
    return result.withColumns({"sum_value": F.round("sum_value", 2), "mean": F.round("mean", 6)})


@query(
    "agg_metrics_all",
    f"SELECT count(*) AS n, avg(quality) AS avg_quality, max(n_chars) AS max_n_chars FROM {RATED_DOCUMENTS}",
)
def _(spark, sf_dir):
    metrics = [Metric("quality", "avg"), Metric("n_chars", "max")]
    return aggregate(rated_documents(spark, sf_dir), [], metrics)


@query(
    "agg_metrics_date",
    f"""SELECT event_type, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts,
          make_timestamp(CAST(round(avg(epoch_us(ts)) / 1000) AS BIGINT) * 1000) AS avg_ts
        FROM {EVENTS} GROUP BY event_type""",
)
def _(spark, sf_dir):
    metrics = [Metric("ts", "min"), Metric("ts", "max"), Metric("ts", "avg")]
    result = aggregate(events(spark, sf_dir), ["event_type"], metrics)
    # Averages are compared to the millisecond.
    days, rest = F.date_trunc("day", "avg_ts").cast("timestamp_ntz"), F.extract(F.lit("SECOND"), "avg_ts")
    seconds = F.hour("avg_ts") * 3600 + F.minute("avg_ts") * 60 + F.round(rest, 3)
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return result.withColumn("avg_ts", days + interval)


@query(
    "agg_metrics_more",
    f"""SELECT event_type, count(*) AS n, count(value) AS value_count_value,
          count(DISTINCT dayname(ts)) AS weekdays, round(mad(value), 6) AS spread
        FROM {EVENTS} GROUP BY event_type""",
)
def _(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("weekday", PARTS["dayofweek"](F.col("ts")))
    metrics = [
        Metric("value", "value_count"),
        Metric("weekday", "cardinality", "weekdays"),
        Metric("value", "median_absolute_deviation", "spread"),
    ]
    return aggregate(df, ["event_type"], metrics).withColumn("spread", F.round("spread", 6))


@query(
    "agg_top_hits",
    f"""SELECT o_orderpriority, n, rank, _id, o_totalprice FROM (
          SELECT o_orderpriority, _id, o_totalprice, count(*) OVER (PARTITION BY o_orderpriority) AS n,
            row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, _id) AS rank
          FROM {ORDERS}) WHERE rank <= 5""",
)
def _(spark, sf_dir):
    hits = TopHits(["_id", "o_totalprice"], sort={"o_totalprice": "desc"}, n=5)
    found = aggregate(orders(spark, sf_dir), ["o_orderpriority"], [hits])
    listed = found.select("o_orderpriority", "n", F.posexplode("tophits").alias("rank", "hit"))
    return listed.select("o_orderpriority", "n", (F.col("rank") + 1).cast("bigint").alias("rank"), "hit.*")


@query(
    "agg_filtered",
    f"""SELECT source, count(*) AS n, max(n_chars) AS max_n_chars FROM {DOCUMENTS}
        WHERE lang IN ('en', 'de') AND n_chars > 300 AND (contains({N}, ' that ') OR contains({N}, ' und '))
        GROUP BY source""",
)
def _(spark, sf_dir):
    return aggregate(
        documents(spark, sf_dir),
        ["source"],
        [Metric("n_chars", "max")],
        queries=["that", "und"],
        filters={"lang": ["en", "de"], "n_chars": {"gt": 300}},
    )


@query(
    "agg_multi_project",
    f"""SELECT _query, count(*) AS n FROM (
          SELECT 'the' AS _query, {N} AS words FROM (
            SELECT text FROM {DOCUMENTS} UNION ALL SELECT text FROM {CONVERSATIONS} UNION ALL SELECT text FROM {BENCHMARK})
        ) WHERE contains(words, ' the ') GROUP BY _query""",
)
def _(spark, sf_dir):
    projects = [documents(spark, sf_dir), conversations(spark, sf_dir), benchmark(spark, sf_dir)]
    return aggregate(scan_multi(projects), ["_query"], queries={"the": "the"})


@query(
    "agg_page",
    f"""SELECT * FROM (
          SELECT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS o_orderdate_year, count(*) AS n
          FROM {ORDERS} GROUP BY ALL)
        WHERE o_custkey < 700 OR (o_custkey = 700 AND o_orderdate_year > DATE '1997-01-01')
        ORDER BY o_custkey DESC, o_orderdate_year LIMIT 1000""",
)
def _(spark, sf_dir):
    axes = ["o_custkey", Axis("o_orderdate", "year")]
    buckets = aggregate(orders(spark, sf_dir), axes)
    after = {"o_custkey": 700, "o_orderdate_year": F.lit("1997-01-01").cast("date")}
    return bucket_page(buckets, axes, after)


@query(
    "agg_order",
    f"""SELECT *, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderdate_year) AS place FROM (
          SELECT o_orderstatus, CAST(date_trunc('year', o_orderdate) AS DATE) AS o_orderdate_year, count(*) AS n
          FROM {ORDERS} GROUP BY ALL)""",
)
def _(spark, sf_dir):
    axes = ["o_orderstatus", Axis("o_orderdate", "year")]
    return numbered(ordered(aggregate(orders(spark, sf_dir), axes), axes), "place")


@query(
    "field_stats",
    f"""SELECT count(o_totalprice) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max,
          round(avg(o_totalprice), 4) AS avg, round(sum(o_totalprice), 2) AS sum FROM {ORDERS}""",
)
def _(spark, sf_dir):
    stats = field_stats(orders(spark, sf_dir), "o_totalprice")
    return stats.withColumns({"avg": F.round("avg", 4), "sum": F.round("sum", 2)})


@query(
    "field_stats_date",
    f"""SELECT count(ts) AS count, min(ts) AS min, max(ts) AS max, CAST(sum(epoch_us(ts) // 1000) AS DOUBLE) AS sum,
          CAST(sum(CAST(epoch_us(ts) AS HUGEINT)) // count(ts) // 1000000 AS BIGINT) AS avg FROM {EVENTS}""",
)
def _(spark, sf_dir):
    # The average is compared to the second.
    average = F.floor(F.unix_micros(F.col("avg").cast("timestamp")) / 1_000_000).cast("bigint")
    return field_stats(events(spark, sf_dir), "ts").withColumn("avg", average)


@query(
    "field_values",
    f"SELECT o_custkey AS value, count(*) AS n FROM {ORDERS} GROUP BY o_custkey",
)
def _(spark, sf_dir):
    return field_values(orders(spark, sf_dir), "o_custkey")
