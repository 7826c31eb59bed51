from __future__ import annotations

import datetime as dt
import statistics

import pytest
from core_samples import as_dict, values
from pyspark.sql import functions as F

from docsieve.functions import dates
from docsieve.operators.aggregate import (
    Axis,
    Metric,
    TopHits,
    aggregate,
    bucket_page,
    field_stats,
    field_values,
    list_field_values,
    ordered,
)
from docsieve.schema import declare
from docsieve.sources.projects import scan_multi

JAN, FEB, YEAR20 = dt.datetime(2018, 1, 1), dt.datetime(2018, 2, 1), dt.datetime(2020, 1, 1)


def test_axes(docs):
    assert as_dict(aggregate(docs, ["cat"])) == {"a": 3, "b": 1}
    assert as_dict(aggregate(docs, ["date"])) == {JAN: 2, FEB: 1, YEAR20: 1}
    assert as_dict(aggregate(docs, [Axis("date", "year")])) == {dt.date(2018, 1, 1): 3, dt.date(2020, 1, 1): 1}
    assert as_dict(aggregate(docs, [Axis("date", "quarter")])) == {JAN: 3, YEAR20: 1}
    assert as_dict(aggregate(docs, [Axis("i", "10")])) == {0: 2, 10: 1, 30: 1}
    assert as_dict(aggregate(docs, ["cat", "subcat"])) == {("a", "x"): 2, ("a", "y"): 1, ("b", "y"): 1}
    assert as_dict(aggregate(docs, ["subcat", "cat"])) == {("x", "a"): 2, ("y", "a"): 1, ("y", "b"): 1}
    assert aggregate(docs, [Axis("date", "month", "m"), Axis("i", 10)]).columns == ["m", "i_10", "n"]


def test_counts_and_selection(docs):
    assert values(aggregate(docs)) == [(4,)]
    assert values(aggregate(docs, queries="test*")) == [(3,)]
    assert as_dict(aggregate(docs, ["cat"], queries="test*")) == {"a": 2, "b": 1}
    assert as_dict(aggregate(docs, ["cat"], queries='"a text"')) == {"a": 1}
    assert as_dict(aggregate(docs, ["cat"], filters={"i": {"gt": 2}})) == {"a": 1, "b": 1}
    assert as_dict(aggregate(docs, ["cat"], ids=["0", "3"])) == {"a": 1, "b": 1}


def test_by_query(docs):
    queries = {"text": "text", "test*": "test*"}
    assert as_dict(aggregate(docs, ["_query"], queries=queries)) == {"text": 2, "test*": 3}
    first = as_dict(aggregate(docs, ["_query", "subcat"], queries=queries))
    assert first == {("text", "x"): 2, ("test*", "x"): 1, ("test*", "y"): 2}
    last = aggregate(docs, ["subcat", "_query"], queries=queries)
    assert last.columns == ["subcat", "_query", "n"]
    assert as_dict(last) == {(b, a): n for (a, b), n in first.items()}
    assert as_dict(aggregate(docs, ["_query"], queries=queries, filters={"cat": "b"})) == {"test*": 1}
    with pytest.raises(ValueError):
        aggregate(docs, ["_query", "_query"], queries=queries)
    with pytest.raises(ValueError):
        aggregate(docs, ["_query"])


def test_metrics(docs):
    by = aggregate(docs, ["subcat"], [Metric("i", "avg")])
    assert by.columns == ["subcat", "n", "avg_i"] and as_dict(by.drop("n")) == {"x": 1.5, "y": 21.0}
    assert values(aggregate(docs, [], [Metric("i", "avg"), Metric("i", "max", "top")])) == [(4, 11.25, 31)]
    assert values(aggregate(docs, [], [Metric("date", "max"), Metric("date", "min")])) == [(4, YEAR20, JAN)]
    averages = as_dict(aggregate(docs, ["subcat"], [Metric("date", "avg")]).drop("n"))
    assert averages == {"x": dt.datetime(2018, 1, 16, 12), "y": dt.datetime(2019, 1, 1)}
    # A field may be axis and metric at once.
    assert values(aggregate(docs, ["i"], [Metric("i", "sum")], filters={"i": [31]})) == [(31, 1, 31)]
    with pytest.raises(ValueError):
        aggregate(docs, [], [Metric("i", "mode")])
    with pytest.raises(ValueError):
        aggregate(docs, ["nope"])


def test_more_metrics(docs):
    wanted = [Metric("i", "value_count", "c"), Metric("cat", "cardinality", "d"), Metric("i", "median_absolute_deviation", "m")]
    assert values(aggregate(docs, [], wanted)) == [(4, 4, 2, 5.0)]
    assert as_dict(aggregate(docs, ["subcat"], wanted[2:]).drop("n")) == {"x": 0.5, "y": 10.0}
    by_date = [Metric("date", "cardinality", "dates")]
    assert values(aggregate(docs, [], by_date)) == [(4, 3)]


def test_large_groups_have_exact_medians_and_distinct_counts(spark):
    """Over 50,000 rows and distinct values in a group, nearly all in one; a small group, ties, missing values."""
    rows = [(i * 2_654_435_761 % 1_000_003) ** 2 / 1e6 for i in range(150_000)]
    small = [3.0, 3.0, 3.0, 8.0, 9.0, 100.0]
    expected = {}
    for name, found in {"big": rows, "small": small, "all": rows + small}.items():
        centre = statistics.median(found)
        expected[name] = (len(set(found)), statistics.median(abs(v - centre) for v in found))
    df = spark.createDataFrame([("big", v) for v in rows] + [("small", v) for v in small] + [("none", None)] * 2, "c string, v double")
    df = declare(df.withColumn("_id", F.monotonically_increasing_id().cast("string")), {"c": "keyword", "v": "number"})
    wanted = [Metric("v", "cardinality", "d"), Metric("v", "median_absolute_deviation", "m")]
    by = {r["c"]: (r["d"], r["m"]) for r in aggregate(df, ["c"], wanted).collect()}
    assert by == {"big": expected["big"], "small": expected["small"], "none": (0, None)}
    assert values(aggregate(df, [], wanted)) == [(150_008, *expected["all"])]
    estimates = [Metric("v", "cardinality_estimate", "d"), Metric("v", "median_absolute_deviation_estimate", "m")]
    (n, d, m), = values(aggregate(df, [], estimates))
    assert n == 150_008 and [d, m] == pytest.approx(expected["all"], rel=0.05)
    assert values(aggregate(df.limit(0), [], wanted)) == [(0, 0, None)]


def test_documents_without_a_value_are_left_out(spark):
    df = spark.createDataFrame([("0", None, 1), ("1", "a", None), ("2", "a", 3)], "_id string, c string, v bigint")
    assert values(aggregate(df, ["c"], [Metric("v", "avg"), Metric("v", "value_count", "c_v")])) == [("a", 2, 3.0, 1)]


def test_tags_count_once_per_document(spark):
    df = spark.createDataFrame(
        [("0", ["x", "y", "x"], ["p"]), ("1", ["x"], ["p", "q"]), ("2", None, ["p"]), ("3", [], None)],
        "_id string, tags array<string>, more array<string>",
    )
    assert as_dict(aggregate(df, ["tags"])) == {"x": 2, "y": 1}
    assert as_dict(aggregate(df, ["tags", "more"])) == {("x", "p"): 2, ("y", "p"): 1, ("x", "q"): 1}


def test_top_hits(docs):
    hits = TopHits(["i", "title"], sort={"i": "desc"}, n=2)
    found = as_dict(aggregate(docs, ["cat"], [Metric("i", "min"), hits]).drop("n", "min_i"))
    assert [tuple(h) for h in found["a"]] == [(11, "bla"), (2, "title")]
    assert [tuple(h) for h in found["b"]] == [(31, "more bla")]
    overall = aggregate(docs, [], [TopHits(["_id"], sort="i", name="first")]).first()
    assert [h["_id"] for h in overall["first"]] == ["0"]
    with pytest.raises(ValueError):
        TopHits(["i"], n=0)


@pytest.fixture(scope="module")
def dates6(spark):
    # Ends and beginnings of years, weeks that belong to the next year, and the borders of the parts of a day.
    stamps = ["2021-12-31T23:10", "2022-01-03T05:30", "2022-01-03T13:00", "2022-02-28T06:00", "2022-05-14T17:59", "2019-12-30T00:00"]
    rows = [(str(i), s) for i, s in enumerate(stamps)]
    return spark.createDataFrame(rows, "_id string, date string").withColumn("date", F.col("date").cast("timestamp_ntz"))


@pytest.mark.parametrize(
    "part,expected",
    [
        ("dayofweek", {"Friday": 1, "Monday": 4, "Saturday": 1}),
        ("daypart", {"Night": 2, "Morning": 1, "Afternoon": 2, "Evening": 1}),
        ("monthnr", {12: 2, 1: 2, 2: 1, 5: 1}),
        ("yearnr", {2019: 1, 2021: 1, 2022: 4}),
        ("decade", {2010: 1, 2020: 5}),
        ("dayofmonth", {31: 1, 3: 2, 28: 1, 14: 1, 30: 1}),
        ("weeknr", {52: 1, 1: 3, 9: 1, 19: 1}),
        ("hour", {dt.datetime(2021, 12, 31, 23): 1, dt.datetime(2022, 1, 3, 5): 1, dt.datetime(2022, 1, 3, 13): 1,
                  dt.datetime(2022, 2, 28, 6): 1, dt.datetime(2022, 5, 14, 17): 1, dt.datetime(2019, 12, 30, 0): 1}),
        ("week", {dt.date(2021, 12, 27): 1, dt.date(2022, 1, 3): 2, dt.date(2022, 2, 28): 1, dt.date(2022, 5, 9): 1,
                  dt.date(2019, 12, 30): 1}),
    ],
)
def test_date_parts(dates6, part, expected):
    assert as_dict(aggregate(dates6, [Axis("date", part)])) == expected


def test_two_parts(dates6):
    found = as_dict(aggregate(dates6, [Axis("date", "monthnr"), Axis("date", "dayofmonth")]))
    assert found == {(12, 31): 1, (1, 3): 2, (2, 28): 1, (5, 14): 1, (12, 30): 1}


def test_dates_do_not_depend_on_the_session_zone(dates6, spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    axes = [Axis("date", "hour"), Axis("date", "daypart"), Axis("date", "quarter")]
    expected = sorted(values(aggregate(dates6, axes, [Metric("date", "avg")])))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(values(aggregate(dates6, axes, [Metric("date", "avg")]))) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_negative_numbers_fall_into_the_lower_bucket(spark):
    df = spark.createDataFrame([("0", -1, -0.5), ("1", 0, 0.0), ("2", 9, 2.4)], "_id string, i bigint, x double")
    assert as_dict(aggregate(df, [Axis("i", 10)])) == {-10: 1, 0: 2}
    assert as_dict(aggregate(df, [Axis("x", 1.2)])) == {-1.2: 1, 0.0: 1, 2.4: 1}


def test_bucket_order_and_pages(docs):
    axes = ["cat", Axis("date", "year")]
    buckets = aggregate(docs, axes)
    rows = values(ordered(buckets, axes))
    assert [r[:2] for r in rows] == [("b", dt.date(2018, 1, 1)), ("a", dt.date(2018, 1, 1)), ("a", dt.date(2020, 1, 1))]
    pages, after = [], None
    while page := bucket_page(buckets, axes, after, 2).collect():
        pages.append([tuple(r) for r in page])
        after = page[-1].asDict()
    assert [len(p) for p in pages] == [2, 1] and [r for p in pages for r in p] == rows


def test_stats(docs):
    assert field_stats(docs, "i").first().asDict() == {"count": 4, "min": 1, "max": 31, "avg": 11.25, "sum": 45}
    stats = field_stats(docs, "date").first()
    assert (stats["min"], stats["max"], stats["avg"]) == (JAN, YEAR20, dt.datetime(2018, 7, 10, 6))
    with pytest.raises(ValueError):
        field_stats(docs, "cat")


def test_values(spark):
    df = spark.createDataFrame([(str(i), "odd" if i % 3 == 0 else "even") for i in range(30)], "_id string, bla string")
    assert list_field_values(df, "bla") == ["even", "odd"]
    assert values(field_values(df, "bla", 1)) == [("even", 20)]
    unique = spark.range(2001).select(F.col("id").cast("string").alias("_id"), F.col("id").alias("v"))
    with pytest.raises(ValueError):
        list_field_values(unique, "v")


def test_several_projects(docs, spark):
    other = declare(
        spark.createDataFrame([("10", "also a text", -1, "c")], "_id string, text string, i bigint, cat string"),
        {"text": "text"},
    )
    both = scan_multi([docs, other])
    assert as_dict(aggregate(both, ["cat"])) == {"a": 3, "b": 1, "c": 1}
    assert as_dict(aggregate(both, ["_query"], queries={"t": "text"})) == {"t": 3}


def test_average_of_many_dates_is_exact(spark):
    stamps = spark.range(100_000).select(
        F.col("id").cast("string").alias("_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("ts"),
    )
    assert stamps.agg(dates.average(F.col("ts"))).first()[0] == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=49999.5)
