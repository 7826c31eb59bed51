from __future__ import annotations

import datetime as dt

import pytest
from core_samples import as_dict, ids, values

from docsieve.operators.aggregate import Axis, aggregate
from docsieve.operators.filters import select
from docsieve.operators.shape import (
    auto_interval,
    column_stats,
    drill_down,
    in_part_order,
    keep_top_columns,
    pivot_wide,
    sort_by_total,
    top_columns,
    zero_fill_dates,
    zero_fill_parts,
    zoom_filter,
)
from docsieve.plans.corpora import documents, events

SF = "/root/testdata/sf0.001"


def test_pivot_and_totals(docs):
    buckets = aggregate(docs, ["cat", "subcat"])
    wide = pivot_wide(buckets, "cat", "subcat", ["x", "y"])
    assert sorted(values(wide)) == [("a", 2, 1), ("b", 0, 1)]
    assert values(sort_by_total(wide, ["y", "x"])) == [("a", 2, 1), ("b", 0, 1)]
    assert values(column_stats(wide, ["x", "y"])) == [("x", 2, 0, 2), ("y", 2, 0, 2)]
    assert values(top_columns(buckets, "subcat", k=1)) == [("x", 2)]
    assert values(keep_top_columns(buckets, "subcat", k=1)) == [("x", "a", 2)]
    assert pivot_wide(buckets, "cat", "subcat").columns == ["cat", "x", "y"]


def test_pivot_keeps_totals(spark):
    buckets = aggregate(documents(spark, SF), ["source", "lang"])
    wide = pivot_wide(buckets, "source", "lang")
    totals = {row["source"]: sum(row[c] for c in wide.columns[1:]) for row in wide.collect()}
    assert totals == as_dict(aggregate(documents(spark, SF), ["source"]))


@pytest.mark.parametrize("interval,count", [("day", 731), ("week", 105), ("month", 25), ("quarter", 9), ("year", 3)])
def test_empty_dates(docs, interval, count):
    filled = as_dict(zero_fill_dates(aggregate(docs, [Axis("date", interval)]), f"date_{interval}", interval))
    assert len(filled) == count and sum(filled.values()) == 4
    assert {k: n for k, n in filled.items() if n} == as_dict(aggregate(docs, [Axis("date", interval)]))


def test_empty_parts(docs):
    def fill(part):
        return as_dict(zero_fill_parts(aggregate(docs, [Axis("date", part)]), f"date_{part}", part))

    assert fill("monthnr") == {m: {1: 3, 2: 1}.get(m, 0) for m in range(1, 13)}
    assert fill("yearnr") == {2018: 3, 2019: 0, 2020: 1}
    assert fill("decade") == {2010: 3, 2020: 1}
    assert sum(fill("dayofweek").values()) == 4 and len(fill("dayofweek")) == 7
    assert fill("daypart") == {"Night": 4, "Morning": 0, "Afternoon": 0, "Evening": 0}
    assert fill("dayofmonth") == {1: 4}
    nothing = aggregate(docs, [Axis("date", "month")], filters={"cat": "z"})
    assert zero_fill_dates(nothing, "date_month", "month").count() == 0


def test_part_order(docs):
    months = zero_fill_parts(aggregate(docs, [Axis("date", "monthnr")]), "date_monthnr", "monthnr")
    assert [r[0] for r in in_part_order(months, "date_monthnr", "monthnr").collect()][:3] == ["January", "February", "March"]
    parts = zero_fill_parts(aggregate(docs, [Axis("date", "daypart")]), "date_daypart", "daypart")
    assert [r[0] for r in in_part_order(parts, "date_daypart", "daypart").collect()] == ["Morning", "Afternoon", "Evening", "Night"]


AXES = [
    ["event_type"],
    [Axis("ts", "day")],
    [Axis("ts", "week"), "event_type"],
    [Axis("ts", "month")],
    [Axis("ts", "quarter")],
    [Axis("ts", "year")],
    [Axis("ts", "decade")],
    [Axis("user_id", 3)],
    [Axis("value", 12.5), "event_type"],
]


@pytest.mark.parametrize("axes", AXES, ids=str)
def test_drill_down_gives_the_documents_of_each_bucket(spark, axes):
    df, filters = events(spark, SF), {"ts": {"gt": "2024-01-05", "lte": "2024-01-20"}, "value": {"gte": 5}}
    buckets = aggregate(df, axes, filters=filters).collect()
    assert buckets
    for bucket in buckets[:4]:
        assert drill_down(df, axes, bucket.asDict(), filters=filters).count() == bucket["n"]


def test_drill_down_into_a_query(docs):
    queries = {"t": "text", "s": "test*"}
    for row in aggregate(docs, ["_query", Axis("date", "year")], queries=queries).collect():
        found = drill_down(docs, ["_query", Axis("date", "year")], row.asDict(), queries)
        assert found.count() == row["n"]


def test_zoom_filters(docs):
    narrowed = zoom_filter("2018-01-01", "year", {"gte": "2018-02-01", "lt": "2019-06-01"})
    assert (narrowed.gte, narrowed.lt) == (dt.datetime(2018, 2, 1), dt.datetime(2019, 1, 1))
    assert ids(select(docs, filters={"date": narrowed})) == ["1"]
    assert ids(select(docs, filters={"date": zoom_filter(2010, "decade")})) == ["0", "1", "3"]
    for part in ("dayofweek", "monthnr", "daypart"):
        with pytest.raises(ValueError):
            zoom_filter("Monday", part)


def test_auto_interval():
    start = dt.datetime(2000, 1, 1)

    def chosen(days, **options):
        return auto_interval(start, start + dt.timedelta(days=days), **options)

    assert [chosen(d) for d in (10, 600, 601, 1801, 7301, 73001)] == ["day", "day", "month", "quarter", "year", "decade"]
    assert chosen(73001, existing={"lt": "2000-03-01"}) == "day"
