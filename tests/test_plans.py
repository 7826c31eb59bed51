"""What the physical plans must look like for large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsieve.functions.coerce import ISO_DATE, NUMBER, URL
from docsieve.functions.text import AnyOf, Word
from docsieve.operators.aggregate import aggregate
from docsieve.operators.filters import select
from docsieve.operators.validate import _classes
from docsieve.operators.write import _last
from docsieve.plans import all_queries
from docsieve.plans.corpora import documents, events

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["filter_range", "filter_values_date", "filter_values", "drill_down", "filter_combine"])
def test_field_filters_reach_the_scan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert any(bound in text for bound in ("GreaterThanOrEqual(", "In(", "Or("))
    assert "Exchange" not in text or "join" in text.lower()


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["agg_terms"](spark, SF))
    assert "ReadSchema: struct<source:string>" in text


def test_counting_by_query_scans_once_and_shuffles_once(spark):
    text = plan(QUERIES["agg_by_query_axis"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and text.count("lower(") == 1
    assert "partial_count" in text


def test_many_labels_split_each_text_once(spark):
    assert plan(QUERIES["agg_by_query_many"](spark, SF)).count("regexp_extract_all") == 1


def test_many_words_lower_each_text_once_in_generated_code(spark):
    tree = AnyOf(tuple(Word(w) for w in "a b c d e f".split()))
    found = select(documents(spark, SF), tree, {"lang": "en"})
    assert plan(found).count("lower(") == 1
    assert "EqualTo(lang,en)" in plan(found)
    assert "*(1) Filter" in plan(found) and "*(1) Generate" in plan(found)


def test_pages_are_a_top_k(spark):
    text = plan(QUERIES["page"](spark, SF))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_hits_are_ranked_before_the_shuffle(spark):
    text = plan(QUERIES["agg_top_hits"](spark, SF))
    assert "row_number(), 5, Partial" in text


def test_no_query_uses_python_workers_or_cross_joins(spark):
    for name, build in QUERIES.items():
        text = plan(build(spark, SF))
        for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in text, (name, node)


@pytest.mark.parametrize(
    "name,source",
    [("copy_where", "documents"), ("zero_fill_dates", "orders"), ("zero_fill_decades", "orders"), ("top_columns", "documents")],
)
def test_results_needed_twice_are_made_once(spark, name, source):
    text = plan(QUERIES[name](spark, SF))
    assert f"{source}.parquet" not in text and text.count("/docsieve/") == 2


def test_a_hot_bucket_is_combined_before_the_shuffle(spark):
    df = events(spark, SF).withColumn("event_type", F.lit("click"))
    text = plan(aggregate(df, ["event_type"]))
    assert "partial_count(1)" in text


def test_a_repeated_id_is_folded_before_the_shuffle(spark):
    batch = spark.range(10).select((F.col("id") % 3).cast("string").alias("_id"), F.col("id").alias("__position"))
    assert "row_number(), 1, Partial" in plan(_last(batch))


def test_types_try_each_pattern_once_per_cell(spark):
    cells = spark.createDataFrame([(0, "1.5"), (0, "-2"), (0, "2020-01-01"), (0, None), (0, "")], "column int, value string")
    text = plan(_classes(cells))
    assert text.count(NUMBER) == text.count(ISO_DATE) == text.count(URL) == 1
    found = [tuple(r) for r in _classes(cells).select("number", "date", "integer").collect()]
    assert found == [(1.5, None, False), (-2.0, None, True), (None, True, None), (None, None, None), (None, None, None)]
