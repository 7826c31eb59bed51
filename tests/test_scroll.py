"""Pages and batches from a snapshot, against the plain order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsieve.operators.scroll import open_snapshot, snapshot
from docsieve.operators.search import batches, next_batch, search, sort_documents
from docsieve.schema import declare


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Ranges of few rows stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def gaps(spark):
    """Sixty documents in many partitions, with ties and missing keys."""
    df = spark.range(60).select(
        F.col("id").cast("string").alias("_id"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id") % 4)).alias("t"),
    )
    return declare(df.repartition(7), {"k": "integer", "t": "keyword"})


SORTS = ["_id", "k", [{"k": "desc"}, "t"], [{"t": "desc"}, {"k": "desc"}], "?"]


@pytest.mark.parametrize("sort", SORTS, ids=str)
def test_places(gaps, sort):
    order = [tuple(r) for r in sort_documents(gaps, sort, seed=3).collect()]
    kept = snapshot(gaps, sort, seed=3)
    assert kept.total == 60 and len(kept.ranges) > 1
    for start, count in ((0, 60), (0, 1), (13, 20), (59, 5), (60, 5), (7, 0), (25, 1)):
        found = kept.rows(start, count)
        assert found.columns == gaps.columns
        assert [tuple(r) for r in found.collect()] == order[start : start + count]
    assert [tuple(r) for batch in kept.batches(17) for r in batch] == order


@pytest.mark.parametrize("sort", SORTS, ids=str)
def test_cursors(gaps, sort):
    """Behind each row come the rows that follow it, also where the cursor's row has gone."""
    order = [r.asDict() for r in sort_documents(gaps, sort, seed=3).collect()]
    kept = snapshot(gaps, sort, seed=3)
    less = snapshot(gaps.where("_id != '30'"), sort, seed=3)
    for place in (0, 11, 30, 58, 59):
        assert [r.asDict() for r in kept.after(order[place], 9).collect()] == order[place + 1 : place + 10]
    (gone,) = [i for i, r in enumerate(order) if r["_id"] == "30"]
    assert [r.asDict() for r in less.after(order[gone], 9).collect()] == order[gone + 1 : gone + 10]
    if sort != "?":
        assert [r.asDict() for r in next_batch(gaps, 9, order[20], sort).collect()] == order[21:30]


def test_opened_again(gaps, spark, tmp_path):
    kept = snapshot(gaps, {"k": "desc"}, path=f"{tmp_path}/kept")
    again = open_snapshot(spark, f"{tmp_path}/kept")
    assert again.keys == kept.keys and again.total == 60
    assert again.rows(20, 5).collect() == kept.rows(20, 5).collect()


def test_nothing(gaps, spark, tmp_path):
    kept = snapshot(gaps.where("k > 99"), "t", path=f"{tmp_path}/none")
    assert kept.total == 0 and kept.rows(0, 10).collect() == [] and list(kept.batches(5)) == []
    assert kept.after({"t": "t1", "_id": "3"}, 5).collect() == []
    assert kept.rows(0, 1).columns == gaps.columns


def test_one_sort_for_all_batches(gaps, spark, tmp_path):
    """The project is read for the snapshot only, and a page reads only the files of its ranges."""
    path = f"{tmp_path}/project"
    gaps.write.parquet(path)
    stored = declare(spark.read.parquet(path), {"k": "integer", "t": "keyword"})
    kept = snapshot(stored, "k")
    reading = kept.rows(kept.ranges[1].before, 1)
    assert all(path not in file for file in reading.inputFiles())
    plan = reading._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [len(b) for b in batches(stored, 25, "k")] == [25, 25, 10]


def test_page_far_down(spark):
    """Page 20,000 of ten rows: behind what one task would hold."""
    df = declare(spark.range(220_000).select(F.col("id").cast("string").alias("_id"), (-F.col("id")).alias("k")), {"k": "integer"})
    rows = search(df, fields=["k"], sort="k", page=20_000, per_page=10).collect()
    assert [r["k"] for r in rows] == list(range(-219_999 + 200_000, -219_999 + 200_010))
    plan = search(df, fields=["k"], sort="k", page=20_000, per_page=10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
