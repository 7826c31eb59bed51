"""Batches of several sources, sent again, applied and retired."""

from __future__ import annotations

import os

import pytest
from core_samples import values

from docsieve.schema import declare
from docsieve.streaming.ingest import Into, compact, fold, ingest, take, watch_documents


@pytest.fixture()
def stored(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "_id string, n bigint, t string")
    return declare(df, {"n": "integer", "t": "keyword"})


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "_id string, n bigint")


def table(stored, staging):
    return sorted(values(fold(stored, staging).table.select("_id", "n", "t")), key=str)


def test_a_batch_sent_again_changes_nothing(spark, stored, tmp_path):
    staging = str(tmp_path)
    assert table(stored, staging) == [("a", 1, "x"), ("b", 2, "x")]
    assert take(batch(spark, ("a", 10), ("c", 30)), staging, "one", 0)
    assert take(batch(spark, ("a", 11)), staging, "two", 0)
    wanted = [("a", 11, "x"), ("b", 2, "x"), ("c", 30, None)]
    assert table(stored, staging) == wanted
    # With other rows, so that it would be seen.
    assert not take(batch(spark, ("a", 99)), staging, "one", 0)
    assert table(stored, staging) == wanted
    assert compact(stored, staging) == 2
    assert not take(batch(spark, ("a", 99)), staging, "one", 0)
    assert table(stored, staging) == wanted
    assert take(batch(spark, ("a", 12)), staging, "one", 1)
    assert table(stored, staging) == [("a", 12, "x"), *wanted[1:]]


def test_a_batch_stored_in_part_is_stored_anew(spark, stored, tmp_path):
    staging = str(tmp_path)
    batch(spark, ("a", 99)).write.parquet(f"{staging}/batches/query=one/batch=0")
    os.remove(f"{staging}/batches/query=one/batch=0/_SUCCESS")
    # An entry of the log that was not finished does not count either.
    batch(spark, ("a", 99)).write.parquet(f"{staging}/log/version=1")
    os.remove(f"{staging}/log/version=1/_SUCCESS")
    assert table(stored, staging) == [("a", 1, "x"), ("b", 2, "x")]
    assert take(batch(spark, ("a", 10)), staging, "one", 0)
    assert table(stored, staging) == [("a", 10, "x"), ("b", 2, "x")]


def test_reading_does_not_grow_with_the_batches(spark, stored, tmp_path):
    staging = str(tmp_path)
    for number in range(6):
        take(batch(spark, ("a", 100 + number), (f"n{number}", number)), staging, "one", number)
        if number % 2:
            compact(stored, staging)
    folded = fold(stored, staging).table
    assert folded.count() == 8 and folded.where("_id = 'a'").first()["n"] == 105
    assert all("/base/" in file for file in folded.inputFiles())
    # What the last base replaced is kept once, for readers; what was before it is gone.
    assert sorted(os.listdir(f"{staging}/base")) == ["version=4", "version=6"]
    assert sorted(d for d in os.listdir(f"{staging}/batches/query=one") if "=" in d) == ["batch=4", "batch=5"]
    assert compact(stored, staging) == 6


def test_a_stream_applies_what_it_takes(spark, stored, tmp_path):
    sent, staging = f"{tmp_path}/sent", f"{tmp_path}/staging"
    into = Into(stored, waiting=2)
    for number in range(3):
        batch(spark, ("a", 50 + number), (f"s{number}", number)).write.mode("append").parquet(sent)
        stream = watch_documents(spark, sent, batch(spark, ("a", 1)).schema)
        ingest(stream, staging, f"{tmp_path}/progress", into=into).awaitTermination()
    assert sorted(os.listdir(f"{staging}/base")) == ["version=2"]
    assert table(stored, staging) == [("a", 52, "x"), ("b", 2, "x"), ("s0", 0, None), ("s1", 1, None), ("s2", 2, None)]


def test_later_batches_may_bring_other_columns(spark, stored, tmp_path):
    staging = str(tmp_path)
    take(batch(spark, ("a", 10)), staging, "one", 0)
    take(spark.createDataFrame([("a", "y")], "_id string, t string"), staging, "one", 1)
    assert table(stored, staging) == [("a", 10, "y"), ("b", 2, "x")]
