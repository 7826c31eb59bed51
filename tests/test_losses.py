"""No document is lost on the way: missing sort keys, stored words, several sources, partial listings, missing ids."""

from __future__ import annotations

import datetime as dt

import pytest
from core_samples import ids
from pyspark.sql import functions as F

from docsieve.functions.dates import number_bucket
from docsieve.functions.text import store_words
from docsieve.operators.aggregate import Axis, aggregate, field_values
from docsieve.operators.objects import reconcile_objects
from docsieve.operators.search import batches, search
from docsieve.operators.shape import drill_down, pivot_wide
from docsieve.operators.write import copy_where, update_where, write
from docsieve.schema import declare
from docsieve.sources.files import source_csv
from docsieve.sources.projects import read_project
from docsieve.streaming.ingest import fold, ingest, watch_documents


def texts(spark, rows):
    return declare(spark.createDataFrame(rows, "_id string, text string"), {"text": "text"})


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("size", [1, 2, 3, 10])
def test_batches_read_rows_without_a_sort_key(spark, order, size):
    rows = [("a", 2), ("b", None), ("c", 1), ("d", None), ("e", 2), ("f", None)]
    df = declare(spark.createDataFrame(rows, "_id string, q bigint"), {"q": "integer"})
    found = [r["_id"] for part in batches(df, size, {"q": order}) for r in part]
    assert found == [r["_id"] for r in search(df, sort={"q": order}).collect()]
    assert sorted(found) == list("abcdef")


@pytest.mark.parametrize("operation", ["index", "create", "update", "upsert"])
def test_stored_words_follow_every_write(spark, operation):
    plain = texts(spark, [("1", "an apple"), ("2", "a pear")])
    batch = spark.createDataFrame([("2", "apple pie", 1), ("3", "more apple", 1)], "_id string, text string, at int")
    stored = store_words(plain, "text")
    with_words = write(operation, stored, batch, position="at").table
    without = write(operation, plain, batch, position="at").table
    for word in ("apple", "pear", "pie"):
        assert ids(search(with_words, f"text:{word}")) == ids(search(without, f"text:{word}"))


def test_stored_words_follow_edits_and_copies(spark):
    stored = store_words(texts(spark, [("1", "an apple"), ("2", "a pear")]), "text")
    changed = update_where(stored, "text", "a plum", ids=["2"]).table
    assert ids(search(changed, "plum")) == ["2"] and ids(search(changed, "pear")) == []
    copied = copy_where(texts(spark, [("3", "apple")]), stored)
    assert ids(search(copied, "apple")) == ["1", "3"]


def test_missing_ids_are_failures(spark):
    stored = texts(spark, [("1", "x")])
    batch = spark.createDataFrame([(None, "y", 1), ("2", "z", 2)], "_id string, text string, at int")
    for operation in ("index", "create", "upsert"):
        written = write(operation, stored, batch, position="at")
        assert ids(written.table) == ["1", "2"]
        assert [r["_id"] for r in written.failures.collect()] == [None]


def test_repeated_ids_need_a_position(spark):
    stored = texts(spark, [("1", "x")])
    batch = spark.createDataFrame([("2", f"v{i}", i) for i in range(6)], "_id string, text string, at int")
    with pytest.raises(ValueError, match="position"):
        write("index", stored, batch.drop("at"))
    table = write("index", stored, batch, position="at").table
    assert {r["_id"]: r["text"] for r in table.collect()}["2"] == "v5"


def test_two_sources_share_a_staging_folder(spark, tmp_path):
    stored = texts(spark, [("1", "x")])
    for name in ("a", "b"):
        texts(spark, [(name, name), ("1", f"from {name}")]).write.parquet(f"{tmp_path}/{name}")
        stream = watch_documents(spark, f"{tmp_path}/{name}", stored.schema)
        ingest(stream, f"{tmp_path}/staging", f"{tmp_path}/progress-{name}").awaitTermination()
    table = fold(stored, f"{tmp_path}/staging").table
    assert {r["_id"]: r["text"] for r in table.collect()} == {"1": "from b", "a": "a", "b": "b"}


def test_a_listing_of_one_project_leaves_the_others(spark):
    register = spark.createDataFrame(
        [("p1", "f", "x", "", 1, "t", dt.datetime(2020, 1, 1), None), ("p2", "f", "y", "", 1, "t", dt.datetime(2020, 1, 1), None)],
        "index string, field string, filepath string, path string, size bigint, content_type string, "
        "registered timestamp_ntz, last_synced timestamp_ntz",
    )
    listing = spark.createDataFrame([("p1", "f", "z", 5)], "index string, field string, filepath string, size bigint")
    now = dt.datetime(2024, 1, 1)
    found = reconcile_objects(register, listing, now, index="p1").collect()
    assert sorted((r["index"], r["filepath"]) for r in found) == [("p1", "z"), ("p2", "y")]
    found = reconcile_objects(register, listing, now, index="p1", field="g").collect()
    assert sorted((r["index"], r["filepath"]) for r in found) == [("p1", "x"), ("p2", "y")]
    assert [r["filepath"] for r in reconcile_objects(register, listing, now).collect()] == ["z"]


def test_files_with_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "2.csv").write_text("y,x\n10,20\n")
    with pytest.raises(Exception, match="(?i)header"):
        source_csv(spark, str(tmp_path)).collect()
    (tmp_path / "names").mkdir()
    (tmp_path / "names" / "1.csv").write_text("A b,a_b,c\n1,2,3\n")
    assert source_csv(spark, str(tmp_path / "names")).columns == ["a_b", "a_b_2", "c"]


def test_nothing_is_cut(spark):
    df = spark.range(2500).selectExpr("string(id) AS _id", "string(id) AS k", "string(id % 15) AS c", "id AS n")
    df = declare(df, {"k": "keyword", "c": "keyword", "n": "integer"})
    assert field_values(df, "k").count() == 2500
    assert len(pivot_wide(df.where("n < 30"), "k", "c").columns) == 16


def test_number_buckets(spark):
    df = spark.createDataFrame([(float("nan"),), (1e300,), (-1e300,), (-0.5,), (None,)], "v double")
    found = [r[0] for r in df.select(number_bucket(F.col("v"), df.schema["v"].dataType, 10)).collect()]
    assert found == [None, 1e300, -1e300, -10.0, None]


def test_a_thousand_labels(spark, docs):
    assert ids(search(docs, [f"w{i}" for i in range(1000)] + ["toto"])) == ["2", "3"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_buckets_of_zoned_dates_hold_their_documents(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    moments = ["2024-03-31T23:30:00Z", "2024-04-01T00:30:00Z", "1969-12-31T23:59:59.5Z"]
    df = spark.createDataFrame([(str(i), m) for i, m in enumerate(moments)], "_id string, at string")
    df.select("_id", F.col("at").cast("timestamp").alias("at")).write.parquet(f"{tmp_path}/zoned")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        project = read_project(spark, f"{tmp_path}/zoned", fields={"at": "date"})
        axis = Axis("at", "month")
        found = {r["at_month"]: r["n"] for r in aggregate(project, [axis]).collect()}
        assert found == {dt.date(2024, 3, 1): 1, dt.date(2024, 4, 1): 1, dt.date(1969, 12, 1): 1}
        for month, n in found.items():
            assert drill_down(project, [axis], {"at_month": month}).count() == n
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
