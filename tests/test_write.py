from __future__ import annotations

import datetime as dt

import pytest
from core_samples import ids, values
from pyspark.sql import functions as F

from docsieve.functions.ids import doc_hash
from docsieve.operators import write as write_module
from docsieve.operators.write import copy_where, delete_where, tag_where, update_where, write
from docsieve.schema import Field, change_type, declare, extend_fields, fields_of


def column(df, name):
    return {row["_id"]: row[name] for row in df.select("_id", name).collect()}


@pytest.fixture(scope="module")
def batch(spark):
    rows = [("0", "zz", None, 0), ("9", "new", 5, 1), ("9", None, 6, 2), ("0", None, 7, 3)]
    return spark.createDataFrame(rows, "_id string, cat string, i int, at int")


@pytest.fixture(params=["rows sent", "ids sent", "shuffled"], autouse=True, scope="module")
def sizes(request):
    """All tests run with small, larger and very large batches, as the limits have it."""
    rows, ids_ = {"rows sent": (32 << 20, 128 << 20), "ids sent": (-1, 128 << 20), "shuffled": (-1, -1)}[request.param]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(write_module, "MAX_SENT_ROWS", rows)
        patch.setattr(write_module, "MAX_SENT_IDS", ids_)
        yield


def run(operation, docs, batch):
    written = write(operation, docs, batch, position="at")
    shown = {r["_id"]: (r["cat"], r["i"], r["title"]) for r in written.table.collect()}
    assert written.table.count() == len(shown)
    return shown, ids(written.failures)


UNTOUCHED = {"1": ("a", 2, "title"), "2": ("a", 11, "bla"), "3": ("b", 31, "more bla")}


def test_index_replaces(docs, batch):
    assert run("index", docs, batch) == ({"0": (None, 7, None), "9": (None, 6, None), **UNTOUCHED}, [])


def test_create_keeps_what_is_there(docs, batch):
    assert run("create", docs, batch) == ({"0": ("a", 1, "title"), "9": ("new", 5, None), **UNTOUCHED}, ["0", "9"])


def test_update_changes_only_what_is_there(docs, batch):
    assert run("update", docs, batch) == ({"0": ("zz", 7, "title"), **UNTOUCHED}, ["9"])


def test_upsert_never_erases(docs, batch):
    assert run("upsert", docs, batch) == ({"0": ("zz", 7, "title"), "9": ("new", 6, None), **UNTOUCHED}, [])


def test_upsert_twice_is_once(docs, batch):
    once = write("upsert", docs, batch, position="at").table
    twice = write("upsert", once, batch, position="at").table
    assert sorted(map(str, values(once))) == sorted(map(str, values(twice)))
    assert fields_of(twice) == fields_of(docs)


def test_a_much_repeated_id_is_folded(spark, docs):
    rows = spark.range(20_000).select(F.lit("0").alias("_id"), F.col("id").alias("i"), F.col("id").alias("at"))
    assert column(write("index", docs, rows, position="at").table, "i")["0"] == 19_999
    assert column(write("upsert", docs, rows, position="at").table, "i")["0"] == 19_999


def test_fields_must_be_declared(docs, spark):
    new = spark.createDataFrame([("5", "v")], "_id string, extra string")
    with pytest.raises(ValueError):
        write("index", docs, new)
    table = write("index", docs, new, {"extra": "keyword"}).table
    assert column(table, "extra")["5"] == "v" and fields_of(table)["extra"].type == "keyword"
    with pytest.raises(ValueError):
        write("merge", docs, new)


def test_values_are_coerced(docs, spark):
    new = spark.createDataFrame([("5", "1", "1.1", 1, "2020-02-03T04:05:06+01:00", "t", "yes")],
                                "_id string, i string, x string, title int, date string, tags string, b string")
    table = write("index", docs, new, {"x": "number", "tags": "tag", "b": "boolean"}).table
    row = table.where("_id = '5'").first()
    assert (row["i"], row["x"], row["title"], row["tags"], row["b"]) == (1, 1.1, "1", ["t"], True)
    assert row["date"] == dt.datetime(2020, 2, 3, 3, 5, 6)


@pytest.mark.parametrize("date,good", [("0001-01-01", True), ("-0001-11-30T00:00:00", False), ("2018-02", False)])
def test_dates_must_be_iso(docs, spark, date, good):
    new = spark.createDataFrame([("5", date)], "_id string, date string")
    if good:
        assert column(write("index", docs, new).table, "date")["5"] == dt.datetime(1, 1, 1)
    else:
        with pytest.raises(Exception, match="invalid date"):
            write("index", docs, new).table.collect()


def test_objects_come_back_as_they_were(docs, spark):
    new = spark.createDataFrame([("5", [("a", 1.5), ("b", 2.0)])], "_id string, term array<struct<term:string,value:double>>")
    table = write("index", docs, new, {"term": "object"}).table
    assert column(table, "term")["5"] == '[{"term":"a","value":1.5},{"term":"b","value":2.0}]'


def test_ids_from_identifiers(spark):
    empty = declare(spark.createDataFrame([], "_id string, url string, text string"),
                    {"url": Field("keyword", identifier=True), "text": "text"})

    def load(stored, *rows):
        return write("index", stored, spark.createDataFrame(rows, "url string, text string")).table

    one = load(empty, ("u1", "first"))
    two = load(one, ("u1", "second"), ("u2", "other"))
    assert sorted((r["url"], r["text"]) for r in two.collect()) == [("u1", "second"), ("u2", "other")]
    given = spark.createDataFrame([("x", "u3", "t")], "_id string, url string, text string")
    with pytest.raises(ValueError):
        write("index", two, given)
    updated = write("update", two, spark.createDataFrame([("x", "u2", "new")], "_id string, url string, text string"))
    assert sorted(r["text"] for r in updated.table.collect()) == ["new", "second"]


def test_hash_uses_the_values_that_are_present(spark):
    df = spark.createDataFrame([("a", None), ("a", "b"), (None, "a")], "x string, y string")
    made = [r[0] for r in df.select(doc_hash(["y", "x"])).collect()]
    assert len(set(made)) == 3 and all(len(m) == 56 for m in made)
    assert made[0] == df.select(doc_hash(["x"])).first()[0]


def test_documents_without_ids_stay_apart(docs, spark):
    same = spark.createDataFrame([("x",), ("x",)], "cat string")
    assert write("index", docs, same).table.count() == 6
    with pytest.raises(ValueError):
        write("upsert", docs, same)


def test_declaring_fields():
    fields = {"a": Field("keyword"), "b": Field("text")}
    assert set(extend_fields(fields, {"c": "date", "a": "tag"}, True)) == {"a", "b", "c"}
    for wrong in ({"a": "text"}, {"a": Field("keyword", identifier=True)}, {"z": Field("keyword", identifier=True)}):
        with pytest.raises(ValueError):
            extend_fields(fields, wrong, True)
    assert extend_fields(fields, {"z": Field("keyword", identifier=True)}, False)["z"].identifier
    assert change_type(fields, "a", "url")["a"].type == "url"
    for name, kind in (("a", "date"), ("q", "url")):
        with pytest.raises(ValueError):
            change_type(fields, name, kind)
    with pytest.raises(ValueError):
        Field("tag", identifier=True)
    with pytest.raises(ValueError):
        Field("keyword", storage="text")


def test_update_where(docs):
    edited = update_where(docs, "subcat", "z", filters={"cat": "a"})
    assert column(edited.table, "subcat") == {"0": "z", "1": "z", "2": "z", "3": "y"}
    assert values(edited.report) == [(3, 3)]
    assert column(update_where(docs, "subcat", None, filters={"cat": "b"}).table, "subcat")["3"] is None
    assert column(update_where(docs, "i", 5, queries="test").table, "i") == {"0": 1, "1": 5, "2": 5, "3": 31}
    with pytest.raises(ValueError):
        update_where(docs, "nope", 1)


def test_delete_where(docs):
    edited = delete_where(docs, filters={"cat": "a"})
    assert ids(edited.table) == ["3"] and values(edited.report) == [(3, 3)]
    assert ids(delete_where(docs, ids=["0", "3"]).table) == ["1", "2"]


def test_tags(docs):
    first = tag_where(docs, "add", "tags", "x", filters={"cat": "a"})
    assert values(first.report) == [(3, 3)]
    second = tag_where(first.table, "remove", "tags", "x", queries="text")
    assert values(second.report) == [(2, 2)]
    third = tag_where(second.table, "add", "tags", "y", ids=["1", "2"])
    assert values(third.report) == [(2, 2)]
    assert column(third.table, "tags") == {"0": None, "1": ["y"], "2": ["x", "y"], "3": None}
    again = tag_where(third.table, "add", "tags", "y")
    assert values(again.report) == [(2, 4)]
    assert values(tag_where(third.table, "remove", "tags", "zz").report) == [(2, 4)]
    for action, field in (("add", "cat"), ("drop", "tags")):
        with pytest.raises(ValueError):
            tag_where(docs, action, field, "x")


def test_copy_where(docs):
    empty = docs.limit(0)
    assert ids(copy_where(docs, empty, filters={"cat": "b"})) == ["3"]
    options = {"title": {"exclude": True}, "i": {"rename": "number"}, "cat": {"type": "tag"}}
    copied = copy_where(docs, declare(docs.select("_id", "text").limit(0), {"text": "text"}), field_options=options)
    assert set(copied.columns) == {"_id", "text", "cat", "subcat", "date", "number"}
    assert column(copied, "number")["2"] == 11 and column(copied, "cat")["3"] == ["b"]
    onto = update_where(docs, "cat", "old").table
    assert sorted(column(copy_where(docs, onto, "test"), "cat").values()) == ["a", "a", "old", "old"]
