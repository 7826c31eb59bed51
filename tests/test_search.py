from __future__ import annotations

import datetime as dt

import pytest
from core_samples import ids, values
from pyspark.sql import functions as F

from docsieve.functions.text import Fuzzy, Phrase, Prefix, Regex, Wildcard, Word, labelled, split_labels, store_words
from docsieve.operators.filters import MAX_LITERAL_IDS, Filter, id_list, mark_selected, select
from docsieve.operators.search import batches, next_batch, page_meta, project_fields, search, sort_documents
from docsieve.schema import Snippet, declare
from docsieve.sources.projects import scan_multi, scan_project

QUERIES = [
    ("test", ["1", "2"]),
    ("test*", ["1", "2", "3"]),
    ('"a text"', ["0"]),
    (["this", "toto"], ["0", "2", "3"]),
    ({"one": "this", "two": "bla"}, ["0", "2", "3"]),
    ("this toto", ["0", "2", "3"]),
    ("this OR toto", ["0", "2", "3"]),
    ("this AND toto", ["2"]),
    ("this AND NOT toto", ["0"]),
    ("+text -this", ["1"]),
    ("NOT this", ["1", "3"]),
    ("test AND title", ["1"]),  # each word may be in another field
    ("title:bla", ["2", "3"]),
    ("title:bla AND cat:b", ["3"]),
    ("_exists_:title", ["0", "1", "2", "3"]),
    ("te?t", ["0", "1", "2"]),
    ("t*t", ["0", "1", "2"]),
    ("/te[sx]t/", ["0", "1", "2"]),
    ("tast~1", ["1", "2"]),
    ("tets~1", ["1", "2"]),
    ("etts~2", ["1", "2"]),
    ('"test a"~2', ["1"]),
    ('"test a"~1', []),
    ('"this test"~2', ["2"]),
    ('"this test"~1', []),
    ("b", ["3"]),  # a keyword by its exact value
    ("B", []),
    ("článek", ["3"]),
    ("ČLÁNEK", ["3"]),
    ("lánek", []),
    (Word("test") & ~Word("toto"), ["1"]),
    (Phrase("is a") | Prefix("člá"), ["0", "3"]),
    ((Word("this") | Word("text")) & Word("title"), ["0", "1"]),
]


@pytest.mark.parametrize("query,expected", QUERIES, ids=[str(q) for q, _ in QUERIES])
def test_queries(docs, query, expected):
    assert ids(select(docs, query)) == expected
    # The same over stored words, and as a column.
    assert ids(select(store_words(docs, "text"), query)) == expected
    marked = mark_selected(docs, "hit", query)
    assert ids(marked.where("hit")) == expected
    assert marked.where("hit is null").count() == 0


def test_groups_in_typed_queries(docs):
    tree = (Word("this") | Word("that")) & Word("test")
    assert ids(select(docs, "(this OR that) AND test")) == ids(select(docs, tree))
    assert ids(select(docs, "this OR (that AND test)")) == ids(select(docs, Word("this") | Word("that") & Word("test")))


def test_query_shorthands():
    assert list(labelled("a")) == ["1"]
    assert list(labelled(["a", "b"])) == ["0", "1"]
    assert labelled(None) == {}
    assert split_labels("first = a OR b; c\n\nsecond=d") == {"first": "a OR b", "c": "c", "second": "d"}


def test_leaves_check_their_arguments(docs):
    with pytest.raises(ValueError):
        Fuzzy("x", 3)
    assert ids(select(docs, Wildcard("?est") | Regex("tot.+"))) == ["1", "2", "3"]


FILTERS = [
    ({"title": "title"}, ["0", "1"]),
    ({"title": "Title"}, []),
    ({"cat": "a"}, ["0", "1", "2"]),
    ({"cat": ["a", "b"], "i": [2, 31]}, ["1", "3"]),
    ({"i": {"values": ["2"]}}, ["1"]),
    ({"cat": []}, ["0", "1", "2", "3"]),
    ({}, ["0", "1", "2", "3"]),
    ({"date": {"gt": "2018-02-01"}}, ["2"]),
    ({"date": {"gte": "2018-02-01"}}, ["1", "2"]),
    ({"date": {"lte": "2018-02-01"}}, ["0", "1", "3"]),
    ({"date": {"lt": "2018-02-01"}}, ["0", "3"]),
    ({"date": {"gte": "2018-02-01", "lt": "2020-01-01"}}, ["1"]),
    ({"date": {"lte": "2018"}}, ["0", "1", "3"]),
    ({"date": {"gt": "2018"}}, ["2"]),
    ({"date": {"gte": dt.date(2018, 2, 1)}}, ["1", "2"]),
    ({"date": "2018-01-01"}, ["0", "3"]),
    ({"date": ["2018-01-01", "2020-01-01"]}, ["0", "2", "3"]),
    ({"date": "2018-01-01T01:00:00+01:00"}, ["0", "3"]),
    ({"date": {"monthnr": 2}}, ["1"]),
    ({"date": {"dayofweek": "Monday"}}, ["0", "3"]),
    ({"date": {"monthnr": 2, "gte": "2019-01-01"}}, ["1", "2"]),  # conditions on one field are OR-ed
    ({"i": {"gt": 1, "lte": 11}}, ["1", "2"]),
    ({"i": {"values": [1], "gt": 11}}, ["0", "3"]),
    ({"i": {"exists": True}}, ["0", "1", "2", "3"]),
    ({"i": {"exists": False}}, []),
    ({"cat": Filter(values=["b"], exists=False)}, ["3"]),
]


@pytest.mark.parametrize("filters,expected", FILTERS, ids=[str(f) for f, _ in FILTERS])
def test_filters(docs, filters, expected):
    assert ids(select(docs, filters=filters)) == expected


def test_wrong_filters_are_refused(docs):
    for filters in ({"nope": "x"}, {"cat": {"like": "x"}}, {"date": "yesterday"}):
        with pytest.raises(ValueError):
            select(docs, filters=filters)


def test_nulls_do_not_match(spark):
    df = spark.createDataFrame([("0", None, None), ("1", "x", ["p", "q"]), ("2", "", [])], "_id string, t string, g array<string>")
    df = declare(df, {"t": "text", "g": "tag"})
    assert ids(select(df, "NOT x")) == ["0", "2"]
    assert ids(select(df, filters={"t": {"exists": False}})) == ["0"]
    assert ids(select(df, filters={"g": {"exists": False}})) == ["0", "2"]
    assert ids(select(df, filters={"g": {"exists": True}})) == ["1"]
    assert ids(select(df, filters={"g": ["q", "z"]})) == ["1"]
    assert ids(select(df, "p")) == ["1"]


def test_filter_ids(docs, spark):
    assert ids(select(docs, ids=["1", "3", "9"])) == ["1", "3"]
    assert ids(select(docs, ids="1,\n 3 ,")) == ["1", "3"]
    assert id_list("a, b\nc") == ["a", "b", "c"]
    long = [str(i) for i in range(1, MAX_LITERAL_IDS + 10)]
    assert ids(select(docs, ids=long)) == ["1", "2", "3"]
    assert ids(mark_selected(docs, "hit", ids=long).where("not hit")) == ["0"]
    assert ids(select(docs, "test", {"cat": "a"}, spark.createDataFrame([("1",), ("3",)], "_id string"))) == ["1"]
    assert ids(select(docs, ids=[])) == []


def test_projection(docs):
    assert project_fields(docs).columns == ["_id"]
    assert search(docs, "test", fields=["cat", "title"]).columns == ["_id", "cat", "title"]
    assert scan_project(docs, include=["cat"]).columns == ["_id", "cat"]
    assert "text" not in scan_project(docs, exclude=["text"]).columns


def test_snippets(docs):
    def texts(query, snippet, **options):
        found = search(docs, query, fields={"text": snippet}, sort="_id", **options)
        return [row["text"] for row in found.collect()]

    assert texts(None, Snippet(5)) == ["this is", "a test", "and this", "Toto je"]
    assert texts(None, Snippet(100))[0] == "this is a text"
    assert texts("test", Snippet(5, 1, 4), highlight=True) == ["a <em>test</em>", "<em>test</em>"]
    # A query that does not match the field gives the head.
    assert texts("title", Snippet(5, 2, 10)) == ["this is", "a test"]


def test_several_fragments(spark):
    text = "one hit here " + "x " * 40 + "then a hit there " + "y " * 40 + "last hit"
    df = declare(spark.createDataFrame([("0", text)], "_id string, text string"), {"text": "text"})
    two = search(df, "hit", fields={"text": Snippet(10, 2, 12)}).first()["text"]
    assert two == "one hit here ... a hit there"
    assert len(search(df, "hit", fields={"text": Snippet(10, 9, 12)}).first()["text"].split(" ... ")) == 3


def test_highlight(spark, docs):
    text = "Deze tekst is geen test text. Protest! Test-text."
    df = declare(spark.createDataFrame([("0", "Een test titel", text)], "_id string, title string, text string"),
                 {"title": "text", "text": "text"})
    row = search(df, "te*", fields=["title", "text"], highlight=True).first()
    assert row["title"] == "Een <em>test</em> titel"
    assert row["text"] == (
        "Deze <em>tekst</em> is geen <em>test</em> <em>text</em>. Protest! <em>Test</em>-<em>text</em>."
    )
    phrase = search(docs, '"a text" OR this', fields=["text"], highlight=True, sort="_id").collect()
    assert [r["text"] for r in phrase] == ["<em>this</em> is <em>a text</em>", "and <em>this</em> is another test toto"]


def test_paging(many):
    pages = [search(many, fields=["id"], sort="id", page=p, per_page=6).collect() for p in range(5)]
    assert [len(p) for p in pages] == [6, 6, 6, 2, 0]
    assert [r["id"] for p in pages for r in p] == list(range(20))
    assert values(page_meta(many, 6)) == [(20, 6, 4, 0)]
    assert values(page_meta(many, 4, 1, "odd")) == [(10, 4, 3, 1)]
    assert search(many, page=10**6, per_page=200).collect() == []


def test_sorting(many, spark):
    def first(sort):
        return [r["id"] for r in search(many, fields=["id"], sort=sort, per_page=5).collect()]

    assert first("pagenr") == [10, 11, 9, 12, 8]  # ties by id string
    assert first(["pagenr", "id"]) == [10, 9, 11, 8, 12]
    assert first([{"pagenr": {"order": "desc"}}, "id"]) == [0, 1, 19, 2, 18]
    gaps = spark.createDataFrame([("0", None), ("1", 1), ("2", 2)], "_id string, k int")
    assert [r["_id"] for r in sort_documents(gaps, "k").collect()] == ["1", "2", "0"]
    assert [r["_id"] for r in sort_documents(gaps, {"k": "desc"}).collect()] == ["2", "1", "0"]


def test_random_order_is_stable_and_complete(many):
    once = [r["_id"] for r in sort_documents(many, "?", seed=1).collect()]
    assert once == [r["_id"] for r in sort_documents(many.repartition(3), "?", seed=1).collect()]
    assert sorted(once) == sorted(str(i) for i in range(20)) and once != sorted(once)
    assert once != [r["_id"] for r in sort_documents(many, "?", seed=2).collect()]


def test_batches(many):
    odd = select(many, "odd")
    assert [len(b) for b in batches(odd, 4)] == [4, 4, 2]
    together = [r["id"] for b in batches(many, 7, ["pagenr", "id"]) for r in b]
    assert together == [r["id"] for r in search(many, fields=["id"], sort=["pagenr", "id"], per_page=20).collect()]
    assert next_batch(odd, 3, after={"_id": "9"}).count() == 0


def test_several_projects(docs, spark):
    other = declare(
        spark.createDataFrame([("10", "also a text", -1, "c")], "_id string, text string, i bigint, cat string"),
        {"text": "text"},
    )
    both = scan_multi([docs, other])
    assert both.count() == 5
    assert ids(select(both, "text")) == ["0", "1", "10"]
    assert both.where("_id = '10'").first()["title"] is None
    clash = declare(spark.createDataFrame([("1", "x")], "_id string, text string"), {"text": "keyword"})
    with pytest.raises(ValueError):
        scan_multi([docs, clash])


def test_scan(docs):
    found = scan_project(docs, filters={"cat": "a"}, sort={"i": "desc"}, include=["i"])
    assert [r["i"] for r in found.collect()] == [11, 2, 1]
    assert found.where(F.col("i") > 1).count() == 2


def test_marks_keep_to_the_field_that_was_asked(docs):
    row = search(docs, "title:text OR text:text", fields=["text", "title"], highlight=True, sort="_id").first()
    assert (row["text"], row["title"]) == ("this is a <em>text</em>", "title")
    row = search(docs, "cat:a AND title:title", fields=["text", "title"], highlight=True, sort="_id").first()
    assert (row["text"], row["title"]) == ("this is a text", "<em>title</em>")


def test_words_found_by_likeness_are_marked(docs):
    def texts(query):
        return [r["text"] for r in search(docs, query, fields=["text"], highlight=True, sort="_id").collect()]

    assert texts("tets~1 text") == ["this is a <em>text</em>", "a <em>test</em> <em>text</em>", "and this is another <em>test</em> toto"]
    assert texts("/te[xs]t/ AND title") == ["this is a <em>text</em>", "a <em>test</em> <em>text</em>"]
    assert texts("title AND zzzz~1") == []
    found = search(docs, "text:/t[ae]xt/", fields={"text": Snippet(5, 1, 4)}, highlight=True, sort="_id")
    assert [r["text"] for r in found.collect()] == ["a <em>text</em>", "<em>text</em>"]


def test_a_start_that_no_word_has_matches_nothing(docs):
    for query in ("te-*", "tes.t-*"):
        assert ids(select(docs, query)) == ids(select(store_words(docs, "text"), query)) == []


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_date_bounds_for_each_kind_of_column(spark, kind):
    rows = [(str(i), f"2020-01-0{i}") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "_id string, d string").withColumn("d", F.col("d").cast(kind))
    assert ids(select(df, filters={"d": {"gte": "2020-01-02", "lte": "2020-01-03"}})) == ["2", "3"]
    assert ids(select(df, filters={"d": {"gt": "2020-01-03"}})) == ["4", "5"]
    assert ids(select(df, filters={"d": {"gt": "2020-01-03T12:00", "lt": "2020-01-05T00:00:00Z"}})) == ["4"]
    assert ids(select(df, filters={"d": ["2020-01-04"]})) == ["4"]


def test_typed_values(spark):
    rows = [
        ("0", 1, 0.5, "2020-01-01", True, "a", ["x"]),
        ("1", 2, 1.5, "2020-01-02", False, "b", []),
        ("2", None, None, None, None, None, None),
        ("3", 30, -2.0, "2020-02-01", True, "c", ["y", "z"]),
    ]
    names = "_id string, q bigint, x double, d string, b boolean, k string, tags array<string>"
    df = spark.createDataFrame(rows, names).withColumn("d", F.col("d").cast("timestamp_ntz"))
    df = declare(df, {"q": "integer", "x": "number", "d": "date", "b": "boolean", "k": "keyword", "tags": "tag"})

    def found(query):
        return ids(select(df, query))

    assert found("q:1") == ["0"] and found("x:1.5") == ["1"] and found("b:true") == ["0", "3"]
    assert found("d:2020-01") == ["0", "1"] and found('d:"2020-01-02"') == ["1"]
    assert found("q:[1 TO 2]") == ["0", "1"] and found("q:{1 TO 30}") == ["1"] and found("q:{1 TO 30]") == ["1", "3"]
    assert found("x:[* TO 0]") == ["3"] and found("x:[0 TO *]") == ["0", "1"]
    assert found("d:[2020-01-02 TO 2020-02]") == ["1", "3"] and found("k:[b TO *]") == ["1", "3"]
    assert found("q:1 OR k:c") == ["0", "3"] and found("q:[1 TO 30] -b:false") == ["0", "3"]
    # Without a value nothing matches, and so everything but that does.
    assert found("NOT q:1") == ["1", "2", "3"] and found("NOT x:[0 TO *]") == ["2", "3"]
    assert found("_exists_:tags") == ids(select(df, filters={"tags": {"exists": True}})) == ["0", "3"]
    assert found("_exists_:q") == ["0", "1", "3"] and found("NOT _exists_:tags") == ["1", "2"]
    assert ids(select(df, " ".join(f"q:{i}" for i in range(20)))) == ["0", "1"]
    for wrong in ("q:one", "nothing:1", "[1 TO 2]", "q:1*"):
        with pytest.raises(ValueError):
            found(wrong)


def test_typed_ranges_reach_the_scan(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("_id"), "id", F.lit("a text").alias("text"))
    df.write.parquet(f"{tmp_path}/t")
    df = declare(spark.read.parquet(f"{tmp_path}/t"), {"id": "integer", "text": "text"})
    found = select(df, "id:[10 TO 20} AND text AND a")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "LessThan(id,20)" in plan
    assert found.count() == 10
