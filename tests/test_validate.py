from __future__ import annotations

import datetime as dt

import pytest
from core_samples import as_dict, values
from pyspark.sql import functions as F

from docsieve.functions import coerce
from docsieve.operators import validate
from docsieve.operators.validate import (
    coerce_rows,
    find_duplicates,
    has_duplicates,
    infer_types,
    invalid_examples,
    missing_media,
    validate_columns,
)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2018-01-01", dt.datetime(2018, 1, 1)),
        ("2018-01-01T10:20", dt.datetime(2018, 1, 1, 10, 20)),
        ("2018-01-01 10:20:30.25", dt.datetime(2018, 1, 1, 10, 20, 30, 250000)),
        ("2018-01-01T10:20:30Z", dt.datetime(2018, 1, 1, 10, 20, 30)),
        ("2018-01-01T10:20Z", dt.datetime(2018, 1, 1, 10, 20)),
        ("2018-01-01T01:00:00+02:00", dt.datetime(2017, 12, 31, 23)),
        ("2018-01-01T23:00:00-0130", dt.datetime(2018, 1, 2, 0, 30)),
        ("0001-01-01", dt.datetime(1, 1, 1)),
        ("9999-12-31", dt.datetime(9999, 12, 31)),
        ("0000-01-01", None),
        ("-0001-11-30T00:00:00", None),
        ("2018-02", None),
        ("2018-02-30", None),
        ("01-02-2018", None),
        ("2018-1-1", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(coerce.coerce_date(F.col("t")), coerce.is_date(F.col("t"))).first() == (expected, expected is not None)


def test_numbers_and_booleans(spark):
    given = ["1", "-2", "0", "0.5", "3.0", "1e3", "007", "1,5", "", None, "x", "12.", "99999999999"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, t string")
    number = [r[0] for r in df.select("i", coerce.coerce_number(F.col("t")).alias("v")).orderBy("i").select("v").collect()]
    assert number == [1.0, -2.0, 0.0, 0.5, 3.0, 1000.0, None, None, None, None, None, 12.0, 99999999999.0]
    whole = [r[0] for r in df.select("i", coerce.coerce_integer(F.col("t")).alias("v")).orderBy("i").select("v").collect()]
    assert whole == [1, -2, 0, None, 3, 1000, 7, None, None, None, None, 12, 99999999999]
    flags = spark.createDataFrame([(v,) for v in ["true", "FALSE", "1", "0", "yes", None]], "t string")
    assert [r[0] for r in flags.select(coerce.coerce_boolean(F.col("t"))).collect()] == [True, False, True, False, None, None]


def raw(spark, columns):
    names, rows = list(columns), list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_types(spark):
    n = 20
    df = raw(
        spark,
        {
            "day": ["2020-01-01"] * 17 + ["", "x", None],  # 15 % invalid
            "notday": ["2020-01-01"] * 16 + ["x"] * 4,  # 20 % is too much; no blanks, so a keyword
            "whole": [str(i) for i in range(n)],
            "broken": ["1.5"] * 10 + ["2"] * 10,
            "most": [str(i) for i in range(17)] + ["x", "y", "z"],
            "code": [f"0{i}" for i in range(n)],
            "link": [f"http://a/{i}" for i in range(n)],
            "flag": ["True", "false"] * 10,
            "few": ["red car", "blue car"] * 10,
            "many": [f"text number {i}" for i in range(n)],
            "half": [f"a b {i}" for i in range(10)] * 2,
            "long": ["word " * 30] * n,
        },
    )
    assert as_dict(infer_types(df)) == {
        "day": "date",
        "notday": "keyword",
        "whole": "integer",
        "broken": "number",
        "most": "number",
        "code": "keyword",
        "link": "url",
        "flag": "boolean",
        "few": "keyword",
        "many": "text",
        "half": "text",  # a share of exactly one half is not below it
        "long": "text",
    }
    with pytest.raises(ValueError):
        infer_types(df.limit(0))


def test_distinct_share_near_the_threshold_is_exact(spark):
    for distinct, expected in ((4999, "keyword"), (5000, "text")):
        value = F.concat(F.lit("v "), (F.col("id") % distinct).cast("string")).alias("v")
        assert as_dict(infer_types(spark.range(10_000).select(value))) == {"v": expected}


def test_column_status(spark):
    df = raw(
        spark,
        {
            "ok": ["a", "b", "c"],
            "long": ["a", "x" * 257, ""],
            "empty": ["a", "", ""],
            "digits": ["1", "2", "3"],
            "day": ["2020-01-01", "x", None],
            "whole": ["1", "2", "3.5"],
            "minus": ["1", "-2", "x"],
            "flag": ["true", "false", "0"],
            "pic": ["a/b.png", "http://x/y", "c.txt"],
        },
    )
    types = dict(ok="keyword", long="keyword", empty="text", digits="text", day="date", whole="integer",
                 minus="integer", flag="boolean", pic="image")
    found = {r["column"]: (r["status"], r["problem"], r["n"]) for r in validate_columns(df, types, ["minus"]).collect()}
    assert found == {
        "ok": ("Ready", "", 0),
        "long": ("Type invalid", "too long", 1),
        "empty": ("Type invalid", "empty", 2),
        "digits": ("Type warning", "all numeric", 0),
        "day": ("Type invalid", "invalid date", 2),
        "whole": ("Type invalid", "invalid integer", 1),
        "minus": ("Type invalid", "invalid integer", 2),
        "flag": ("Ready", "", 0),
        "pic": ("Type invalid", "invalid image", 1),
    }


def test_examples_are_the_first_ones(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("1").alias("a"),
                                  F.concat(F.lit("v"), "id").alias("b"))
    found = invalid_examples(df, {"a": "number", "b": "date"}, ["id"], 3)
    assert sorted(values(found)) == [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "x"), ("b", 1, "v0"), ("b", 2, "v1"), ("b", 3, "v2")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rows_are_coerced(spark):
    df = raw(spark, {"a": ["1", "x"], "b": ["2020-01-01", "nope"], "c": ["true", "maybe"], "d": ["t", "u"]})
    rows = coerce_rows(df, {"a": "number", "b": "date", "c": "boolean", "d": "text"}, {"d": "title"})
    assert rows.columns == ["a", "b", "c", "title"]
    assert values(rows) == [(1.0, dt.datetime(2020, 1, 1), True, "t"), (None, None, None, "u")]


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "x string, y int")
    assert as_dict(find_duplicates(df, ["x"])) == {"a": 2, "b": 2}
    assert values(find_duplicates(df)) == [("b", 1, 2)]
    assert has_duplicates(df) and not has_duplicates(df.distinct())


def test_missing_media(spark):
    df = raw(spark, {"p": ["a.png", "a.png", "b.JPG", "http://x/y.doc", "c.mp4", "noext"]})
    register = spark.createDataFrame([("a.png",), ("c.mp4",)], "filepath string")
    assert as_dict(missing_media(df, "p", "image", register)) == {"b.JPG": 1, "c.mp4": 1, "noext": 1}
    assert as_dict(missing_media(df, "p", "video", register)) == {"a.png": 2, "b.JPG": 1, "noext": 1}


def test_limits_are_the_documented_ones():
    assert (validate.MAX_INVALID, validate.MAX_DISTINCT, validate.MAX_KEYWORD, validate.MAX_EXAMPLES) == (0.2, 0.5, 256, 100)


def test_long_duplicates_are_found_by_digest(spark, tmp_path):
    rows = [("a", None, 1), ("a", None, 2), (None, "a", 3), ("b", "b" * 2000, 4), ("c", "b" * 2000, 5), ("c", "b" * 2000, 6)]
    spark.createDataFrame(rows * 1, "t string, u string, n int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(values(find_duplicates(df, ["t", "u"])), key=str) == [("a", None, 2), ("c", "b" * 2000, 2)]
    assert values(find_duplicates(df, ["u"]).where("u is null")) == [(None, 2)]
    assert values(find_duplicates(df)) == [] and values(find_duplicates(df, ["n"])) == []
    # Only the values that repeat are dealt out.
    counts = find_duplicates(df, ["t", "u"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(t") < plan.index("LeftSemi")
