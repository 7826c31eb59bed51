from __future__ import annotations

import csv
import datetime as dt
import gzip
import json
import os
import random

import pytest
from core_samples import ids, values

import docsieve.sources.files as source_files
from docsieve.operators.write import tag_where
from docsieve.schema import Field, Snippet, declare, fields_of
from docsieve.sources.files import (
    column_name,
    export_batches,
    export_fields,
    export_roles,
    export_settings,
    read_lines,
    scan_objects,
    sink_csv,
    sink_export,
    source_csv,
    source_export,
    source_text_folder,
    store_listing,
)
from docsieve.sources.projects import read_project
from docsieve.streaming.ingest import fold, ingest, watch_documents


def test_headers():
    assert [column_name(n) for n in ("Title", "_id", "Date of Birth", "__x", "a-b.c")] == ["title", "id", "date_of_birth", "_x", "a_b_c"]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('Full Name,_Text\n"a ""b""","line\none"\n,\n"x, y",\n', encoding="utf-8")
    df = source_csv(spark, str(path))
    assert df.columns == ["full_name", "text"]
    assert values(df) == [('a "b"', "line\none"), ("x, y", None)]


def test_csv_round_trip(spark, docs, tmp_path):
    sink_csv(docs, str(tmp_path / "out"))
    back = source_csv(spark, str(tmp_path / "out"))
    assert sorted(values(back.select("id", "text", "i"))) == sorted((r["_id"], r["text"], str(r["i"])) for r in docs.collect())
    sink_csv(tag_where(docs, "add", "tags", "a\tb").table, str(tmp_path / "tsv"), "\t")
    assert source_csv(spark, str(tmp_path / "tsv"), "\t").first()["tags"] == '["a\\tb"]'


@pytest.fixture
def small_chunks(spark):
    """Files are split every 700 bytes, as big ones are every 128 MB."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "700")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def one_task(spark, path, separator=","):
    return source_files._simple_names(source_files._csv_reader(spark, separator, True).csv(path))


def cell(dice: random.Random) -> str:
    return "".join(dice.choices(["a", "ü", " ", ",", '"', "\n", "\n\n", "\t", "\\", "\r\n", "'"], k=dice.randrange(0, 60)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("separator", [",", "\t", "|"])
def test_csv_with_breaks_is_read_in_chunks(spark, tmp_path, small_chunks, end, separator):
    """Cells with breaks, separators and quotes, over many chunks; some records are longer than a chunk."""
    dice = random.Random(f"{end}{separator}")
    rows = [[str(i), cell(dice), cell(dice) * dice.choice([1, 1, 1, 40])] for i in range(300)]
    rows[7] = ["id", "a text", "b"]  # A row that equals the header is a row.
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", encoding="utf-8", newline="") as file:
            writer = csv.writer(file, delimiter=separator, lineterminator=end)
            writer.writerows([["id", "a text", "b"], *rows[part::2]])
    lines = source_files._csv_lines(spark, str(tmp_path))
    assert lines.select("file", "chunk").distinct().count() > 20
    found = source_csv(spark, str(tmp_path), separator)
    assert found.columns == ["id", "a_text", "b"]
    assert sorted(values(found)) == sorted(tuple(c or None for c in r) for r in rows)
    assert "FileScan csv" not in found._jdf.queryExecution().executedPlan().toString()


def test_csv_lines_without_breaks_need_no_shuffle(spark, tmp_path, small_chunks):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x, ""y"""\n' for i in range(400)))
    found = source_csv(spark, str(tmp_path))
    assert found.count() == 400 and found.rdd.getNumPartitions() > 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text",
    [
        'a,b\n5" disk,x\n6" disk,y\n',  # Quotes in bare cells, one a line: together they look like a break.
        'a,b\n5" disk,x\n',
        'a,b\n"x" y,1\n"p\nq",2\n',
        "a,b\r1,2\r3,4\r",
        'a,b\r\n"x\ry",2\r\n',
        'a,b\n"x\ny"\n1,2,3\n\n,\n"",""\n',
        '\ufeffa,b\n"x\ny",2\n',
        '"a\nb",c\n"1\n2",3',
        "a,b\n",
        'a,b\n"open\n1,2\n',
    ],
)
def test_odd_csv_is_read_as_by_one_task(spark, tmp_path, text):
    (tmp_path / "t.csv").write_bytes(text.encode())
    found, plain = source_csv(spark, str(tmp_path / "t.csv")), one_task(spark, str(tmp_path / "t.csv"))
    assert found.columns == plain.columns
    assert sorted(map(str, values(found))) == sorted(map(str, values(plain)))


def test_csv_files_with_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x\ny",2\n')
    (tmp_path / "b.csv").write_text('b,a\n"x\ny",2\n')
    with pytest.raises(Exception, match="header"):
        source_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("compression", ["gzip", None])
def test_export_round_trip(spark, docs, tmp_path, compression):
    full = declare(docs, {"text": Field("text", access="snippet", max_snippet=Snippet(10, 1, 5))})
    full = tag_where(full, "add", "tags", "x", queries="test").table
    path = str(tmp_path / "export")
    sink_export(full, path, {"id": "p", "name": "Project"}, [("a@b.c", "READER"), ("*", "NONE")], compression)
    back = source_export(spark, path)
    assert sorted(map(str, values(back.select(full.columns)))) == sorted(map(str, values(full)))
    assert fields_of(back) == fields_of(full)
    lines = read_lines(spark, path)
    assert values(export_roles(lines)) == [("a@b.c", "READER")]
    assert export_settings(lines) == {"id": "p", "name": "Project"}


def test_export_of_objects_and_without_field_lines(spark, tmp_path):
    lines = [
        {"_type": "field", "name": "o", "type": "object", "elastic_type": "flattened"},
        {"_type": "document", "_id": "1", "o": [{"term": "x", "value": 1.5}]},
    ]
    with gzip.open(tmp_path / "a.ndjson.gz", "wt") as file:
        file.write("\n".join(map(json.dumps, lines)) + "\n\n")
    assert values(source_export(spark, str(tmp_path / "a.ndjson.gz"))) == [("1", '[{"term":"x","value":1.5}]')]
    (tmp_path / "b.ndjson").write_text('{"_type":"document","_id":"1","b":"x"}\n{"_type":"document","_id":"2","a":"y"}\n')
    found = source_export(spark, str(tmp_path / "b.ndjson"))
    assert found.columns == ["_id", "a", "b"] and sorted(map(str, values(found))) == ["('1', None, 'x')", "('2', 'y', None)"]


def test_ids_that_follow_from_identifiers_are_left_out(spark, tmp_path):
    df = spark.createDataFrame([("1", "u")], "_id string, url string")
    sink_export(declare(df, {"url": Field("url", identifier=True)}), str(tmp_path / "x"))
    assert source_export(spark, str(tmp_path / "x")).columns == ["url"]


def test_text_folder(spark, tmp_path):
    (tmp_path / "root" / "sub dir" / "deep").mkdir(parents=True)
    for name, text in (("one.txt", "first\ntext"), ("sub dir/two.v2.txt", "second"), ("sub dir/deep/+ä.txt", "third"),
                       ("blank.txt", " \n "), ("other.md", "no")):
        (tmp_path / "root" / name).write_text(text, encoding="utf-8")
    os.utime(tmp_path / "root" / "one.txt", (0, 86_400 * 3 + 100))
    found = source_text_folder(spark, str(tmp_path / "root"))
    assert found.columns == ["filename", "folder", "text", "date"]
    rows = {r["filename"]: r for r in found.collect()}
    assert {k: (r["folder"], r["text"]) for k, r in rows.items()} == {
        "one": (".", "first\ntext"), "two.v2": ("sub dir", "second"), "+ä": ("sub dir/deep", "third"),
    }
    assert rows["one"]["date"] == dt.date(1970, 1, 4)
    flat = source_text_folder(spark, str(tmp_path / "root" / "sub dir" / "deep"))
    assert flat.columns == ["filename", "text", "date"]


def test_object_listing(spark, tmp_path):
    for key, size in (("p/f/a/x.png", 3), ("p/f/y.png", 4), ("q/f/z.png", 5)):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(b"x" * size)
    listed = scan_objects(spark, str(tmp_path), "p/")
    assert sorted(values(listed.select("key", "size"))) == [("p/f/a/x.png", 3), ("p/f/y.png", 4)]
    assert sorted(values(store_listing(listed))) == [("p", "f", "a/x.png", 3), ("p", "f", "y.png", 4)]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_batches_of_files(spark, many, tmp_path):
    export_batches(many.coalesce(1), str(tmp_path / "out"), 6)
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]) == 4
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_reading_a_project(spark, tmp_path):
    spark.createDataFrame([(1, 2, "t", "no")], "a int, b int, text string, other string").write.parquet(str(tmp_path / "p"))
    df = read_project(spark, str(tmp_path / "p"), ["a", "b"], {"text": "text"})
    assert df.columns == ["_id", "text"] and ids(df) == ["1-2"] and fields_of(df)["text"].type == "text"


@pytest.mark.parametrize("operation", ["index", "upsert", "create", "update"])
def test_sending_batches_again_changes_nothing(spark, docs, tmp_path, operation):
    sent, staging = str(tmp_path / "sent"), str(tmp_path / "staging")
    schema = "_id string, cat string, i bigint"

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(sent)

    def take(progress):
        documents = watch_documents(spark, sent, spark.createDataFrame([], schema).schema, "json")
        ingest(documents, staging, str(tmp_path / progress)).awaitTermination()
        return sorted(map(str, values(fold(docs, staging, operation).table.select("_id", "cat", "i", "title"))))

    send(("0", "new", None), ("7", "n", 1))
    first = take("one")
    assert take("one") == first  # nothing new
    assert take("two") == first  # everything again, from the start
    send(("7", None, 8))
    later = take("one")
    expected = {"index": "('7', None, 8, None)", "upsert": "('7', 'n', 8, None)", "create": "('7', 'n', 1, None)"}
    assert (expected[operation] in later) if operation in expected else later == first


def test_export_is_read_once(spark, docs, tmp_path):
    """Field, role and settings lines are found without reading documents, and documents without reading those."""
    path = str(tmp_path / "export")
    sink_export(docs, path, {"id": "p"}, [("a@b.c", "READER")], None)
    lines = read_lines(spark, path)
    for df, part in ((export_roles(lines), "head"), (source_export(spark, path), "document")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") == 1 and "(part#" in text and f"= {part})" in text
    # Documents that cannot be parsed do no harm as long as only the other lines are asked for.
    (tmp_path / "export" / "part=document" / "broken.txt").write_text('{"_type": "document", "_id": ')
    assert set(export_fields(read_lines(spark, path))) == set(docs.columns) - {"_id"}


def test_export_in_one_file_with_declared_and_other_keys(spark, tmp_path):
    """A plain file needs one look for both: field lines decide where there are some, also behind documents."""
    document = '{"_type": "document", "_id": "1", "a": "x", "b": "y"}\n'
    (tmp_path / "a.ndjson").write_text(document + '{"name": "b", "type": "keyword", "_type": "field"}\n')
    assert values(source_export(spark, str(tmp_path / "a.ndjson"))) == [("1", "y")]
    (tmp_path / "b.ndjson").write_text(document + '\n{"_type": "document", "_id": "2", "c d": "z"}\n')
    found = source_export(spark, str(tmp_path / "b.ndjson"))
    assert found.columns == ["_id", "a", "b", "c d"]
    assert sorted(values(found)) == [("1", "x", "y", None), ("2", None, None, "z")]
    (tmp_path / "c.ndjson").write_text("")
    assert values(source_export(spark, str(tmp_path / "c.ndjson"))) == []
