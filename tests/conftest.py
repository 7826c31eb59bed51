from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from docsieve.schema import declare  # noqa: E402
from docsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    """Four documents with keywords, a number, a date and two texts."""
    rows = [
        ("0", "a", "x", 1, "2018-01-01", "this is a text", "title"),
        ("1", "a", "x", 2, "2018-02-01", "a test text", "title"),
        ("2", "a", "y", 11, "2020-01-01", "and this is another test toto", "bla"),
        ("3", "b", "y", 31, "2018-01-01", "Toto je testovací článek", "more bla"),
    ]
    df = spark.createDataFrame(rows, "_id string, cat string, subcat string, i bigint, date string, text string, title string")
    df = df.withColumn("date", F.col("date").cast("timestamp_ntz"))
    kinds = {"cat": "keyword", "subcat": "keyword", "i": "integer", "date": "date", "text": "text", "title": "text"}
    return declare(df, kinds)


@pytest.fixture(scope="session")
def many(spark):
    """Twenty numbered documents, odd and even."""
    rows = [(str(i), i, abs(10 - i), "odd" if i % 2 else "even") for i in range(20)]
    df = spark.createDataFrame(rows, "_id string, id bigint, pagenr bigint, text string")
    return declare(df, {"id": "integer", "pagenr": "integer", "text": "text"})
