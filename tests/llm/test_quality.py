from __future__ import annotations

import re

from docsieve.llm.quality import keep_good, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str) -> tuple:
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(again),
        len(words) < 50 or 100 * len(again) > 50 * len(words),
    )


def test_counts(odd, dice):
    made = [
        "".join(dice.choices(["a ", "b ", "c\n", "the ", "# ", "|", "é\t", "\n\n", "🙂 ", "\x0b", " ", " "], k=dice.randrange(200)))
        for _ in range(60)
    ]
    spark = odd.sparkSession
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    df = df.union(odd.where("text != repeat('word ', 3000)").selectExpr("doc_id", "text")).union(
        spark.createDataFrame([(None, "word " * 400)], df.schema)
    )
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = sorted(tuple(r[c] for c in columns) for r in quality_rules(df).collect())
    assert found == sorted(plain(r["text"] or "") for r in df.collect())


def test_labels(spark, documents):
    """All clean documents of fifty words are kept, those labelled bad are not."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert len(rows) > 200 and any(r["quality"] == 0 for r in rows)
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)


def test_rows_keep_their_columns(odd, documents):
    kept = keep_good(documents)
    assert kept.dtypes == documents.dtypes
    assert kept.count() == quality_rules(documents).where("kept").count()
    assert keep_good(odd).dtypes == odd.dtypes
    assert quality_rules(odd.limit(0)).collect() == []
    assert {r["kept"] for r in quality_rules(odd).collect()} == {False}
