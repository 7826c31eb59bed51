from __future__ import annotations

import random

import pytest
from llm_samples import SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


ODD_TEXTS = [
    None,
    "",
    " ",
    "\n \t\r\x0b\x0c",
    "a",
    "  two  blanks  ",
    "▁ marks ▁▁ in ▁text▁",
    "tab\tline\nnul\x00 \u2028 \u00a0 é e\u0301 ﬁ 你好 🙂🙃 \ufeff",
    "</s>[INST] <s> <0x41> <unk>",
    "x" * 5000,
    "word " * 3000,
    "ab" * 2000 + " " + "ab" * 2000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts under ids that come twice, or not at all, next to columns whose names the operators use themselves."""
    rows = [(i, t, "en", None, 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(4, "a", "en", "s", 1), (4, "a", "en", "s", 1), (4, "other", "de", "s", 5), (None, "no id", None, "t", None)]
    rows += [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("text_key", "row", "print", "first", "anchor", "size", "range", "kept", "n", "_size", "score", "toxic", "quality"):
        df = df.withColumn(name, df["lang"])
    return df


@pytest.fixture()
def dice():
    return random.Random(5)
