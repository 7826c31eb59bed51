"""The registered queries: names, columns, types, and SQL where there is one."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as driver
from docsieve.llm.queries import QUERIES, SQL

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

COLUMNS = {
    1: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    2: {
        "conv_id": "bigint",
        "n_turns": "bigint",
        "turns_sha256": "string",
        "loss_chars": "bigint",
        "loss_sha256": "string",
        "formatted_chars": "bigint",
    },
    3: {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    4: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    5: {
        "doc_id": "bigint",
        "n_chars": "bigint",
        "edited_sha256": "string",
        "fingerprint": "string",
        "edited_fingerprint": "string",
        "near_edited": "double",
        "near_next": "double",
    },
    6: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    7: {
        "doc_id": "bigint",
        "n_words": "bigint",
        "word_chars": "bigint",
        "n_symbols": "bigint",
        "n_dup_lines": "bigint",
        "n_repeat_words": "bigint",
        "base_failed": "boolean",
        "kept": "boolean",
    },
    8: {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    9: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    10: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    11: {
        "doc_id": "bigint",
        "piece": "int",
        "start": "bigint",
        "length": "bigint",
        "ids_crc32": "bigint",
        "sequence_id": "bigint",
        "offset": "bigint",
    },
    12: {
        "vec_id": "bigint",
        "component": "int",
        "n": "bigint",
        "deviation": "bigint",
        "whitened": "double",
        "explained": "double",
        "identity_error": "double",
    },
    13: {
        "doc_id": "bigint",
        "n_runs": "bigint",
        "start": "bigint",
        "length": "bigint",
        "period": "bigint",
        "exponent_milli": "bigint",
        "runs_sha256": "string",
        "collapsed_sha256": "string",
    },
}


def number(name: str) -> int:
    return int(name[2:].split("_")[0])


def test_all_are_registered():
    assert sorted(map(number, QUERIES)) == list(range(1, 14))
    assert QUERIES.items() <= driver.queries().items()
    assert "pipeline" in driver.queries()
    assert SQL.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    found = dict(QUERIES[name](spark, SF).dtypes)
    assert COLUMNS[number(name)].items() <= found.items()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert oracle.compare(name, QUERIES[name](spark, SF), oracle.connect(SF), SQL[name]) is None


@pytest.mark.parametrize("name", ["op3_url_filters", "op7_quality_rules"])
def test_native(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
