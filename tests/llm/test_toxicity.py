from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm.toxicity import (
    HIDDEN,
    WINDOW,
    Scorer,
    Training,
    Words,
    _Table,
    _back_side,
    _run_side,
    features,
    held_out,
    learn,
    new_model,
    score_toxicity,
    train,
    windows_of,
)

SMALL = Training(rows=300, windows=2000, steps=10)


def test_windows_overlap_and_cover():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000, 1001):
        found = windows_of(n)
        assert sorted({i for a, b in found for i in range(a, b)}) == list(range(n))
        assert all(b - a == min(n, WINDOW) for a, b in found)
        assert all(y[0] < x[1] for x, y in zip(found, found[1:]))


def test_a_passage_lies_whole_in_a_window():
    """Wherever a passage of 33 words begins in a text, one window holds all of it."""
    for n in (33, 48, 49, 300):
        for start in range(n - 32):
            assert any(a <= start and start + 33 <= b for a, b in windows_of(n)), (n, start)


def test_features():
    buckets, grams, sizes = features(["", "a", "abc", "abc"])
    assert sizes.tolist() == [0, 1, 6, 6]
    assert buckets[2] == buckets[3] and grams[1:7].tolist() == grams[7:].tolist()


def test_gradient_of_one_direction():
    dice = np.random.default_rng(0)
    inputs = dice.standard_normal((5, 3, 3 * HIDDEN)).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    weights = (dice.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.3).astype(np.float32)
    toward = dice.standard_normal((5, 3, HIDDEN)).astype(np.float32)
    _, saved = _run_side(inputs, mask, weights, True)
    of_inputs, of_weights = _back_side(toward, mask, weights, saved)

    def value(x, w):
        return float((_run_side(x.astype(np.float64), mask, w.astype(np.float64), False)[0].astype(np.float64) * toward).sum())

    for at in [(0, 0, 0), (1, 1, HIDDEN), (2, 0, 2 * HIDDEN + 1), (4, 0, 5), (3, 2, 4)]:
        step = np.zeros_like(inputs)
        step[at] = 1e-2
        assert (value(inputs + step, weights) - value(inputs - step, weights)) / 2e-2 == pytest.approx(of_inputs[at], abs=2e-2)
    for at in [(0, 0), (3, HIDDEN + 2), (5, 2 * HIDDEN + 3)]:
        step = np.zeros_like(weights)
        step[at] = 1e-2
        assert (value(inputs, weights + step) - value(inputs, weights - step)) / 2e-2 == pytest.approx(of_weights[at], abs=2e-2)


def test_scores_do_not_depend_on_the_batch():
    scorer = Scorer(new_model(1))
    texts = ["one two three", "", "x " * 500, "你好 " * 3, "a" * 5000]
    together = scorer.scores(texts)
    alone = [scorer.scores([t])[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-6)
    assert together[1] == 0
    known, table = Words(), _Table(new_model(1))
    known.look_up(["a", "b", "a"])
    table.add(*features(known.take()))
    assert table.size == 3 and known.take() == []


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = score_toxicity(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1
    unseen = [r for r in rows if r["held_out"]]
    toxic, clean = [r for r in unseen if r["toxic"]], [r for r in unseen if not r["toxic"]]
    assert len(toxic) > 100
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


def test_held_out_rows_are_not_learned_from(tables):
    docs, labels = tables
    docs, labels = docs.limit(300).cache(), labels
    first = learn(docs, labels, "doc_id", "text", "toxic", Training(rows=60, windows=500, steps=5))
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    second = learn(docs, turned, "doc_id", "text", "toxic", Training(rows=60, windows=500, steps=5))
    assert all((first[k] == second[k]).all() for k in first)


def test_odd(odd, spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, 0), (None, 1), (5, None), (7, 2)], "doc_id bigint, toxic int")
    rows = score_toxicity(odd, labels, how=SMALL).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {0.0}
    assert score_toxicity(odd.limit(0), labels, how=SMALL).collect() == []
    assert len(score_toxicity(odd, labels.limit(0), how=SMALL).collect()) == odd.count()
    assert train([], [], SMALL).keys() == new_model(1).keys()
