from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docsieve.llm.mixing import _targets, min_cost_flow, mix_sources, mixed_documents


def target_sizes(sizes, weights, total, most=2.0):
    """The plain version of the targets. Share ``total`` by weight; a share stops at ``most`` times its source's size, the excess is shared again.

    If every source is full, the rest of the total stays unused.
    """
    target, open_ = {}, {s for s in sizes if weights[s] > 0}
    left = float(total)
    while open_:
        by_weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / by_weight for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in sorted(full, key=str))
        open_ -= full
    return {s: target.get(s, 0.0) for s in sizes}


def test_targets():
    sizes = {"a": 100, "b": 1000, "c": 1000}
    target = target_sizes(sizes, {"a": 3, "b": 1, "c": 2}, 3150)
    assert target["a"] == 200 and target["c"] == pytest.approx(2 * 2950 / 3) and target["b"] == pytest.approx(2950 / 3)
    assert target_sizes({"a": 10}, {"a": 3}, 1000) == {"a": 20}
    assert target_sizes({}, {}, 0) == {}
    assert target_sizes({"a": 0, "b": 10}, {"a": 3, "b": 1}, 15) == {"a": 0, "b": 15}


def cost_of(capacity, flow):
    """A pattern's first words cost nothing, its second uses one each."""
    cost = 0
    for p, words in enumerate(capacity):
        used = sum(f for (q, _), f in flow.items() if q == p)
        assert used <= 2 * words
        cost += max(0, used - words)
    return cost


def test_flow_against_all_assignments():
    dice = random.Random(3)
    for _ in range(60):
        patterns, sources = dice.randrange(1, 4), dice.randrange(1, 3)
        capacity = [dice.randrange(0, 4) for _ in range(patterns)]
        members = [[s for s in range(sources) if dice.random() < 0.7] for _ in range(patterns)]
        quota = [dice.randrange(0, 6) for _ in range(sources)]
        flow = min_cost_flow(capacity, members, quota)
        assert all(s in members[p] for p, s in flow)
        assert all(sum(f for (_, t), f in flow.items() if t == s) <= quota[s] for s in range(sources))
        links = [(p, s) for p in range(patterns) for s in members[p]]
        best = (0, 0)
        for amounts in itertools.product(range(7), repeat=len(links)):
            some = dict(zip(links, amounts))
            if any(sum(f for (q, _), f in some.items() if q == p) > 2 * capacity[p] for p in range(patterns)):
                continue
            if any(sum(f for (_, t), f in some.items() if t == s) > quota[s] for s in range(sources)):
                continue
            best = max(best, (sum(amounts), -cost_of(capacity, some)))
        assert (sum(flow.values()), -cost_of(capacity, flow)) == best


def check(df, rows):
    plain = {}
    for r in df.collect():
        size = len([w for w in (r["text"] or "").replace("\n", " ").split(" ") if w])
        plain.setdefault(r["source"], []).append(size)
    order = sorted(plain, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(plain[s]) for s in order}
    wanted = target_sizes(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(order, 0)
    for r in rows:
        (source,) = r["sources"]
        taken[source] += r["taken"]
        assert r["source_sizes"] == [sizes[source]] and r["targets"] == [pytest.approx(wanted[source])]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for s in order:
        # Whole documents: no further off than half of the largest.
        assert abs(taken[s] - wanted[s]) <= max(plain[s]) / 2 + 1, s


def test_query(documents):
    rows = mix_sources(documents).collect()
    assert len(rows) == documents.count()
    check(documents, rows)
    again = mix_sources(documents.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    other = mix_sources(documents, seed=1).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) != sorted((r["doc_id"], r["taken"]) for r in other)
    mixed = mixed_documents(documents)
    assert mixed.dtypes == documents.dtypes
    assert mixed.count() == sum(r["times"] for r in rows)


def test_overlapping_sources(spark):
    """Documents of both sources serve the one that lacks words; nothing is used twice while unused words are left."""
    rows = [(i, "w " * 10, ["a", "b"] if i < 300 else ["a"] if i < 320 else ["b"]) for i in range(620)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")
    found = mix_sources(df, weights=(1, 1), share=1.0).collect()
    assert {r["times"] for r in found} == {1}
    less = mix_sources(df, weights=(1, 1), share=0.9).collect()
    assert abs(sum(r["taken"] for r in less) - 0.9 * 6200) <= 60
    assert {r["times"] for r in less} == {0, 1}


def test_odd(odd, spark):
    found = mix_sources(odd).collect()
    assert len(found) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in found)
    assert mixed_documents(odd).dtypes == odd.dtypes
    assert mix_sources(odd.limit(0)).collect() == []
    empty = odd.select("doc_id", F.lit("").alias("text"), "source")
    assert {r["taken"] for r in mix_sources(empty).collect()} == {0}
    none = spark.createDataFrame([(1, "a b", None), (2, "c d", [])], "doc_id int, text string, source array<string>")
    assert {r["taken"] for r in mix_sources(none).collect()} == {0}


def test_targets_of_a_table(spark):
    """Against the plain version, with sources that fill up in several rounds."""
    dice = random.Random(5)
    for sizes in ([], [0, 0], [10], [1, 10, 100, 1000, 10000, 100000], [dice.randrange(0, 5000) for _ in range(200)]):
        for weights in ((3, 1, 2), (1, 0)):
            rows = spark.createDataFrame([(i + 1, n) for i, n in enumerate(sizes)], "_place bigint, _source_size bigint")
            found = {r["_place"] - 1: r["_target"] for r in _targets(rows, weights, 1.5 * sum(sizes), 2.0).collect()}
            plain = target_sizes(dict(enumerate(sizes)), {i: weights[i % len(weights)] for i in range(len(sizes))}, 1.5 * sum(sizes))
            assert found == pytest.approx(plain)


def test_flow_of_many_patterns():
    """A flow of 20,000 patterns is a matter of seconds; quotas are met and nothing is used twice without need."""
    dice = random.Random(1)
    members = [dice.sample(range(500), 2) for _ in range(20_000)]
    capacity = [dice.randrange(1, 100) for _ in members]
    quota = [sum(capacity) // 500] * 500
    flow = min_cost_flow(capacity, members, quota)
    assert sum(flow.values()) == sum(quota) and cost_of(capacity, flow) == 0


def test_100_000_sources(spark):
    """Each document has a source of its own, but for some that two share; no number of patterns is refused."""
    one = F.array(F.concat(F.lit("s"), F.col("id").cast("string")))
    two = F.array_append(one, F.concat(F.lit("s"), (F.col("id") + 1).cast("string")))
    text = F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int"))
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 100 == 0, two).otherwise(one).alias("source"))
    rows = mix_sources(df).collect()
    assert len(rows) == 100_000
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        # A document that is alone in its source comes as near to the target as whole documents can.
        if r["doc_id"] % 100 > 1:
            assert r["source_sizes"] == [r["size"]] and abs(r["taken"] - r["targets"][0]) <= r["size"] / 2 + 1
