from __future__ import annotations

import itertools

import pytest
import xxhash

from docsieve.llm import simhash
from docsieve.llm.simhash import components, covering_masks, fingerprint, keep_first, links, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text: str) -> int:
    words = [w for w in text.translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """Smallest value that can be reached, by comparing all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= radius:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {v: top(v) for v in values}


def expected(rows, radius=2):
    """rows: (doc_id, text); per row its fingerprint and the smallest id of its group."""
    prints = [plain_print(t) for _, t in rows]
    root = groups(prints, radius)
    ids = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            ids[root[p]] = min(key, ids.get(root[p], key))
    return sorted((key is not None, key or 0, f"{p:016x}", ids.get(root[p]) or 0) for (key, _), p in zip(rows, prints))


def results(df, **how):
    rows = near_duplicates(df, **how).collect()
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in rows)


def test_fingerprint(texts):
    for text in [*list(texts.values())[:40], "", " ", "A", "a B", "A b C", "É È e f", "x y z w q"]:
        assert fingerprint(text.encode()) == plain_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_every_pair(radius, dice):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differing = sum(1 << b for b in dice.sample(range(64), radius))
        assert any(not differing & m for m in masks)


def near_values(dice, count):
    out = set()
    for _ in range(count // 8):
        value = dice.getrandbits(64)
        for _ in range(8):
            out.add(value)
            value ^= 1 << dice.randrange(64) ^ (1 << dice.randrange(64) if dice.random() < 0.5 else 0)
    return [v - (1 << 64) if v >> 63 else v for v in out]


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("most", [512, 1])
def test_links(spark, dice, radius, most, monkeypatch):
    """Also with every bucket too large for pairs."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", most)
    values = near_values(dice, 240)
    df = spark.createDataFrame([(v,) for v in values], "print bigint")
    found = {r["node"]: r["root"] for r in components(links(df, radius)).collect()}
    wanted = {v: r for v, r in groups(values, radius).items()}
    assert {v: found.get(v, v) for v in values} == wanted


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r["root"] for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).collect() == []


def test_query(documents, texts):
    assert results(documents) == expected(list(texts.items()))


def test_odd(odd):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert results(odd) == expected(rows)
    assert results(odd.limit(0)) == []
    kept = keep_first(odd)
    assert kept.dtypes == odd.dtypes
    # One row per group, also where rows are equal in id and text.
    assert kept.count() == len(set(groups([plain_print(t) for _, t in rows], 2).values()))


def test_radius_zero(documents, texts):
    assert results(documents, radius=0) == expected(list(texts.items()), 0)
