from __future__ import annotations

import hashlib

import pytest

from docsieve.llm.fuzzy import LETTERS, Powers, edit_distances, fingerprint, likeness, piecewise_hashes


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def expected(rows: list[tuple]) -> list[tuple]:
    """rows: (doc_id, text), in the order that counts."""
    powers, out = Powers(), []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, next_ = (fingerprint(t.encode(), powers) for t in (text, edited, following))
        near = likeness([own, own], [other, next_]).tolist()
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, *near))
    return out


def test_distances(dice):
    some = ["".join(dice.choices(LETTERS[: dice.choice([2, 5, 64])], k=dice.choice([0, 1, 7, 33, 64]))) for _ in range(600)]
    left, right = some[:300], some[300:]
    assert edit_distances(left, right).tolist() == [plain_distance(a, b) for a, b in zip(left, right)]
    assert edit_distances([], []).tolist() == []


def test_fingerprint(dice, texts):
    powers = Powers()
    for text in [*list(texts.values())[:50], "a", "ab" * 3000, "x" * 100_000, "é"]:
        size, one, two = fingerprint(text.encode(), powers).split(":")
        assert int(size).bit_count() == 1 and 1 <= len(one) <= 64 and 1 <= len(two) <= len(one)
    assert fingerprint(b"", powers) == "1::"
    # One changed byte in the middle changes few letters.
    text = bytes(dice.randrange(32, 127) for _ in range(4000))
    changed = text[:2000] + b"!" + text[2001:]
    assert likeness([fingerprint(text, powers)], [fingerprint(changed, powers)])[0] > 0.85
    other = bytes(dice.randrange(32, 127) for _ in range(4000))
    assert likeness([fingerprint(text, powers)], [fingerprint(other, powers)])[0] < 0.3


def test_likeness():
    assert likeness(["4:abcd:ab", "1::", "1::"], ["4:abcd:ab", "1::", "1:a:a"]).tolist() == [1, 1, 0]
    # Doubled sizes: the wider letters of one against the narrow ones of the other.
    assert likeness(["4:xxxx:abcd", "4:abcd:x"], ["8:abcd:zz", "2:zz:abcd"]).tolist() == [1, 1]
    assert likeness(["4:abcd:ab"], ["16:abcd:ab"]).tolist() == [0]


def test_query(documents, texts):
    found = sorted(tuple(r) for r in piecewise_hashes(documents).collect())
    wanted = sorted(expected(sorted(texts.items())))
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert [f[5:] for f in found] == [pytest.approx(w[5:]) for w in wanted]
    # Half of a text is still its own.
    long = [f for f in found if f[1] > 500]
    assert sum(f[5] > 0.3 for f in long) > 0.9 * len(long)


@pytest.mark.parametrize("parts", ["1", "5"])
def test_odd(spark, odd, parts):
    """Null ids first; rows with one id follow each other in some order, so only those with ids of their own are compared."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = piecewise_hashes(odd).collect()
        alone = odd.where("doc_id between 5 and 11").collect()
        assert len(rows) == odd.count()
        wanted = {w[0]: w for w in expected([(r["doc_id"], r["text"] or "") for r in alone])[:-1]}
        found = {r["doc_id"]: tuple(r) for r in rows}
        assert all(found[k][:6] == w[:6] for k, w in wanted.items())
        assert piecewise_hashes(odd.limit(0)).collect() == []
        only = piecewise_hashes(odd.where("doc_id = 9")).collect()
        assert [r["near_next"] for r in only] == [1]
        by_name = odd.selectExpr("'k' || doc_id AS doc_id", "text")
        assert piecewise_hashes(by_name).count() == odd.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
