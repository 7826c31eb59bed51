from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_samples import SF

from docsieve.llm.queries import QUERIES
from docsieve.llm.runs import find_runs, lyndon_groups, repeating_stretches, runs_of, with_periodic_tails

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(text):
    """Length of the longest Lyndon word at each place, and the word."""
    found = []
    for i in range(len(text)):
        best = 1
        for j in range(i + 1, len(text) + 1):
            word = text[i:j]
            if all(word < word[k:] for k in range(1, len(word))):
                best = j - i
        found.append(best)
    return found


def plain_runs(text, periods=4, least=6):
    """All periods, longest stretches of equal letters at that distance, smallest period first."""
    n, found = len(text), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if text[i] != text[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and text[j] == text[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, periods * q):
                found.setdefault((i, length), q)
            i = j + 1
    # A stretch with a smaller period lies in that period's run as a whole.
    kept = [(s, m, q) for (s, m), q in found.items()]
    kept = [
        (s, m, q) for s, m, q in kept if not any(a <= s and s + m <= a + b and q % c == 0 and c < q for a, b, c in kept)
    ]
    return sorted(kept, key=lambda r: (r[0], r[2]))


def texts_to_try(dice, count=300):
    for _ in range(count):
        letters = dice.choice([1, 2, 3, 5])
        text = [dice.randrange(letters) for _ in range(dice.randrange(1, 40))]
        if dice.random() < 0.5:
            text = text[: dice.randrange(1, 8)] * dice.randrange(2, 8) + text
        yield text


def test_lyndon_words(dice):
    for text in texts_to_try(dice):
        size, group = lyndon_groups(text)
        assert size.tolist() == plain_lyndon(text)
        words = {}
        for i, g in enumerate(group.tolist()):
            assert words.setdefault(g, text[i : i + size[i]]) == text[i : i + size[i]]
        assert len(set(map(tuple, words.values()))) == len(words)


@pytest.mark.parametrize(("periods", "least"), [(4, 6), (2, 2), (3, 4), (5, 3)])
def test_runs(dice, periods, least):
    for text in texts_to_try(dice):
        assert runs_of(text, periods, least) == plain_runs(text, periods, least), text


@pytest.mark.parametrize(("periods", "least"), [(4, 6), (2, 2), (3, 4), (4, 2)])
def test_stretches_hold_all_runs(dice, periods, least):
    texts = list(texts_to_try(dice, 100))
    flat = np.array([x for t in texts for x in t], np.int64)
    hashes = np.array([hash(str(x)) for x in flat.tolist()], np.int64).view(np.uint64)
    stretches = repeating_stretches(hashes, np.array([len(t) for t in texts]), periods, least)
    at = 0
    for text in texts:
        for start, length, _ in plain_runs(text, periods, least):
            assert any(a <= at + start and at + start + length <= b for a, b in stretches)
        at += len(text)
    # What has no repeats is not looked at again.
    assert repeating_stretches(np.arange(100, dtype=np.uint64), np.array([60, 40]), periods, least) == []


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    written = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(written), digest(rest))


def test_query(spark, texts):
    found = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()]
    assert sorted(found) == sorted(plain_row(k, t) for k, t in texts.items())
    assert any(r[1] for r in found) and not all(r[1] for r in found)


def test_odd(spark, odd):
    rows = odd.collect()
    found = find_runs(with_periodic_tails(odd)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:8] for r in found), key=key) == sorted((plain_row(r["doc_id"], r["text"]) for r in rows), key=key)
    words = next(r for r in found if r["length"] == 3000)
    assert words["period"] == 1 and words["collapsed"] == "word" and words["exponent_milli"] == 3_000_000
    assert [tuple(r) for r in words["runs"]] == [(0, 3000, 1)]
    empty = find_runs(odd.limit(0))
    assert empty.count() == 0 and empty.columns == find_runs(odd).columns


def test_long_text(spark):
    """One long text: a period of 1,000 words in the middle of 60,000 that differ."""
    words = [f"w{i}" for i in range(30_000)]
    words += [f"p{i % 1000}" for i in range(5_500)] + [f"v{i}" for i in range(30_000)]
    (row,) = find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")).collect()
    assert (row["start"], row["length"], row["period"]) == (30_000, 5_500, 1000)
    assert len(row["collapsed"].split()) == 61_000


def test_ties(spark):
    """Of runs with equally many periods the first counts."""
    text = "a b " * 4 + "x " + "c d e " * 4 + "y " + "f g " * 4
    (row,) = find_runs(spark.createDataFrame([(None, text)], "doc_id int, text string")).collect()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (3, 0, 8, 2)
    assert row["collapsed"] == "a b x c d e y f g"
