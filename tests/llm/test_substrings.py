from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from docsieve.llm import substrings
from docsieve.llm.fuzzy import Powers
from docsieve.llm.substrings import anchors, joined_spans, remove_repeats, repeated_starts, suffix_array, without_repeats


def plain_starts(text: bytes, length: int) -> list[int]:
    seen = defaultdict(list)
    for i in range(len(text) - length + 1):
        if b"\0" not in text[i : i + length]:
            seen[text[i : i + length]].append(i)
    return sorted(i for at in seen.values() if len(at) > 1 for i in at)


def plain_removal(texts: list[bytes], length: int) -> list[tuple]:
    seen = defaultdict(list)
    for t, text in enumerate(texts):
        for i in range(len(text) - length + 1):
            seen[hash(text[i : i + length])].append((t, i))
    covered = [np.zeros(len(t) + 1, bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for t, i in at:
                covered[t][i : i + length] = True
    out = []
    for text, gone in zip(texts, covered):
        rest = bytes(b for b, g in zip(text, gone) if not g)
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(text) else 0
        out.append((len(text), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def made_texts(dice, letters=3):
    base = bytes(dice.randrange(1, letters + 1) for _ in range(dice.randrange(5, 120)))
    parts = []
    for _ in range(dice.randrange(1, 8)):
        part = bytearray(base[dice.randrange(len(base)) :])
        if dice.random() < 0.5:
            part[dice.randrange(len(part))] = dice.randrange(1, letters + 1)
        if dice.random() < 0.3:
            part = bytearray(dice.randrange(1, letters + 1) for _ in range(dice.randrange(80)))
        parts.append(bytes(part))
    return parts


def test_suffix_array(dice):
    for _ in range(100):
        text = b"\0".join(made_texts(dice)) + b"\0"
        order = suffix_array(np.frombuffer(text, np.uint8), 1 << 12).tolist()
        assert sorted(order) == list(range(len(text)))
        assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_starts(dice):
    for _ in range(300):
        length, letters = dice.choice([8, 9, 12, 17, 33]), dice.choice([1, 2, 3, 5, 40])
        text = b"\0".join(made_texts(dice, letters)) + b"\0"
        assert repeated_starts(np.frombuffer(text, np.uint8), length).tolist() == plain_starts(text, length)


def test_anchors_split_all_windows(dice):
    powers = Powers()
    for _ in range(200):
        length, width = dice.choice([(12, 8), (20, 8), (20, 20), (16, 9)])
        text = bytes(dice.randrange(1, 3) for _ in range(dice.randrange(length, 150)))
        anchor, context, first, last = anchors(np.frombuffer(text, np.uint8), length, width, powers)
        assert first[0] == 0 and last[-1] == len(text) - length and (first[1:] == last[:-1] + 1).all()
        by_window = {}
        for a, f, e in zip(anchor.tolist(), first.tolist(), last.tolist()):
            for i in range(f, e + 1):
                # Equal windows have equal anchors.
                assert by_window.setdefault(text[i : i + length], a) == a


def test_joined_spans():
    a, b = joined_spans(np.array([5, 0, 9, 2, 30]), np.array([9, 3, 12, 4, 31]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 4), (5, 12), (30, 31)]


def results(df, **how):
    return sorted(tuple(r) for r in remove_repeats(df, kept=False, **how).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("most", [1024, 3])
def test_query(documents, texts, most, monkeypatch):
    """Against all strings of 400 bytes in a dictionary; also with nearly all groups counted window by window."""
    monkeypatch.setattr(substrings, "GROUP_MOST", most)
    assert results(documents) == sorted(plain_removal([t.encode() for t in texts.values()], 400))


@pytest.mark.parametrize("most", [1024, 1])
def test_passages(spark, dice, most, monkeypatch):
    """Passages shared by many texts, some just too short, overlapping, at the ends, and within one text."""
    monkeypatch.setattr(substrings, "GROUP_MOST", most)
    word = lambda n: "".join(dice.choices("abcdé \n", k=n))
    passages = [word(n) for n in (11, 12, 13, 20, 40, 90)] + ["x" * 200, "xy" * 60]
    rows = [word(dice.randrange(30)).join(dice.choices(passages, k=dice.randrange(1, 5))) + word(9) for _ in range(150)]
    rows += ["", None, "short", "x" * 14, "x" * 15]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    for length, width in ((14, 8), (14, 14), (30, 15)):
        wanted = sorted(plain_removal([(t or "").encode() for t in rows], length))
        assert results(df, length=length, width=width) == wanted


def test_odd(odd):
    texts = [(r["text"] or "").encode() for r in odd.collect()]
    assert results(odd) == sorted(plain_removal(texts, 400))
    assert results(odd.limit(0)) == []
    kept = without_repeats(odd, chars="n_chars")
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes and kept.count() == odd.count()


def test_cut_characters_are_left_out(spark):
    same = "é" * 30
    rows = [(1, "a" + same), (2, "bb" + same[:-1] + "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # 21 bytes cover halves of characters at the ends.
    found = {r["doc_id"]: r for r in without_repeats(df, length=21, width=10).collect()}
    assert found[1]["text"] in ("a", "aé") and found[2]["text"].startswith("bb")
