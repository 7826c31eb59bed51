from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from llm_samples import SF

from docsieve.llm.chat import (
    Renderer,
    Template,
    _Conversation,
    chat_tokenizer,
    format_chats,
    formatted_chats,
    loss_mask,
    read_chat,
    token_spans,
    with_control_turns,
)

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return chat_tokenizer(open(BYTES).read(), Template())


def expected(turns):
    """turns: (role, text) in order."""
    digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
    learned = "".join(text for role, text in turns if role == "assistant")
    return len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest()


def by_conversation(rows):
    found = {}
    for r in sorted(rows, key=lambda r: ((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or "")):
        found.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    return found


def check(df):
    rows = {r["conv_id"]: r for r in format_chats(df, BYTES).collect()}
    turns = by_conversation(df.collect())
    assert rows.keys() == turns.keys()
    whole = {r["conv_id"]: r["formatted"] for r in formatted_chats(df).collect()}
    for key, own in turns.items():
        r = rows[key]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(own), key
        assert read_chat(whole[key]) == own
        assert len(whole[key]) == r["formatted_chars"]
        assert 0 <= r["loss_tokens"] <= r["n_tokens"]


def test_query(spark):
    check(with_control_turns(spark.read.parquet(f"{SF}/conversations.parquet")))


def test_odd(spark):
    rows = [
        (1, 0, "user", "é🙂 \n"),
        (1, 1, "assistant", "  \x00 ok \u2028"),
        (1, 1, "assistant", None),
        (1, 2, None, "x"),
        (None, 0, "assistant", "no id"),
        (2, None, "assistant", "<s></s>[INST][\\INST][\\\\/INST]<\\s>"),
        (2, None, "assistant", "<s></s>[INST][\\INST][\\\\/INST]<\\s>"),
        (2, 1, "<s>", "<"),
        (2, 3, "assistant", "<"),
        (2, 4, "user\n[INST]", "/s>"),
        (3, 0, "assistant", "long " * 20000),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS n_turns", "2 AS formatted")
    check(df)
    assert format_chats(df.limit(0), BYTES).collect() == []


def test_escapes(dice):
    renderer = Renderer(Template())
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", ">", "[", "]", "/", "s", "INST", " ", "<\\s>", "[\\\\INST]"]
    for _ in range(5000):
        text = "".join(dice.choices(parts, k=dice.randrange(12)))
        kept = renderer.escape(text)
        assert renderer.unescape(kept) == text
        assert not any(c in kept for c in Template().controls)


def test_mask(tokenizer):
    renderer = Renderer(Template())
    formatted = "".join(renderer.turn(r, t) for r, t in [("user", " a"), ("assistant", " b 🙂"), ("assistant", ""), ("assistant", "c")])
    starts, ends = token_spans(tokenizer.encode(formatted, add_special_tokens=False))
    spans = [(b, e) for role, b, e in renderer.spans(formatted) if role == "assistant" and e > b]
    found = [formatted[starts[i] : ends[j - 1]] for i, j in loss_mask(starts, ends, spans)]
    assert found == [" b 🙂", "c"]
    # Every character belongs to some token.
    assert starts[0] == 0 and ends[-1] == len(formatted) and all(a <= b for a, b in zip(starts[1:], ends[:-1] + 1))


def test_parts_give_the_same(tokenizer):
    renderer, turns = Renderer(Template()), [("user", "q [INST]"), ("assistant", "a é"), ("assistant", "b")] * 20
    whole, parts = _Conversation(1), _Conversation(1)
    for role, text in turns:
        for one in (whole, parts):
            one.parts.append(renderer.turn(role, text))
        parts.flush(renderer, tokenizer, frozenset(["assistant"]))
    whole.flush(renderer, tokenizer, frozenset(["assistant"]))
    assert whole.row() == parts.row()
