from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece

from docsieve.llm.pieces import Pieces, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture()
def pieces():
    return Pieces(open(MODEL, "rb").read())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_like_the_library(pieces, library, dice, texts):
    letters = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "é", "ß", "你", "🙂", "\x00", "<s>", "ing", ".", "\u0301"]
    made = ["".join(dice.choices(letters, k=dice.randrange(40))) for _ in range(3000)]
    for text in [*made, *list(texts.values())[:60], "a" * 3000, "▁" * 500, " " * 333]:
        assert pieces.encode(text) == library.encode(text), text


def test_whole_text_like_stretch_by_stretch(pieces, texts):
    for text in list(texts.values())[:10]:
        assert pieces.stretch_ids(pieces.library.normalize(text[:2000])) == pieces.encode(text[:2000])


def test_both_agendas_merge_alike(pieces, dice, monkeypatch):
    words = ["".join(dice.choices("aeinorst▁.,é\nß你", k=dice.randrange(60))) for _ in range(500)]
    monkeypatch.setattr("docsieve.llm.pieces.LIST_AGENDA", 100)
    listed = [pieces.symbols(word) for word in words]
    monkeypatch.setattr("docsieve.llm.pieces.LIST_AGENDA", 0)
    assert [pieces.symbols(word) for word in words] == listed


def test_no_piece_reaches_past_a_stretch(pieces):
    for piece in pieces.ids:
        assert pieces.stretch.findall(piece) == [piece]
    assert pieces.stretch.findall("▁▁the.\nIt▁7é") == ["▁▁the", ".", "\n", "It", "▁", "7", "é"]


def test_a_full_memory_forgets_in_halves(pieces, library, texts, monkeypatch):
    monkeypatch.setattr("docsieve.llm.pieces.MEMO_BYTES", 4000)
    for text in texts.values():
        assert pieces.encode(text) == library.encode(text)
    assert pieces.memo.old


def test_agenda_takes_the_best_pair_first(pieces):
    # "he" scores better than "th", so "the" is first "t" and "he".
    assert pieces.scores["he"] > pieces.scores["th"]
    pieces.rank.pop("the", None)
    assert pieces.symbols("the") == ["t", "he"]
    assert pieces.symbols("") == []


def test_query(documents, texts, library):
    rows = encode_pieces(documents, MODEL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), library.decode(ids))
        assert r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids))


def test_odd(odd, library):
    rows = encode_pieces(odd, MODEL).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted(r["ids"] for r in rows) == sorted(library.encode(t, add_eos=True) for t in texts)
    assert encode_pieces(odd.limit(0), MODEL, ids=False).collect() == []
