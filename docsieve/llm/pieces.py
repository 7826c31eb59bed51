"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs, checked against the library."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from docsieve.llm.shared import arrow_map, remembered, slices, text_of

SPACE_MARK = "▁"
# Short stretches of text are remembered with their ids: twice so many bytes at most, no stretch longer than the second
# number. An entry takes so many bytes besides its characters and ids.
MEMO_BYTES = 75_000_000
MEMO_LENGTH = 64
MEMO_ENTRY = 160
# An agenda of so many pairs or fewer is a list searched for its best pair, a longer one a heap. Both merge alike.
LIST_AGENDA = 48
NEVER = 1 << 60


class _Memo(dict):
    """Remembers the ids of stretches, as bytes; those of very long ones are made anew each time.

    Full, it becomes the old half; what is looked up there moves over, and the rest goes when the new half is full.
    """

    def __init__(self, make: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, stretch: str) -> bytes:
        ids = self.old.get(stretch)
        if ids is None:
            ids = array("i", self.make(stretch)).tobytes()
        if len(stretch) <= MEMO_LENGTH:
            self[stretch] = ids
            self.bytes += MEMO_ENTRY + len(stretch) + len(ids)
        return ids

    def turn(self) -> None:
        """Start a new half if this one is full."""
        if self.bytes > MEMO_BYTES:
            self.old = dict(self)
            self.clear()
            self.bytes = 0


def _stretches(pieces: Iterable[str]) -> re.Pattern:
    """Cuts a text where no piece has the characters on both sides next to each other, so that no merge can cross.

    Characters that pieces join, directly or through others, are one class; the space mark belongs to what follows it
    where no piece has it after another character. A stretch is a run of one class; a character in no class stands alone.
    """
    joined = {both for piece in pieces for both in zip(piece, piece[1:])}
    if any(b == SPACE_MARK != a for a, b in joined):
        return re.compile("(?s).+")
    leader: dict[str, str] = {}

    def find(char: str) -> str:
        while leader.setdefault(char, char) != char:
            char = leader[char]
        return char

    for a, b in joined:
        if a != SPACE_MARK:
            leader[find(a)] = find(b)
        else:
            find(b)
    leader.pop(SPACE_MARK, None)
    classes: dict[str, list[str]] = {}
    for char in leader:
        classes.setdefault(find(char), []).append(char)
    runs = [f"{SPACE_MARK}*[{re.escape(''.join(sorted(c)))}]+" for c in sorted(classes.values(), key=len, reverse=True)]
    return re.compile("(?s)" + "|".join([*runs, f"{SPACE_MARK}+", "."]))


class Pieces:
    """Encoder for merge-type vocabularies (``piece_bpe``) with byte fallback, from the bytes of a model file."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, n = self.library, self.library.get_piece_size()
        self.end = sp.eos_id()
        kept = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in kept):
            raise ValueError("a vocabulary with unused pieces cannot be read")
        self.ids = {sp.id_to_piece(i): i for i in kept}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in kept}
        ranked = {score: place for place, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {piece: ranked[score] for piece, score in self.scores.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.decimal = [str(i) for i in range(n)]
        self.stretch = _stretches(self.ids)
        self.memo = _Memo(self.stretch_ids)

    def symbols(self, text: str) -> list[str]:
        """Merge adjacent symbols, best score first and leftmost among equals, until no pair is a piece."""
        parts: list[str] = list(text)
        size = len(parts)
        if size <= LIST_AGENDA:
            return self._short_symbols(parts)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        # An entry is the pair's rank times the size, plus the left symbol's place: one number orders by both.
        rank, agenda, pairs = self.rank, [], {}
        for i in range(size - 1):
            both = parts[i] + parts[i + 1]
            if both in rank:
                entry = rank[both] * size + i
                agenda.append(entry)
                pairs[entry] = both
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry % size
            a, right = parts[left], after[left]
            # A pair is stale if one of its symbols has been merged meanwhile.
            if not a or right >= size or a + parts[right] != pairs[entry]:
                continue
            merged = parts[left] = pairs[entry]
            parts[right] = ""
            nxt = after[left] = after[right]
            if nxt < size:
                before[nxt] = left
                both = merged + parts[nxt]
                if both in rank:
                    entry = rank[both] * size + left
                    pairs[entry] = both
                    heapq.heappush(agenda, entry)
            prev = before[left]
            if prev >= 0:
                both = parts[prev] + merged
                if both in rank:
                    entry = rank[both] * size + prev
                    pairs[entry] = both
                    heapq.heappush(agenda, entry)
        return [p for p in parts if p]

    def _short_symbols(self, parts: list[str]) -> list[str]:
        rank = self.rank.get
        agenda = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            left = agenda.index(best)
            merged = parts[left] = parts[left] + parts.pop(left + 1)
            del agenda[left]
            if left:
                agenda[left - 1] = rank(parts[left - 1] + merged, NEVER)
            if left < len(agenda):
                agenda[left] = rank(merged + parts[left + 1], NEVER)
        return parts

    def stretch_ids(self, stretch: str) -> list[int]:
        out: list[int] = []
        for symbol in self.symbols(stretch):
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without an end id."""
        self.memo.turn()
        found = self.stretch.findall(self.library.normalize(text))
        return array("i", b"".join(map(self.memo.__getitem__, found))).tolist()

    def written(self, ids: list[int]) -> str:
        """The decimal ids, joined by a blank."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def pieces_of(model: bytes) -> Pieces:
    """The encoder of a model; the tasks that follow each other in a Python worker share it and its memory of stretches."""
    return remembered("pieces", model, lambda: Pieces(model))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_pieces(
    df: DataFrame, model: str | Path, doc_id: str = "doc_id", text: str = "text", end: bool = True, ids: bool = True
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``model`` is a SentencePiece model file; its bytes (some hundred kilobytes) travel with the tasks. Result, one row
    per input row: ``doc_id``, ``ids`` (if asked for), ``decoded`` (likewise), ``n_tokens``, ``ids_sha256`` over the
    decimal ids joined by a blank, ``decoded_sha256``. Each Arrow batch is also encoded by the library; a text whose ids
    differ stops the job, so a vocabulary of another kind cannot pass unnoticed.

    A null text counts as empty: it has the end id only. Nothing is cut, however long. Rows are judged one by one, so
    repeated rows, null ids, empty tables and other columns (which are not read) need no care.
    """
    proto = Path(model).read_bytes()
    id_type = df.schema[doc_id].dataType.simpleString()
    more = "ids array<int>, decoded string, " if ids else ""
    schema = f"doc_id {id_type}, {more}n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def each():
        pieces = pieces_of(proto)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            found = [pieces.encode(t) for t in texts]
            if found != pieces.library.encode(texts, num_threads=1):
                raise ValueError("ids differ from those of the sentencepiece library")
            if end:
                for one in found:
                    one.append(pieces.end)
            decoded = [pieces.decode(one) for one in found]
            columns = {"doc_id": batch.column(0)}
            if ids:
                columns |= {"ids": pa.array(found, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            columns |= {
                "n_tokens": pa.array([len(one) for one in found], pa.int64()),
                "ids_sha256": pa.array([_digest(pieces.written(one)) for one in found], pa.string()),
                "decoded_sha256": pa.array([_digest(one) for one in decoded], pa.string()),
            }
            return pa.RecordBatch.from_pydict(columns)

        return lambda batch: (work(part) for part in slices(batch, 1))

    return arrow_map(df.select(df[doc_id].alias("doc_id"), text_of(text).alias("text")), schema, each, "pieces")

