"""Chat formatting: whole conversations rendered, encoded once with offsets, and masked by turn spans."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.shared import text_of

# A longer conversation is encoded in parts that end at a turn's end, where a control string separates tokens anyway.
PART_CHARS = 1_000_000


@dataclass(frozen=True)
class Template:
    """``start`` role ``middle`` text ``end`` for each turn. ``controls`` lists all strings with a meaning.

    Every control string is ``<name>`` or ``[name]``, where the name may begin with ``/``. Inside roles and texts a
    backslash is put behind the opening bracket of a control string, and one more where there are some already; reading
    takes one away. So no text holds a control string, and every text can be read back.
    """

    start: str = "<s>"
    middle: str = "[INST]"
    end: str = "</s>"
    others: tuple[str, ...] = ("[/INST]",)

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.start, self.middle, self.end, *self.others)))

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        names = "|".join(rf"{re.escape(c[0])}(?:\\*){re.escape(c[1:])}" for c in self.controls)
        marked = "|".join(rf"{re.escape(c[0])}(?:\\+){re.escape(c[1:])}" for c in self.controls)
        return re.compile(names), re.compile(marked)


class Renderer:
    def __init__(self, template: Template) -> None:
        self.template = template
        self.plain, self.marked = template.patterns()

    def escape(self, text: str) -> str:
        return self.plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.marked.sub(lambda m: m[0][0] + m[0][2:], text)

    def turn(self, role: str, text: str) -> str:
        t = self.template
        return f"{t.start}{self.escape(role)}{t.middle}{self.escape(text)}{t.end}"

    def spans(self, formatted: str) -> list[tuple[str, int, int]]:
        """(role, begin, end) of every turn's text in a formatted conversation."""
        t, out, at = self.template, [], 0
        while at < len(formatted):
            role = at + len(t.start)
            middle = formatted.index(t.middle, role)
            begin = middle + len(t.middle)
            end = formatted.index(t.end, begin)
            out.append((self.unescape(formatted[role:middle]), begin, end))
            at = end + len(t.end)
        return out


def token_spans(encoding) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
    return offsets[:, 0], offsets[:, 1]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Per span the range of tokens that intersect it, found by binary search in the sorted token spans."""
    begin, end = np.array(spans, np.int64).reshape(-1, 2).T
    first = np.searchsorted(ends, begin, "right")
    last = np.searchsorted(starts, end, "left")
    return list(zip(first.tolist(), last.tolist()))


def chat_tokenizer(spec: str, template: Template):
    """A tokenizer from its JSON text, in which the template's control strings are tokens of their own."""
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.add_special_tokens([AddedToken(c, normalized=False) for c in template.controls])
    # Offsets have to cover every character, blanks too.
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


class _Conversation:
    """Running digests of one conversation, fed part by part."""

    def __init__(self, key) -> None:
        self.key, self.parts, self.size = key, [], 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.loss_tokens = 0

    def flush(self, renderer: Renderer, tokenizer, learned: frozenset[str]) -> None:
        if not self.parts:
            return
        formatted = "".join(self.parts)
        self.parts, self.size = [], 0
        encoding = tokenizer.encode(formatted, add_special_tokens=False)
        starts, ends = token_spans(encoding)
        spans = renderer.spans(formatted)
        for role, begin, end in spans:
            self.turns.update(f"{role}\n{renderer.unescape(formatted[begin:end])}\n".encode())
        wanted = [(b, e) for role, b, e in spans if role in learned and e > b]
        for first, last in loss_mask(starts, ends, wanted) if wanted else ():
            text = renderer.unescape(formatted[starts[first] : ends[last - 1]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
            self.loss_tokens += last - first
        self.n_turns += len(spans)
        self.chars += len(formatted)
        self.n_tokens += len(starts)

    def row(self) -> tuple:
        return (
            self.key,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
            self.n_tokens,
            self.loss_tokens,
        )


def _turn_rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(
        df[conv_id].alias("conv_id"), df[turn].alias("turn"), text_of(df[role]).alias("role"), text_of(df[text]).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(
    df: DataFrame,
    tokenizer: str | Path,
    template: Template = Template(),
    learned: tuple[str, ...] = ("assistant",),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Format and encode every conversation; digests of what can be read back from the output.

    ``tokenizer`` is a byte-level tokenizer in JSON, whose text travels with the tasks. Turns follow ``turn`` (nulls
    first), equal turns follow role and text. Result, one row per conversation: ``conv_id``, ``n_turns``,
    ``turns_sha256`` (role, line feed, text, line feed per turn, as parsed from the formatted text), ``loss_chars`` and
    ``loss_sha256`` (the unescaped text under the tokens of the loss mask: the turns of ``learned`` roles),
    ``formatted_chars``, ``n_tokens``, ``loss_tokens``.

    Null roles and texts count as empty; a null ``conv_id`` is one conversation; repeated rows are turns each; other
    columns are not read. Conversations stream through sorted partitions: a task holds one Arrow batch and one part of
    a conversation, so a conversation of any length fits, though one digest can only be made by one task.
    """
    spec = Path(tokenizer).read_text()
    json.loads(spec)
    kind = df.schema[conv_id].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
    )
    names = frozenset(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = chat_tokenizer(spec, template)
        renderer = Renderer(template)
        types = None
        open_: _Conversation | None = None
        done: list[tuple] = []

        def packed():
            columns = list(zip(*done))
            kinds = [types, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(
                arrays,
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"],
            )

        for batch in batches:
            types = batch.schema.field(0).type
            keys, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for key, who, said in zip(keys, roles, texts):
                if open_ is None or key != open_.key:
                    if open_ is not None:
                        open_.flush(renderer, made, names)
                        done.append(open_.row())
                    open_ = _Conversation(key)
                rendered = renderer.turn(who, said)
                open_.parts.append(rendered)
                open_.size += len(rendered)
                if open_.size >= PART_CHARS:
                    open_.flush(renderer, made, names)
            if len(done) >= 1000:
                yield packed()
        if open_ is not None:
            open_.flush(renderer, made, names)
            done.append(open_.row())
        if done:
            yield packed()

    return _turn_rows(df, conv_id, turn, role, text).mapInArrow(run, schema)


def formatted_chats(
    df: DataFrame,
    template: Template = Template(),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The formatted texts themselves, one row per conversation: ``conv_id``, ``formatted``.

    A conversation has to fit into one string here; `format_chats` has no such bound.
    """
    kind = df.schema[conv_id].dataType.simpleString()

    def run(batches):
        renderer, key, parts, began, types = Renderer(template), None, [], False, None

        def one():
            return pa.RecordBatch.from_arrays([pa.array([key], types), pa.array(["".join(parts)])], ["conv_id", "formatted"])

        for batch in batches:
            types = batch.schema.field(0).type
            for now, who, said in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if began and now != key:
                    yield one()
                    parts = []
                key, began = now, True
                parts.append(renderer.turn(who, said))
        if began:
            yield one()

    return _turn_rows(df, conv_id, turn, role, text).mapInArrow(run, f"conv_id {kind}, formatted string")


def read_chat(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    renderer = Renderer(template)
    return [(role, renderer.unescape(formatted[b:e])) for role, b, e in renderer.spans(formatted)]


def with_control_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Conversations and one more, -1: a user and an assistant who both say a row of control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    own = df.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    columns = [F.col(c).cast(df.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")]
    return df.select("conv_id", "turn", "role", "text").unionByName(own.select(*columns))
