"""Packing documents into sequences: linear grouping of large pieces, few-size configurations, best fit for small ones.

What is planned depends on the number of pieces of each length alone, so the plan is of bounded size: at most one count
per length reaches the driver, however many documents there are. Documents find their places in the tasks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.llm.shared import arrow_map, keep, remembered, slices, text_of

# Pieces over this part of a sequence are large, and so many groups are made of them; of these schemes the best counts.
SCHEMES = ((1 / 8, 48), (1 / 4, 96), (1 / 3, 144), (1 / 2, 48))


@dataclass
class _Bins:
    """``count`` bins with the same contents (pieces by length) and the same room left."""

    count: int
    room: int
    holds: Counter = field(default_factory=Counter)

    def filled(self, count: int, size: int, pieces: int) -> _Bins:
        return _Bins(count, self.room - size * pieces, self.holds + Counter({size: pieces}))


class _Open:
    """Kinds of bins ordered by their room."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[_Bins]] = {}
        self.rooms: list[int] = []

    def add(self, bins: _Bins) -> None:
        if bins.room not in self.by_room:
            self.by_room[bins.room] = []
            insort(self.rooms, bins.room)
        self.by_room[bins.room].append(bins)

    def tightest(self, size: int) -> _Bins | None:
        """Take out a kind of the least room that is enough."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        bins = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            del self.rooms[at]
        return bins

    def all(self) -> list[_Bins]:
        return [bins for room in self.rooms for bins in self.by_room[room]]


def best_fit(open_: _Open, sizes: Counter, capacity: int) -> None:
    """Put the pieces, largest first, where they leave the least room; a bin that took one is the tightest for the next."""
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        while left:
            bins = open_.tightest(size)
            if bins is None:
                each = capacity // size
                whole, rest = divmod(left, each)
                if whole:
                    open_.add(_Bins(whole, capacity).filled(whole, size, each))
                if rest:
                    open_.add(_Bins(1, capacity).filled(1, size, rest))
                break
            each = bins.room // size
            whole = min(bins.count, left // each)
            if whole:
                open_.add(bins.filled(whole, size, each))
                left -= whole * each
            more = bins.count - whole
            if more and left:
                open_.add(bins.filled(1, size, left))
                left, more = 0, more - 1
            if more:
                open_.add(_Bins(more, bins.room, bins.holds))


def linear_groups(sizes: Counter, groups: int) -> list[tuple[int, Counter]]:
    """Split pieces, largest first, into groups of equally many; each as (its largest length, its pieces).

    Groups with the same largest length are one. With no more lengths than groups, every length is a group.
    """
    ordered = sorted(sizes, reverse=True)
    if len(ordered) <= groups:
        return [(size, Counter({size: sizes[size]})) for size in ordered]
    each = -(-sizes.total() // groups)
    found: list[tuple[int, Counter]] = []
    room = 0
    for size in ordered:
        left = sizes[size]
        while left:
            if not room:
                room = each
                if not found or found[-1][0] != size:
                    found.append((size, Counter()))
            taken = min(left, room)
            found[-1][1][size] += taken
            left -= taken
            room -= taken
    return found


def _best_configuration(weights: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration (pieces per weight) of greatest worth that fits, by the number of pieces in it."""
    best = np.zeros(capacity + 1)
    chosen: list[np.ndarray] = []
    useful = np.flatnonzero(worth > 1e-12)
    if not len(useful):
        return 0.0, np.zeros(len(weights), np.int64)
    room = np.arange(capacity + 1) - weights[useful][:, None]
    fits, behind = room >= 0, np.maximum(room, 0)
    for _ in range(capacity // int(weights[useful].min())):
        more = np.where(fits, best[behind] + worth[useful][:, None], -1.0)
        pick = more.argmax(axis=0)
        new = more[pick, np.arange(capacity + 1)]
        better = new > best + 1e-12
        if not better.any():
            break
        chosen.append(np.where(better, useful[pick], -1))
        best = np.where(better, new, best)
    configuration, room = np.zeros(len(weights), np.int64), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            i = pick[room]
            configuration[i] += 1
            room -= weights[i]
    return float(configuration @ worth), configuration


def few_size_configurations(weights: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, few bins in all, without more pieces than there are.

    The linear program over all configurations is solved by generating columns: the one of greatest worth under the
    present prices enters until none is worth more than a bin. What rounding down leaves is for the caller to pack.
    """
    w, need = np.array(weights, np.int64), np.array(demand, np.float64)
    k = len(w)
    basis = np.diag((capacity // w).astype(np.float64))
    used = need / np.diag(basis)
    for _ in range(60 * k + 200):
        prices = np.linalg.solve(basis.T, np.ones(k))
        worth, entering = _best_configuration(w, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, entering.astype(np.float64))
        falls = change > 1e-9
        steps = np.full(k, np.inf)
        steps[falls] = np.maximum(used[falls], 0) / change[falls]
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            break
        step = steps[out]
        used = used - step * change
        used[out] = step
        basis[:, out] = entering
    left = np.array(demand, np.int64)
    found = []
    for j in range(k):
        configuration = np.rint(basis[:, j]).astype(np.int64)
        fits = configuration > 0
        times = int(min(np.floor(used[j] + 1e-6), (left[fits] // configuration[fits]).min())) if fits.any() else 0
        if times > 0:
            left = left - configuration * times
            found.append((configuration, times))
    return found


def _substituted(groups: list[tuple[int, Counter]], configurations: list[tuple[np.ndarray, int]], capacity: int) -> list[_Bins]:
    """Bins of actual lengths: each place of a configuration gets the largest pieces left of its group, in turn."""
    stock = [sorted(([size, n] for size, n in pieces.items()), reverse=True) for _, pieces in groups]
    bins = []
    for configuration, times in configurations:
        places: list[list[tuple[int, int]]] = []
        for g, copies in enumerate(configuration.tolist()):
            for _ in range(copies):
                runs, want = [], times
                while want:
                    head = stock[g][0]
                    taken = min(want, head[1])
                    runs.append((head[0], taken))
                    want -= taken
                    head[1] -= taken
                    if not head[1]:
                        stock[g].pop(0)
                places.append(runs)
        # Where no place changes its length, bins are alike.
        ends = sorted({int(e) for runs in places for e in np.cumsum([n for _, n in runs])})
        at, start = [0] * len(places), 0
        spent = [0] * len(places)
        for end in ends:
            sizes = [runs[at[i]][0] for i, runs in enumerate(places)]
            bins.append(_Bins(end - start, capacity - sum(sizes), Counter(sizes)))
            for i, runs in enumerate(places):
                spent[i] += end - start
                if spent[i] == runs[at[i]][1] and at[i] + 1 < len(runs):
                    at[i], spent[i] = at[i] + 1, 0
            start = end
    return bins


@dataclass(frozen=True)
class Plan:
    """Where the r-th piece of a length goes: per length and range of ranks a first sequence, an offset, pieces a bin."""

    key: np.ndarray  # length << 48 | first rank, ascending
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        at = np.searchsorted(self.key, (length.astype(np.int64) << 48) | rank, "right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def _scheme(pieces: Counter, capacity: int, large: float, groups: int) -> list[_Bins]:
    """Linear grouping with one notion of large and number of groups."""
    big = Counter({s: n for s, n in pieces.items() if capacity * large < s})
    small = Counter({s: n for s, n in pieces.items() if s not in big})
    open_ = _Open()
    if big:
        grouped = linear_groups(big, groups)
        found = few_size_configurations([s for s, _ in grouped], [c.total() for _, c in grouped], capacity)
        left = Counter(big)
        for bins in _substituted(grouped, found, capacity):
            open_.add(bins)
            left.subtract({s: n * bins.count for s, n in bins.holds.items()})
        best_fit(open_, +left, capacity)
    best_fit(open_, small, capacity)
    return open_.all()


def plan_packing(sizes: dict[int, int], capacity: int, schemes: Sequence[tuple[float, int]] = SCHEMES) -> Plan:
    """Plan sequences of ``capacity`` for ``sizes``: the number of pieces of each length from 1 to ``capacity``.

    A scheme (large, groups) takes pieces over ``large`` times the capacity, splits them into ``groups`` of equal
    cardinality, rounds them up to the largest of their group, and packs them by configurations of these few sizes. Actual
    pieces take their places; those that rounding the configurations left over, and then the small ones, go where they
    leave the least room. The scheme with the fewest sequences counts: many small pieces are best served by a high bound
    for large ones, few by a low one.
    """
    if any(not 1 <= size <= capacity for size in sizes):
        raise ValueError("lengths must be from 1 to the capacity")
    pieces = Counter({int(s): int(n) for s, n in sizes.items() if n})
    # Pieces that fill a sequence need no plan.
    full = pieces.pop(capacity, 0)
    tried = [_scheme(pieces, capacity, large, groups) for large, groups in schemes]
    best = min(tried, key=lambda found: sum(bins.count for bins in found))
    if full:
        best = [*best, _Bins(full, 0, Counter({capacity: 1}))]
    rows, ranks, number = [], Counter(), 0
    for bins in best:
        offset = 0
        for size in sorted(bins.holds, reverse=True):
            each = bins.holds[size]
            rows.append(((size << 48) | ranks[size], ranks[size], each, number, offset))
            ranks[size] += each * bins.count
            offset += size * each
        number += bins.count
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=number)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, and the others as the characters from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


# The pattern by which byte-level pre-tokenizers split: a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Where a blank between two white space characters, or one at the end, may be split in another way than in the whole.
UNSAFE = re.compile(r"\s (?:\s|\Z)")


class ByteLevelIds:
    """Ids of texts for a byte-level BPE vocabulary, word by word.

    The pattern never joins a blank to what is before it, so a text can be cut before each blank that has no white space
    on both sides. Every different word of a batch is then encoded once, all of them in one call, parted by a special
    token, and texts are put together from the ids of their words. Encoding itself is left to tiktoken, with ranks read
    from the vocabulary of the tokenizer; some words of each batch are encoded by the tokenizers library as well, and a
    difference stops the job. Vocabularies of another kind are encoded by the tokenizers library, text by text.
    """

    def __init__(self, spec: str, checked: int = 200) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.checked = Tokenizer.from_str(spec), checked
        self.fast = self._fast(json.loads(spec))

    @staticmethod
    def _fast(parts: dict):
        """A tiktoken encoding that says the same, or None where there may be none."""
        import tiktoken

        model, split, added = parts["model"], parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        if model["type"] != "BPE" or not plain or odd or len(added) != 1 or parts.get("normalizer"):
            return None
        vocabulary, char = model["vocab"], _byte_of_char()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in pairs]
        if model.get("ignore_merges") or made != sorted(set(made)) or len(made) + 256 != len(vocabulary):
            return None
        ranks = {bytes(char[c] for c in token): i for token, i in vocabulary.items()}
        special = {t["content"]: t["id"] for t in added}
        return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def _one(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def _words(self, words: pa.Array, blank: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, each with ``blank`` before it, one after the other, and how many each has."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        (mark, number), *_ = self.fast._special_tokens.items()
        marked = pc.match_substring(words, mark)
        listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pc.if_else(marked, "", words))
        ids = self._one(blank + pc.binary_join(listed, mark + blank)[0].as_py())
        own = ids != number
        counts = np.diff(np.append(np.flatnonzero(~own), len(ids)), prepend=-1) - 1
        ids = ids[own]
        if pc.any(marked).as_py():
            # Words with the special token in them are encoded alone.
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
                lists[i] = self._one(blank + words[i].as_py())
            ids, counts = np.concatenate(lists), np.array([len(one) for one in lists])
        return ids, counts

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and how many each text has."""
        if self.fast is None:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            lists = [np.array([*one.ids, end], "<u4") for one in found]
            return np.concatenate(lists), np.array([len(one) for one in lists])
        every = texts.to_pylist()
        unsafe = np.array([UNSAFE.search(t) is not None for t in every])
        # A text that is not cut has one part, the text.
        parts = pc.split_pattern(pc.if_else(pa.array(unsafe), "", texts), " ")
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.append(0, np.cumsum(count))
        words = parts.flatten()
        first = np.zeros(len(words), bool)
        first[begin[:-1]] = True
        later = words.filter(pa.array(~first)).dictionary_encode()
        starts = pc.if_else(pa.array(unsafe), texts, words.filter(pa.array(first)))
        table = later.dictionary
        self._check([" " + w.as_py() for w in table[:: max(1, len(table) // self.checked)]] if self.checked else [])
        blank, plain = self._words(table, " "), self._words(starts, "")
        pool = np.concatenate([blank[0], plain[0], np.array([end], "<u4")])
        size = np.concatenate([blank[1], plain[1], [1]])
        place = np.append(0, np.cumsum(size)[:-1])
        # Per text its first word, the others, and the end, as numbers of entries in the pool.
        rows = np.arange(len(count))
        order = np.empty(len(words) + len(count), np.int64)
        shift = np.repeat(rows, count) + np.arange(len(words))
        order[shift[~first]] = later.indices.to_numpy(zero_copy_only=False)
        order[shift[first]] = len(table) + rows
        order[begin[1:] + rows] = len(size) - 1
        lengths = size[order]
        upto = np.append(0, np.cumsum(lengths))
        found = pool[np.repeat(place[order] - upto[:-1], lengths) + np.arange(upto[-1])]
        return found, np.diff(upto[np.append(begin[:-1] + rows, len(order))])

    def _check(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        if [one.ids for one in found] != [self._one(w).tolist() for w in words]:
            raise ValueError("ids differ from those of the tokenizers library")


def byte_level_ids(spec: str) -> ByteLevelIds:
    """The encoder of a vocabulary, for all tasks of a Python worker; it uses one thread, as tasks have one core each."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return remembered("byte-level", spec, lambda: ByteLevelIds(spec))


def _pieces(df: DataFrame, spec: str, doc_id: str, text: str, capacity: int, end: int, ids: bool) -> DataFrame:
    """Pieces of all documents: (doc_id, piece, start, length, ids_crc32, part, rank, ids).

    ``part`` is the task and ``rank`` counts the pieces of a length in it.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    schema += ", ids array<int>" if ids else ""
    names = [column.split()[0] for column in schema.split(", ")]

    def each():
        encoder, part = byte_level_ids(spec), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, counts = encoder.encode(batch.column(1), end)
            pieces = (counts + capacity - 1) // capacity
            row = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            # The first piece is the shorter one.
            head = (counts - 1) % capacity + 1
            length = np.where(number == 0, head[row], capacity)
            start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
            edges = np.append(0, np.cumsum(length))
            sums = [zlib.crc32(found[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            np.add.at(seen, length, 1)
            columns = [
                batch.column(0).take(pa.array(row)),
                pa.array(number.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array(sums, pa.int64()),
                pa.array(np.full(len(length), part, np.int32)),
                pa.array(rank),
            ]
            if ids:
                columns.append(pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(found.astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names)

        def batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            return (work(part) for part in slices(batch, 1, 8_000_000))

        return batches

    return arrow_map(df.select(df[doc_id].alias("doc_id"), text_of(df[text]).alias("text")), schema, each, "byte-level")


def pack_documents(
    df: DataFrame,
    tokenizer: str | Path,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end: int = 0,
    ids: bool = True,
) -> DataFrame:
    """Pack the token ids of all documents, each followed by the id ``end``, into sequences of at most ``capacity``.

    ``tokenizer`` is a JSON file of the tokenizers library; its text travels with the tasks. Only documents over the
    capacity are cut, into pieces of just the capacity but for the first, which has what is left. Result, a row per
    piece: ``doc_id``, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of its
    ids as little-endian unsigned 32-bit numbers), ``sequence_id`` (from 0, without gaps), ``offset`` (its place in the
    sequence, which begins at 0 and has no gaps), and ``ids`` if asked for.

    Pieces are counted by length; the counts, one per length, are planned on the driver (see `plan_packing`), and each
    piece finds its place by its length and its rank among the pieces of that length: its rank in its task, plus the
    pieces of that length in the tasks before.

    A null text counts as empty: its only id is ``end``. Nothing is left out, however long. Repeated rows are packed as
    often as they come, null ids are ids, an empty table gives an empty result, other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = keep(_pieces(df, Path(tokenizer).read_text(), doc_id, text, capacity, end, ids), "pieces")
    counts = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # At most one row per length, so bounded by the capacity.
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(sizes, capacity)
    # A row per task and length: of one length at most as many as there are tasks.
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = keep(counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n"), "pieces-before")
    placed = pieces.join(before, ["part", "length"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "sequence_id bigint", "offset bigint"])

    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            numbers = [batch.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in range(2)]
            sequence, offset = plan.places(batch.column(3).to_numpy(zero_copy_only=False), numbers[0] + numbers[1])
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(sequence), pa.array(offset)]
            return pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

        return work

    return arrow_map(placed.select(*kept, "rank", "before"), schema, each)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from the result of `pack_documents` with ids: ``sequence_id``, ``ids``, ``doc_ids``, ``starts``.

    A group is at most one sequence long, so it fits in a task. ``starts`` are the offsets at which the pieces of
    ``doc_ids`` begin.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select(
        "sequence_id",
        F.flatten(F.col("parts")["ids"]).alias("ids"),
        F.col("parts")["doc_id"].alias("doc_ids"),
        F.col("parts")["offset"].alias("starts"),
    )
