"""Periodic runs of words: Baier's grouping gives the Lyndon words of both orders, whose repeats are extended into runs."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.shared import arrow_map, slices, text_of, words_of

# Slots in which windows of words are counted first, by hash.
SLOTS = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon_groups(text: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The longest Lyndon word at each place, as (length, group): equal groups stand for equal words.

    First phase of Baier's suffix sorting. Places are grouped by their first letter. Groups are taken from the highest
    to the lowest; each place of a group points to the nearest place before it that lies in a lower group. A place that
    gets k pointers from one group moves, with those of its own group that get k as well, to a new group just above its
    old one, whose word is the old word followed k times by the word of the group that points.
    """
    n = len(text)
    letters = sorted(set(text))
    number = {letter: g for g, letter in enumerate(letters)}
    # Places count from 1; place 0 stands for "none" and is never done.
    group = [-1, *map(number.__getitem__, text)]
    members: list[list[int]] = [[] for _ in letters]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    size = [1] * len(letters)
    below = list(range(-1, len(letters) - 1))
    above = [*range(1, len(letters)), -1] if letters else []
    done, before = bytearray(n + 1), [0] * (n + 1)
    top = len(letters) - 1
    while top >= 0:
        here = [i for i in members[top] if group[i] == top]
        for i in here:
            done[i] = 1
        pointers: dict[int, int] = {}
        for i in here:
            j = i - 1
            while done[j]:
                j = before[j]
            before[i] = j
            if j:
                pointers[j] = pointers.get(j, 0) + 1
        if pointers:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in pointers.items():
                moved.setdefault((-k, group[j]), []).append(j)
            for (k, old), places in sorted(moved.items()):
                new, up = len(size), above[old]
                size.append(size[old] - k * size[top])
                members.append(places)
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for j in places:
                    group[j] = new
        members[top] = []
        top = below[top]
    found = np.array(group[1:], np.int64)
    return np.array(size, np.int64)[found] if n else np.zeros(0, np.int64), found


def _common(text: np.ndarray, a: int, b: int, step: int) -> int:
    """How many letters from ``a`` on equal those from ``b`` on, forward (step 1) or backward (step -1)."""
    most = len(text) - max(a, b) if step > 0 else min(a, b) + 1
    done, look = 0, 32
    while done < most:
        k = min(look, most - done)
        if step > 0:
            differ = text[a + done : a + done + k] != text[b + done : b + done + k]
        else:
            differ = (text[a - done - k + 1 : a - done + 1] != text[b - done - k + 1 : b - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += k
        look *= 4
    return done


def runs_of(text: Sequence[int], periods: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """Maximal stretches (start, length, smallest period) of ``periods`` periods and ``least`` letters or more.

    A run holds ``periods - 1`` whole copies of its Lyndon root next to each other. In one of the two orders, each of
    them is the longest Lyndon word at its place. So the places at which such copies begin are extended to both sides.
    """
    letters = np.asarray(text, np.int64)
    n, most, found = len(letters), int(letters.max(initial=0)), set()
    for order in (letters, most - letters):
        size, group = lyndon_groups(order.tolist())
        place = np.arange(n)
        after = place + size
        again = after < n
        again[again] = group[after[again]] == group[again]
        ahead = place - size
        first = ahead < 0
        first[~first] = group[ahead[~first]] != group[~first]
        at = place[first]
        for _ in range(periods - 2):
            at = at[again[at]]
            at = at + size[at]
        # Back to the first copy.
        at = at - size[at] * (periods - 2) if len(at) else at
        for i in at.tolist():
            p = int(size[i])
            left = _common(letters, i - 1, i + p - 1, -1) if i else 0
            length = left + p + _common(letters, i, i + p, 1)
            if length >= max(least, periods * p):
                found.add((i - left, length, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def repeating_stretches(hashes: np.ndarray, counts: np.ndarray, periods: int = 4, least: int = 6) -> list[tuple[int, int]]:
    """Stretches (first, behind) of words outside of which no run can be; ``counts`` has the words of each text.

    All windows of words of a run occur in it several times: those of three words three times if it has four periods and
    five words. Windows that occur less often in their text part it into stretches; that is done again inside of these.
    Counting hashes can only take a window for frequent that is not, so no run is lost.
    """
    window, times = (3, 3) if periods >= 4 and least >= 5 else (2, 2) if periods >= 3 else (1, 2)
    n = len(hashes) - window + 1
    if n <= 0:
        return []
    whose = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    factors = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]

    def mixed(values: np.ndarray) -> np.ndarray:
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        return values ^ (values >> np.uint64(29))

    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += hashes[k : n + k] * factors[k]
    keys = mixed(keys)
    place = np.flatnonzero(whose[:n] == whose[window - 1 :])
    slot = (mixed(keys[place] + whose[place] * factors[0]) & np.uint64(SLOTS - 1)).astype(np.int64)
    place = place[np.bincount(slot, minlength=SLOTS)[slot] >= times]
    fewest = max(least, periods) - window + 1

    def begins() -> np.ndarray:
        text = whose[place]
        return np.append(True, (np.diff(place) != 1) | (text[1:] != text[:-1]))[: len(place)]

    # Each round can only part stretches further; stopping early costs time, not results.
    for _ in range(6):
        stretch = np.cumsum(begins()) - 1
        long_ = np.bincount(stretch)[stretch] >= fewest if len(place) else np.zeros(0, bool)
        place, stretch = place[long_], stretch[long_]
        if not len(place):
            return []
        inside = mixed(keys[place] + stretch.astype(np.uint64) * factors[1])
        _, back, often = np.unique(inside, return_inverse=True, return_counts=True)
        frequent = often[back] >= times
        if frequent.all():
            break
        place = place[frequent]
    if not len(place):
        return []
    edges = np.flatnonzero(begins())
    first, last = place[edges], place[np.append(edges[1:], len(place)) - 1]
    fine = last - first + 1 >= fewest
    return list(zip(first[fine].tolist(), (last[fine] + window).tolist()))


def _runs_of_texts(words: list[bytes], counts: np.ndarray, periods: int, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, whose words follow each other in ``words``."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    begin = np.append(0, np.cumsum(counts))
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for first, behind in repeating_stretches(hashes, counts, periods, least):
        text = int(np.searchsorted(begin, first, "right")) - 1
        number: dict[bytes, int] = {}
        letters = [number.setdefault(word, len(number)) for word in words[first:behind]]
        shift = first - int(begin[text])
        found[text].extend((start + shift, length, p) for start, length, p in runs_of(letters, periods, least))
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def _longest_running(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; among equals that with the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])


def find_runs(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", periods: int = 4, least: int = 6, texts: bool = True
) -> DataFrame:
    """Find the periodic runs of words in every whole text.

    A run is a stretch of words with smallest period q (words q apart are equal) and ``max(least, periods * q)`` words or
    more that cannot be extended to either side. Words are runs of anything but blank, tab, line feed, vertical tab, form
    feed and carriage return. Result, one row per input row: ``doc_id``, ``n_runs``, ``start``, ``length``, ``period`` and
    ``exponent_milli`` of the run with the greatest length in periods (ties: smallest start, then period; nulls without a
    run), ``runs_sha256`` (over ``start,length,period`` lines), ``collapsed_sha256``, and with ``texts`` also ``runs`` (all
    of them, by start, then period) and ``collapsed``: the words joined by a blank, without those that any run contains
    after its first period.

    Texts are cut where windows of words are too rare to lie in a run. The stretches left are grouped by Lyndon words in
    both orders, and Lyndon words that stand side by side are extended to runs.

    A null text has no words, as an empty one. Each row is judged alone, whole however long, so repeated rows, null ids
    and empty tables need no care; other columns are not read.
    """
    if periods < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = df.schema[doc_id].dataType.simpleString()
    numbers = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint"
    more = f", runs array<{RUN}>, collapsed string" if texts else ""
    schema = f"doc_id {kind}, {numbers}, runs_sha256 string, collapsed_sha256 string{more}"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        # The split of bytes knows just the white space named above.
        split = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        counts = np.array([len(words) for words in split], np.int64)
        found = _runs_of_texts([word for words in split for word in words], counts, periods, least)
        rows, kept, lists = [], [], []
        for words, runs in zip(split, found):
            best = _longest_running(runs)
            rest = _collapsed(words, runs)
            written = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
            digests = hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()
            rows.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
            if texts:
                kept.append(rest.decode())
                lists.append([dict(zip(("start", "length", "period"), run)) for run in runs])
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
        if texts:
            arrays += [pa.array(lists, run_type), pa.array(kept, pa.string())]
        names = [part.split()[0] for part in f"doc_id, {numbers}, runs_sha256, collapsed_sha256".split(", ")]
        names += ["runs", "collapsed"] if texts else []
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    rows = df.select(df[doc_id].alias("doc_id"), text_of(df[text]).alias("text"))
    return arrow_map(rows, schema, lambda: lambda batch: (work(part) for part in slices(batch, 1)))


def with_periodic_tails(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), about a tenth of the texts with a tail that repeats: runs to be found, planted by the crc of the id.

    With h the crc32 of the decimal id and g = h div 10: if h mod 10 is 0, the words from place a = g mod n on repeat the
    first p of them, p = 1 + (n - a) div (3 + g mod 8). Null ids and texts without words stay as they are.
    """
    h = F.crc32(df[doc_id].cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_of(text_of(df[text]))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    made = F.when((h % 10 == 0) & (n > 0), planted).otherwise(df[text])
    return df.select(df[doc_id].alias("doc_id"), made.alias("text"))
