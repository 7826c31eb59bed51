"""Removal of repeated substrings: common prefixes derived from a Burrows-Wheeler transform, down to a minimum length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.fuzzy import Powers
from docsieve.llm.shared import arrow_map, keep, slices, text_of

# Bytes of context that are sorted at once; a group of contexts with a common anchor always lies in one block.
BLOCK = 1 << 21
# Groups of more contexts than this are counted window by window instead, wherever their rows are.
GROUP_MOST = 1024
# Bytes of a text whose windows are looked at together.
PIECE = 1 << 20
# Bytes of the segments that contexts are fetched from.
SEGMENT = 4096
# So many 64-bit keys (some 25 MB) are sent to all executors, to leave out of a shuffle what they do not name; beyond
# that everything is shuffled, with the same result.
SENT_KEYS = 500_000


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Order of all suffixes by their first ``length`` bytes or more, by doubling the compared prefix."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key |= padded[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)

    def ranked(sorted_key_differs: np.ndarray, where: np.ndarray, places: np.ndarray) -> None:
        """Give the suffixes at ``where`` the rank of the first of their equals."""
        starts = np.maximum.accumulate(np.where(sorted_key_differs, places, 0))
        rank[where] = starts

    differs = np.empty(n, bool)
    differs[:1] = True
    differs[1:] = key[order[1:]] != key[order[:-1]]
    ranked(differs, order, np.arange(n))
    known = 8
    while known < length:
        # Only suffixes that still have an equal are looked at again.
        alone = differs & np.append(differs[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        open_ = order[places]
        behind = np.where(open_ + known < n, rank[np.minimum(open_ + known, n - 1)] + 1, 0)
        both = rank[open_] * (n + 2) + behind
        again = np.argsort(both, kind="stable")
        open_, both = open_[again], both[again]
        order[places] = open_
        new = np.empty(len(places), bool)
        new[:1] = True
        new[1:] = both[1:] != both[:-1]
        differs[places] = new
        ranked(new, open_, places)
        known *= 2
    return order


def long_common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order whether the suffix shares ``length`` bytes or more with the one before it.

    Intervals of the order stand for the strings that their suffixes begin with. Breadth first, every interval is
    extended to the left by each byte that occurs before its suffixes in the Burrows-Wheeler transform; the right border
    of an interval of a string of l bytes has a common prefix of l - 1 if it has none yet, and only then the interval is
    extended further. So the values appear by increasing length, and after ``length`` rounds those still without a value
    are at least that long. Strings that hold a zero byte, which separates contexts, are never formed.
    """
    n = len(text)
    before = text[order - 1]  # the first suffix is preceded by the last byte, a separator
    place = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[place] = np.arange(n)  # place of the suffix that is longer by the byte before
    following = np.full(n, n, np.int64)
    same = before[place[1:]] == before[place[:-1]]
    following[place[:-1][same]] = place[1:][same]  # next place with the same byte before
    previous = np.full(n, -1, np.int64)
    previous[place[1:][same]] = place[:-1][same]
    open_ = np.ones(n + 1, bool)  # borders without a value yet
    open_[0] = False
    # The strings of one byte.
    first = np.flatnonzero(np.append(True, text[order[1:]] != text[order[:-1]]))
    left, right = first, np.append(first[1:], n)
    open_[right] = False
    fine = text[order[left]] != 0
    left, right = left[fine], right[fine]
    for _ in range(length - 1):
        if not len(left):
            break
        made_left, made_right = [], []
        single = right - left == 1
        at = left[single]
        at = at[before[at] != 0]
        made_left.append(to[at])
        made_right.append(to[at] + 1)
        wide_left, wide_right = left[~single], right[~single]
        # All places of the wide intervals, some millions at a time, with the interval each belongs to.
        size = wide_right - wide_left
        upto = np.cumsum(size)
        start = 0
        while start < len(size):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + (1 << 20), "right")))
            lo, hi, count = wide_left[start:stop], wide_right[start:stop], size[start:stop]
            shift = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count)
            all_ = np.arange(count.sum()) + shift
            last = (following[all_] >= np.repeat(hi, count)) & (before[all_] != 0)
            first_ = (previous[all_] < np.repeat(lo, count)) & (before[all_] != 0)
            whose = np.repeat(np.arange(start, stop), count)
            # Per interval and byte one first and one last place; sorting by byte brings them together.
            a, b = all_[first_], all_[last]
            a = a[np.lexsort((before[a], whose[first_]))]
            b = b[np.lexsort((before[b], whose[last]))]
            made_left.append(to[a])
            made_right.append(to[b] + 1)
            start = stop
        left, right = np.concatenate(made_left), np.concatenate(made_right)
        new = open_[right]
        left, right = left[new], right[new]
        open_[right] = False
    return open_[:n]


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Places in the text at which a string of ``length`` bytes without a zero begins that also begins elsewhere."""
    n = len(text)
    order = suffix_array(text, length)
    same = long_common_prefixes(text, order, length)
    zeros = np.flatnonzero(text == 0)
    whole = np.append(zeros, n)[np.searchsorted(zeros, np.arange(n))] - np.arange(n) >= length
    fits = whole[order]
    pair = same[1:] & fits[1:] & fits[:-1]
    found = np.zeros(n, bool)
    found[order[1:][pair]] = True
    found[order[:-1][pair]] = True
    return np.flatnonzero(found)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(29))


def anchors(data: np.ndarray, length: int, width: int, powers: Powers):
    """Split a text's windows of ``length`` bytes by the anchor of each: (anchor hash, context hash, first, last) arrays.

    The anchor of a window is its leftmost string of ``width`` bytes with the smallest hash, so equal windows have equal
    anchors at the same place in them. ``first`` to ``last`` are the starts of neighbouring windows whose anchor is at
    one place of the text; their context is the text from ``first`` to the end of the last window.
    """
    n = len(data)
    up, down = powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    hashes = _mix((sums[width:] - sums[:-width]) * up[: n - width + 1])
    span = length - width + 1
    windows = n - length + 1
    # The leftmost of the smallest: the upper half of the hash, then the place, so that one number is compared.
    keys = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    rows = np.concatenate([keys, np.full(-len(keys) % span, ~np.uint64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], windows) - 1
    at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    context = _mix((sums[last + length] - sums[first]) * up[first] + (last - first).astype(np.uint64))
    return hashes[at].view(np.int64), context.view(np.int64), first, last


def window_hashes(data: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    n = len(data)
    up, down = powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    return _mix((sums[length:] - sums[:-length]) * up[: n - length + 1]).view(np.int64)


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans that overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The texts of a string column as arrays of bytes, without copying them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else []
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for a, b in zip(at[:-1], at[1:]):
        yield body[a:b]


def _arrays(schema: str, *columns) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _anchor_rows(docs: DataFrame, length: int, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, anchor bigint, context bigint, first int, last int"

    def each():
        powers = Powers()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts, counts, rows, size = [], [], [], 0

            def packed():
                found = [np.concatenate(c) for c in zip(*parts)]
                whose = pa.array(np.repeat(rows, counts))
                return _arrays(
                    schema, batch.column(0).take(whose), batch.column(1).take(whose), *found[:2], *(c.astype(np.int32) for c in found[2:])
                )

            for row, data in enumerate(_bytes_of(batch.column(2))):
                # A context that goes on in the next piece is two contexts.
                for start in range(0, len(data) - length + 1, PIECE):
                    hash_, context, first, last = anchors(data[start : start + PIECE + length - 1], length, width, powers)
                    parts.append((hash_, context, first + start, last + start))
                    counts.append(len(hash_))
                    rows.append(row)
                    size += len(hash_)
                    if size > 100_000:
                        yield packed()
                        parts, counts, rows, size = [], [], [], 0
            if parts:
                yield packed()

        return work

    return arrow_map(docs, schema, each)


def _segments(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, text_key, segment, body): texts in parts of SEGMENT bytes, each with ``most`` bytes of the next ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, segment int, body binary"

    def each():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows, numbers, bodies = [], [], []

            def packed():
                whose = pa.array(rows, pa.int64())
                kept = batch.column(0).take(whose), batch.column(1).take(whose)
                return _arrays(schema, *kept, pa.array(numbers, pa.int32()), pa.array(bodies, pa.binary()))

            for row, data in enumerate(_bytes_of(batch.column(2))):
                for start in range(0, len(data), SEGMENT):
                    rows.append(row)
                    numbers.append(start // SEGMENT)
                    bodies.append(data[start : start + SEGMENT + most].tobytes())
                    if len(rows) == 2000:
                        yield packed()
                        rows, numbers, bodies = [], [], []
            if rows:
                yield packed()

        return work

    return arrow_map(docs, schema, each)


def _sent(keys: DataFrame, name: str) -> DataFrame | None:
    """The different hashes of ``keys``, to be sent to all executors, or None where they are too many."""
    found = keep(keys.select(F.xxhash64("*").alias("key")).distinct(), name)
    return F.broadcast(found) if found.count() <= SENT_KEYS else None


def _contexts(requests: DataFrame, docs: DataFrame, length: int, width: int) -> DataFrame:
    """Fetch the texts of the requested contexts from the segments of their documents in which they begin."""
    where = ["doc_id", "text_key", "segment"]
    requests = requests.withColumn("segment", (F.col("first") / SEGMENT).cast("int"))
    segments = _segments(docs, 2 * length - width)
    sent = _sent(requests.select(where), "context-segments")
    if sent is not None:
        segments = segments.withColumn("key", F.xxhash64(*where)).join(sent, "key", "left_semi").drop("key")
    same = segments["doc_id"].eqNullSafe(requests["doc_id"])
    for c in where[1:]:
        same &= segments[c] == requests[c]
    # Rows equal in id and text give a context each. That adds nothing: it occurs twice, so it is repeated throughout.
    body = F.substring("body", F.col("first") % SEGMENT + 1, F.col("last") - F.col("first") + length)
    found = requests.join(segments, same)
    return found.select(requests["doc_id"], requests["text_key"], "anchor", "large", "first", body.alias("body"))


def _grouped(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _block_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings among contexts with a common anchor, block by block of whole groups."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(rows: pa.Table) -> pa.RecordBatch | None:
            rows = rows.combine_chunks().to_batches()[0]
            bodies = rows.column(5).to_pylist()
            # Bytes of UTF-8 are below 0xF5, so adding one keeps them in a byte and leaves zero to separate.
            text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8) + np.uint8(1)
            begin = np.append(0, np.cumsum([len(b) + 1 for b in bodies])[:-1])
            at = repeated_starts(text, length)
            if not len(at):
                return None
            whose = np.searchsorted(begin, at, "right") - 1
            offset = at - begin[whose]
            new = np.append(True, (whose[1:] != whose[:-1]) | (offset[1:] != offset[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            base = rows.column(4).to_numpy()[whose[first]]
            pick = pa.array(whose[first])
            return _arrays(
                schema,
                rows.column(0).take(pick),
                rows.column(1).take(pick),
                (base + offset[first]).astype(np.int32),
                (base + offset[last]).astype(np.int32),
            )

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < 2 * BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            anchor = rows.column(2).to_numpy()
            length_ = np.cumsum(pc.binary_length(rows.column(5)).to_numpy())
            # Whole groups go into blocks; the last group may go on in the next batch.
            edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
            start = 0
            for e, edge in enumerate(edges[1:-1]):
                following = length_[edges[e + 2] - 1] - (length_[start - 1] if start else 0)
                if following > BLOCK or e == len(edges) - 3:
                    found = solve(rows.slice(start, edge - start))
                    start = int(edge)
                    if found is not None:
                        yield found
            held, size = rows.slice(start).to_batches(), rows.slice(start).nbytes
        if held:
            found = solve(pa.Table.from_batches(held))
            if found is not None:
                yield found

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_key", "first")
    return dealt.mapInArrow(run, schema)


def _window_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings in large groups: every window is a row, counted by two independent 64-bit hashes."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, first int, anchor bigint, hash bigint"

    def each():
        powers = Powers()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            anchor, first = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            for row, data in enumerate(_bytes_of(batch.column(5))):
                hashes = window_hashes(data, length, powers)
                whose = pa.array(np.full(len(hashes), row))
                yield _arrays(
                    schema,
                    batch.column(0).take(whose),
                    batch.column(1).take(whose),
                    (first[row] + np.arange(len(hashes))).astype(np.int32),
                    np.full(len(hashes), anchor[row]),
                    hashes,
                )

        return lambda batch: _grouped(work(batch), 20_000)

    rows = keep(arrow_map(contexts, schema, each), "large-windows")
    shared = keep(rows.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared-windows")
    return rows.join(shared, ["anchor", "hash"]).select("doc_id", "text_key", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, length: int, width: int) -> DataFrame:
    """Starts of repeated strings as (doc_id, text_key, first, last); ``docs`` has doc_id, text_key, text."""
    rows = keep(_anchor_rows(docs, length, width), "anchors")
    seen = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most"))
    # Kept, as Spark can split the rows of a frequent anchor only in a join of tables, not in one with sums.
    seen = keep(seen.where("n > 1").select("anchor", (F.col("least") == F.col("most")).alias("plain")), "repeated-anchors")
    # Where all contexts of an anchor are equal, all their windows are repeated.
    shared = keep(rows.join(seen, "anchor"), "shared-anchors")
    plain = shared.where("plain").select("doc_id", "text_key", "first", "last")
    mixed = shared.where("not plain")
    who = F.struct("doc_id", "text_key", "first", "last")
    distinct = keep(mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(who).alias("who")), "contexts")
    equal = mixed.join(distinct.where("n > 1").select("anchor", "context"), ["anchor", "context"]).select(
        "doc_id", "text_key", "first", "last"
    )
    # What is left are contexts that differ from all others: their windows may still be repeated, near their ends.
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    groups = groups.where("least = 1").select("anchor", (F.col("m") > GROUP_MOST).alias("large"))
    asked = distinct.join(groups, "anchor").select("anchor", "large", "who.*")
    contexts = keep(_contexts(keep(asked, "asked-contexts"), docs, length, width), "context-texts")
    blocks = _block_spans(contexts.where("not large"), length)
    windows = _window_spans(contexts.where("large"), length)
    return plain.unionByName(equal).unionByName(blocks).unionByName(windows)


def remove_repeats(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 400,
    width: int = 200,
    kept: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also begins elsewhere in the texts.

    Texts are UTF-8 bytes; matches never cross texts, may overlap, and are judged on the input. Result, one row per
    input row: ``doc_id``, ``text_key`` (a hash of the text), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_sha256`` and, if asked for, ``kept_text`` (bytes of a character that lost others are left out) and
    ``row``, a struct of the columns to ``carry`` along.

    Each window of ``length`` bytes belongs to an anchor, its string of ``width`` bytes with the smallest hash. Windows
    whose anchor occurs once cannot be repeated; contexts that occur as a whole more than once are repeated throughout.
    Only contexts that share an anchor and differ are compared byte by byte, with the Burrows-Wheeler transform of
    blocks of whole groups; groups of more than GROUP_MOST different contexts are counted window by window instead.

    A null text counts as empty. Rows equal in id and text get equal results, and each makes the other's strings
    repeated. Null ids are ids. Other columns are not read; an empty table gives an empty result.
    """
    if not 8 <= width <= length:
        raise ValueError("width must be from 8 to length")
    kind = df.schema[doc_id].dataType.simpleString()
    row = F.struct(*(df[c] for c in carry or [doc_id])).alias("row")
    docs = df.select(
        df[doc_id].alias("doc_id"), F.xxhash64(text_of(df[text])).alias("text_key"), text_of(df[text]).alias("text"), row
    )
    whose = ["doc_id", "text_key"]
    spans = repeated_spans(docs.drop("row"), length, width)
    spans = keep(spans.groupBy(whose).agg(F.collect_list(F.struct("first", "last")).alias("spans")), "repeated-spans")
    columns = [*whose, "text", *(["row"] if carry else [])]
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    sent = _sent(spans.select(whose), "repeated-documents")
    shuffled, alone = docs, None
    if sent is not None:
        # Documents without spans stay where they are.
        keyed = docs.withColumn("key", F.xxhash64(*whose))
        shuffled = keyed.join(sent, "key", "left_semi")
        alone = keyed.join(sent, "key", "left_anti").select(*columns[:3], none, *columns[3:])
    same = shuffled["doc_id"].eqNullSafe(spans["doc_id"]) & (shuffled["text_key"] == spans["text_key"])
    kept_columns = [shuffled[c] for c in columns]
    found = shuffled.join(spans, same, "left").select(*kept_columns[:3], "spans", *kept_columns[3:])
    if alone is not None:
        found = found.unionByName(alone)
    more = ", kept_text string" if kept else ""
    more += f", row {found.schema['row'].dataType.simpleString()}" if carry else ""
    schema = f"doc_id {kind}, text_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}"

    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(3)
            fields = lists.flatten()
            names = [fields.type.field(i).name for i in range(fields.type.num_fields)]
            first = fields.field(names.index("first")).to_numpy(zero_copy_only=False)
            last = fields.field(names.index("last")).to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            at, rows = 0, []
            for data, count in zip(_bytes_of(batch.column(2)), counts):
                a, b = joined_spans(first[at : at + count].astype(np.int64), last[at : at + count].astype(np.int64) + length)
                at += count
                edges = np.concatenate([[0], np.column_stack([a, b]).ravel(), [len(data)]]).astype(np.int64)
                rest = b"".join(data[x:y].tobytes() for x, y in edges.reshape(-1, 2))
                row = [len(data), int((b - a).sum()), len(a), hashlib.sha256(rest).hexdigest()]
                rows.append([*row, rest.decode(errors="ignore")] if kept else row)
            columns = [pa.array(c) for c in zip(*rows)]
            names = ["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 2 + len(columns)]
            if carry:
                columns, names = [*columns, batch.column(4)], [*names, "row"]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

        return lambda batch: (work(part) for part in slices(batch, 2, 16_000_000))

    return arrow_map(found, schema, each)


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: str | None = None, **how) -> DataFrame:
    """The rows of ``df`` with all their columns, their texts without repeated strings; ``chars`` gets the new length."""
    found = remove_repeats(df, doc_id, text, carry=df.columns, **how)
    made = {text: F.col("kept_text")}
    if chars:
        made[chars] = F.length("kept_text").cast(df.schema[chars].dataType)
    return found.select(*(made.get(c, F.col("row")[c]).alias(c) for c in df.columns))
