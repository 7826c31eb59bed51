"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.shared import keep, slices, text_of

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MOST_CHUNKS = 64
WINDOW = 7

_ODD = 0x9E3779B97F4A7C15
_LETTER = np.frombuffer(LETTERS.encode(), np.uint8)
_PLACE = np.zeros(256, np.int64)
_PLACE[_LETTER] = np.arange(64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, for hashes of any part of a text."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def fingerprint(data: bytes, powers: Powers) -> str:
    """``block:letters:letters`` of a text: a letter per chunk at one block size, and at the doubled one.

    A chunk ends where the hash of the last WINDOW bytes has as many zero bits as the block size asks for, so the ends
    of a doubled block size are among those of the single one. The block size is the smallest with at most MOST_CHUNKS
    chunks, and every byte is part of some chunk.
    """
    n = len(data)
    if not n:
        return "1::"
    up, down = powers.upto(n)
    body = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(body * down[:n], out=sums[1:])
    ends = np.arange(1, n + 1)
    starts = np.maximum(ends - WINDOW, 0)
    rolled = _mixed((sums[ends] - sums[starts]) * up[starts])
    level, cuts = 0, ends
    while True:
        # The last chunk goes to the end of the text, whether it ends there by its hash or not.
        chunks = len(cuts) + (len(cuts) == 0 or cuts[-1] != n)
        if chunks <= MOST_CHUNKS:
            break
        level += 1
        cuts = cuts[(rolled[cuts - 1] & np.uint64((1 << min(level, 63)) - 1)) == 0] if level < 64 else cuts[:0]

    def letters(cuts: np.ndarray) -> str:
        edge = cuts if len(cuts) and cuts[-1] == n else np.append(cuts, n)
        begin = np.append(0, edge[:-1])
        value = _mixed((sums[edge] - sums[begin]) * up[begin])
        return _LETTER[(value >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    wider = cuts[(rolled[cuts - 1] & np.uint64((1 << min(level + 1, 63)) - 1)) == 0]
    return f"{1 << level}:{letters(cuts)}:{letters(wider)}"


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of strings of up to 64 letters, all pairs at once, a bit per letter."""
    count = len(left)
    size = np.fromiter(map(len, left), np.int64, count)
    other = np.fromiter(map(len, right), np.int64, count)
    distance = size.copy()
    if not count:
        return distance
    wide = max(int(other.max()), 1)
    text = np.zeros((count, wide), np.int64)
    for i, one in enumerate(right):
        text[i, : len(one)] = _PLACE[np.frombuffer(one.encode(), np.uint8)]
    where = np.zeros((count, 64), np.uint64)
    rows = np.repeat(np.arange(count), size)
    if len(rows):
        flat = _PLACE[np.frombuffer("".join(left).encode(), np.uint8)]
        at = np.concatenate([np.arange(n) for n in size.tolist()]).astype(np.uint64)
        np.bitwise_or.at(where, (rows, flat), np.uint64(1) << at)
    one = np.uint64(1)
    top = np.maximum(size - 1, 0).astype(np.uint64)
    plus, minus = np.full(count, ~np.uint64(0)), np.zeros(count, np.uint64)
    every = np.arange(count)
    for j in range(int(other.max())):
        equal = where[every, text[:, j]]
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(across | plus)
        down = plus & across
        live = j < other
        distance += np.where(live, ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64), 0)
        up = (up << one) | one
        down = down << one
        plus = np.where(live, down | ~(vertical | up), plus)
        minus = np.where(live, up & vertical, minus)
    return np.where(size == 0, other, distance)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of fingerprints: the best at a block size that both have, 0 if they share none."""
    best = np.array([float(a == b) for a, b in zip(left, right)])
    pairs: list[tuple[int, str, str]] = []
    for i, (a, b) in enumerate(zip(left, right)):
        if a == b:
            continue
        size_a, *letters_a = a.split(":")
        size_b, *letters_b = b.split(":")
        for x, one in enumerate(letters_a):
            y = (int(size_a) << x).bit_length() - int(size_b).bit_length()
            if 0 <= y < 2 and one and letters_b[y]:
                pairs.append((i, one, letters_b[y]))
    if pairs:
        distance = edit_distances([p[1] for p in pairs], [p[2] for p in pairs])
        longest = np.array([max(len(p[1]), len(p[2])) for p in pairs])
        np.maximum.at(best, [p[0] for p in pairs], 1 - distance / longest)
    return best


def _order(value) -> tuple:
    """Nulls first, as Spark sorts them."""
    return (value is not None, value) if value is not None else (False, 0)


def _with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt into ranges of (doc_id, text_key), each sorted and followed by the first row of the next range.

    Columns doc_id, text_key, text, range, last (true for the row of the next range). Only the ranges' first keys reach
    the driver, one small row for each partition.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("doc_id", "text_key").repartitionByRange(parts, "doc_id", "text_key")
    first = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    found = sorted(((r["first"]["doc_id"], r["first"]["text_key"]) for r in first.collect()), key=lambda k: (_order(k[0]), k[1]))
    bounds = [(_order(a), b) for a, b in found]

    # Nulls are marked apart, as pandas would turn the ids beside them into floating point numbers.
    blank = F.lit("" if isinstance(docs.schema["doc_id"].dataType, T.StringType) else 0).cast(docs.schema["doc_id"].dataType)

    @F.pandas_udf(T.IntegerType())
    def place(present, doc_id, text_key):
        import pandas as pd

        keys = zip(present.tolist(), doc_id.tolist(), text_key.tolist())
        return pd.Series([bisect.bisect_right(bounds, (_order(i if there else None), k)) - 1 for there, i, k in keys], dtype="int32")

    range_of = place(F.col("doc_id").isNotNull(), F.coalesce("doc_id", blank), F.col("text_key"))
    kinds = docs.select("doc_id", "text_key").schema
    follows = T.StructType([*kinds.fields, T.StructField("range", T.IntegerType())])
    heads = [(*found[(i + 1) % len(found)], i) for i in range(len(found))] if found else []
    # As many rows as ranges, so sending them to every task is bounded.
    heads = F.broadcast(spark.createDataFrame(heads, follows).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "range"))
    tails = docs.join(heads, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["text_key"] == F.col("_key")))
    tails = tails.groupBy("range").agg(F.first(F.struct("doc_id", "text_key", "text")).alias("row"))
    tails = tails.select("row.doc_id", "row.text_key", "row.text", "range", F.lit(True).alias("last"))
    own = docs.select("doc_id", "text_key", "text", range_of.alias("range"), F.lit(False).alias("last"))
    return own.unionByName(tails).repartition("range").sortWithinPartitions("range", "last", "doc_id", "text_key")


def piecewise_hashes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every document and its edited text, and compare them with each other and with the next document's.

    Documents follow ``doc_id`` (nulls first, equal ids by a hash of their texts); after the last comes the first. The
    edited text has the last half of the code points replaced by as many from the start of the next document. Result,
    one row per input row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    A null text counts as empty and has the fingerprint ``1::``. A single document is its own next one. Repeated rows
    follow each other. Other columns are not read; an empty table gives an empty result. Texts cross the network once.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    docs = df.select(df[doc_id].alias("doc_id"), F.xxhash64(text_of(df[text])).alias("text_key"), text_of(df[text]).alias("text"))
    schema = (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches):
        powers = Powers()
        held: tuple | None = None

        def compare(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
            """rows: (text, fingerprint, next text, next fingerprint)."""
            digests, edited = [], []
            for text, _, following, _ in rows:
                half = len(text) // 2
                data = (text[: len(text) - half] + following[:half]).encode()
                digests.append(hashlib.sha256(data).hexdigest())
                edited.append(fingerprint(data, powers))
            own = [r[1] for r in rows]
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array(digests),
                    pa.array(own),
                    pa.array(edited),
                    pa.array(likeness(own, edited), pa.float64()),
                    pa.array(likeness(own, [r[3] for r in rows]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for whole in batches:
            for batch in slices(whole, 2):
                types = batch.schema.field(0).type
                ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                lasts = batch.column(4).to_pylist()
                rows, whose = [], []
                for key, text, last in zip(ids, texts, lasts):
                    mark = fingerprint(text.encode(), powers)
                    if held is not None:
                        rows.append((held[1], held[2], text, mark))
                        whose.append(held[0])
                    held = None if last else (key, text, mark)
                if rows:
                    yield compare(rows, pa.array(whose, types))

    return _with_next(docs).mapInArrow(run, schema)
