"""SimHash near-duplicates, found with a covering family of bit masks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.shared import arrow_map, keep, text_of

BITS = 64
SEED = 42
# Buckets up to this size are compared pair by pair inside the task; larger ones by the balls around their members.
PAIRS_UP_TO = 512


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """Majority vote of the 64-bit hashes of a text's shingles, repeats included; zero without words."""
    # bytes.lower() and bytes.split() know just A-Z and the six white space characters.
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), seed)]
    else:
        joined, size = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    values = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 4096):
        bits = np.unpackbits(values[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, doc_id: str, text: str, words: int = 3, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key`` (a hash of the text) and ``print`` (the fingerprint, signed)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_key", "print"])

        return work

    rows = df.select(df[doc_id].alias("doc_id"), F.xxhash64(text_of(text)).alias("text_key"), text_of(text).alias("text"))
    return arrow_map(rows, f"doc_id {kind}, text_key bigint, print bigint", each)


def covering_masks(radius: int, bits: int = BITS, seed: int = SEED) -> list[int]:
    """Masks such that any two values that differ in at most ``radius`` bits agree under one of them at least.

    Each bit position gets a random vector of ``radius + 1`` bits; the mask of a nonzero vector v holds the positions
    whose vectors have an odd inner product with v. The at most ``radius`` vectors of the differing positions span less
    than the whole space, so some v is orthogonal to all of them and its mask holds none of the differing positions.
    """
    dice = random.Random(seed)
    vectors = [dice.randrange(1 << (radius + 1)) for _ in range(bits)]
    return [
        sum(1 << i for i, vector in enumerate(vectors) if bin(vector & v).count("1") % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _small_links(members: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets of bounded size: per bucket a forest that joins what the pairs within the radius join."""

    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = [], []
            for row in batch.column(0):
                values = np.sort(np.array(row.as_py(), np.int64))
                near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= radius
                left = np.arange(len(values))
                # Breadth-first search over the bucket, from the smallest value on.
                todo = set(range(len(values)))
                while todo:
                    start = min(todo)
                    todo.discard(start)
                    front = [start]
                    while front:
                        one = front.pop()
                        for other in left[near[one]]:
                            if other in todo:
                                todo.discard(int(other))
                                front.append(int(other))
                                a.append(values[one])
                                b.append(values[other])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return work

    return arrow_map(members, "a bigint, b bigint", each)


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links through the points at most one bit away from each value, exact and without pairs.

    Two values within two bits share such a point, so each point's values are tied to the smallest of them. For a
    radius of one, a point has to be a value itself.
    """
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    points = prints.select("print", F.explode(F.transform(flips, lambda m: F.col("print").bitwiseXOR(m))).alias("point"))
    if radius == 1:
        return points.join(prints.select(F.col("print").alias("point")), "point").select(
            F.col("point").alias("a"), F.col("print").alias("b")
        )
    centre = points.groupBy("point").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1")
    return points.join(centre, "point").where("print != a").select("a", F.col("print").alias("b"))


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``radius`` bits. ``prints``: distinct values.

    Per mask, values that agree under it share a bucket. Buckets of up to PAIRS_UP_TO values are compared within the
    task and give at most one link per value. The values of larger buckets are linked through the points one bit away:
    65 rows a value, however large the bucket.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    keyed = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(keyed.join(sizes, ["mask", "key"]), "simhash-buckets")
    small = shared.where(F.col("n") <= PAIRS_UP_TO).groupBy("mask", "key").agg(F.collect_list("print").alias("prints"))
    large = shared.where(F.col("n") > PAIRS_UP_TO).select("print").distinct()
    return _small_links(small.select("prints"), radius).union(_ball_links(large, radius)).distinct()


def components(links_: DataFrame) -> DataFrame:
    """(node, root) for every node of the links, the root being the smallest node that can be reached.

    Stars are alternated: every node's larger neighbours are tied to its smallest one, then its smaller neighbours.
    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = keep(links_.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        wide = keep(wide.where("a != b").distinct(), "wide-star")
        # Now tie each node's smaller neighbours, and itself, to the smallest of them.
        low = wide.groupBy("b").agg(F.min("a").alias("m"))
        near = wide.join(low, "b")
        narrow = near.select(F.col("m").alias("x"), F.col("a").alias("y")).union(near.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = keep(narrow.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "narrow-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, seed: int = SEED
) -> DataFrame:
    """Group documents whose fingerprints are linked by steps of at most ``radius`` (0 to 2) differing bits.

    Result, one row per input row: ``doc_id``, ``text_key`` (a hash of the text that tells rows with one id apart),
    ``fingerprint`` (16 hexadecimal digits), ``component_id`` (the smallest id in the group) and ``representative``
    (true for one row, or rows equal in id and text, of each group).

    Null and empty texts have the fingerprint zero and are linked like any other. Null ids are passed over by the
    smallest id unless a group has no other. Equal fingerprints are folded before any bucket is made. Other columns are
    not read, an empty table gives an empty result.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be 0, 1 or 2")
    docs = keep(fingerprints(df, doc_id, text, words, seed), "simhash")
    # Smallest id and first row of each fingerprint, ids before null.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    prints = keep(docs.groupBy("print").agg(first.alias("first")), "simhash-prints")
    if radius:
        roots = components(links(prints.select("print"), radius))
        prints = prints.join(roots, F.col("print") == F.col("node"), "left").select(
            "print", "first", F.coalesce("root", "print").alias("root")
        )
        least = prints.groupBy("root").agg(F.min("first").alias("group"))
        prints = prints.join(keep(least, "simhash-groups"), "root").select("print", "group")
    else:
        prints = prints.select("print", F.col("first").alias("group"))
    # Kept, as Spark can split the rows of a frequent fingerprint only in a join of tables.
    prints = keep(prints, "simhash-members")
    same = docs["doc_id"].eqNullSafe(F.col("group.id")) & (F.col("text_key") == F.col("group.key"))
    return docs.join(prints, "print").select(
        "doc_id",
        "text_key",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("group.id").alias("component_id"),
        same.alias("representative"),
    )



def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with all their columns, one of each group of near-duplicates: that with the smallest id."""
    chosen = near_duplicates(df, doc_id, text, **how).where("representative")
    chosen = keep(chosen.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")), "simhash-chosen")
    # The columns travel as one, so that no name can clash.
    rows = df.select(F.struct("*").alias("row"), df[doc_id].alias("id"), F.xxhash64(text_of(df[text])).alias("key"))

    def matching(some: DataFrame) -> DataFrame:
        return rows.join(some, some["doc_id"].eqNullSafe(rows["id"]) & (some["text_key"] == rows["key"]))

    found = matching(chosen.where("n = 1")).select("row.*")
    several = chosen.where("n > 1")
    if not several.isEmpty():
        # Rows equal in id and text: one of them stays.
        found = found.unionByName(matching(several).dropDuplicates(["id", "key"]).select("row.*"))
    return found
