"""Mixing overlapping sources to target weights, as a min-cost flow over membership patterns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docsieve.llm.shared import keep, text_of, word_count
from docsieve.llm.simhash import components
from docsieve.operators.scroll import numbered

BINS = 1024


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], repeats: int = 2):
    """Words that each pattern sends to each of its sources, as {(pattern, source): words}.

    Pattern p offers ``capacity[p]`` words ``repeats`` times, the k-th time at cost k * k, so that a second use is only
    made where first uses run out. The cost of a path is that of its first step, as no path leads back to the start. So
    shortest paths come level by level: all of one use, as a maximal flow, before any of the next.
    """
    source, first, sink = 0, 1 + len(capacity), 1 + len(capacity) + len(quota)
    steps: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, words: int) -> int:
        steps[a].append(len(to))
        steps[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((words, 0))
        return len(to) - 2

    offers = [link(source, 1 + p, 0) for p in range(len(capacity))]
    routes = {(p, s): link(1 + p, first + s, int(capacity[p]) * repeats) for p in range(len(capacity)) for s in members[p]}
    for s, words in enumerate(quota):
        link(first + s, sink, int(words))
    for _ in range(repeats):
        for p, offer in enumerate(offers):
            room[offer] += int(capacity[p])
        while _send(steps, to, room, source, sink):
            pass
    return {route: room[step + 1] for route, step in routes.items() if room[step + 1]}


def _send(steps: Sequence[Sequence[int]], to: Sequence[int], room: list[int], source: int, sink: int) -> bool:
    """Send as much as goes along the shortest paths that have room; whether there was one."""
    depth = [-1] * len(steps)
    depth[source] = 0
    front = [source]
    while front and depth[sink] < 0:
        reached = []
        for a in front:
            for step in steps[a]:
                if room[step] and depth[to[step]] < 0:
                    depth[to[step]] = depth[a] + 1
                    reached.append(to[step])
        front = reached
    if depth[sink] < 0:
        return False
    tried = [0] * len(steps)
    path: list[int] = []
    here = source
    while True:
        if here == sink:
            words = min(room[step] for step in path)
            for step in path:
                room[step] -= words
                room[step ^ 1] += words
            full = next(i for i, step in enumerate(path) if not room[step])
            here = to[path[full] ^ 1]
            del path[full:]
        elif tried[here] < len(steps[here]):
            step = steps[here][tried[here]]
            if room[step] and depth[to[step]] == depth[here] + 1:
                path.append(step)
                here = to[step]
            else:
                tried[here] += 1
        elif here == source:
            return True
        else:
            here = to[path.pop() ^ 1]
            tried[here] += 1


def _bin(level: int) -> Column:
    """The position of a document in the seeded order, as one of BINS bins of the given level."""
    return F.shiftrightunsigned("_order", 54 - 10 * level).bitwiseAND(F.lit(BINS - 1)).cast("int")


def _cut_bins(docs: DataFrame, bin_: Column, name: str, *found: str) -> DataFrame:
    """Per pattern the bin in which the sum of sizes passes ``_want``, and what is wanted inside it."""
    sums = docs.groupBy("_spelled", *found, "_want", bin_.alias(name)).agg(F.sum("_size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_spelled").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_before", upto - F.col("_sum"))
    here = sums.where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_sum") >= F.col("_want")))
    return keep(here.select("_spelled", *found, name, (F.col("_want") - F.col("_before")).alias("_want")), "mix-bins")


def _cuts(docs: DataFrame, want: DataFrame) -> DataFrame:
    """(_spelled, _cut): per pattern the place in the seeded order up to which documents are taken.

    Bins of the order are summed; only the bin in which the sum passes what is wanted is looked into, in bins again and
    at last document by document. That last bin holds one in BINS * BINS of a pattern's documents, so no group of
    documents meets in a task.
    """
    outer = _cut_bins(docs.join(want, "_spelled"), _bin(0), "_b0")
    inner = _cut_bins(docs.join(outer, "_spelled").where(F.col("_b0") == _bin(0)), _bin(1), "_b1", "_b0")
    last = docs.join(inner, "_spelled").where((F.col("_b0") == _bin(0)) & (F.col("_b1") == _bin(1)))
    last = last.groupBy("_spelled", "_want", "_order").agg(F.sum("_size").alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy("_spelled").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("_upto", upto)
    # The document on the border is taken if that comes nearer to what is wanted.
    near = F.col("_upto") - F.col("_want") <= F.col("_want") - (F.col("_upto") - F.col("_size"))
    # Orders are not negative, so the place before the first may be -1.
    taken = F.coalesce(F.max(F.when(near, F.col("_order"))), F.min("_order") - 1)
    return last.groupBy("_spelled").agg(taken.alias("_cut"))


def _targets(sources: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """``sources`` with ``_target``: ``total`` is shared by weight, a share stops at ``most`` times its source's size, and
    the excess is shared again among the others. If every source is full, the rest of the total stays unused.

    ``sources`` are numbered by ``_place`` from 1, and get the weights in turn. Sharing again only raises the shares, so
    each round is a sum over all sources, and two numbers reach the driver.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights)).cast("int"))
    bound = F.col("_source_size") * F.lit(float(most))
    sources = sources.withColumn("_weight", weight)

    def shared(left: float, by: float) -> Column:
        return F.lit(left) * F.col("_weight") / F.lit(by) if by else F.lit(float("inf"))

    def sums(full: Column):
        row = sources.where("_weight > 0").agg(
            F.sum(F.when(full, bound)).alias("bounds"), F.sum(F.when(~full, F.col("_weight"))).alias("by"), F.count_if(full).alias("full")
        )
        found = row.first()
        return total - (found["bounds"] or 0.0), found["by"] or 0.0, found["full"]

    left, by, full = sums(F.lit(False))
    while by:
        again = sums(shared(left, by) > bound)
        if again[2] <= full:
            break
        left, by, full = again
    target = F.when(F.col("_weight") > 0, F.least(shared(left, by), bound)).otherwise(0.0)
    return sources.withColumn("_target", target).drop("_weight")


def _flows(group: pa.Table) -> pa.Table:
    """The words routed from the patterns of one component; ``_quotas`` are the names and quotas of their sources."""
    group = group.sort_by("_spelled")
    patterns = group.column("_quotas").to_pylist()
    quotas = {q["name"]: q["quota"] for pattern in patterns for q in pattern}
    place = {name: i for i, name in enumerate(sorted(quotas))}
    members = [[place[q["name"]] for q in pattern] for pattern in patterns]
    flow = min_cost_flow(group.column("_capacity").to_pylist(), members, [quotas[name] for name in sorted(quotas)])
    routed = [0] * len(patterns)
    for (p, _), words in flow.items():
        routed[p] += words
    return pa.table({"_spelled": group.column("_spelled"), "_routed": pa.array(routed, pa.int64())})


def _routes(patterns: DataFrame) -> DataFrame:
    """(_spelled, _routed): the words that the flow takes from each pattern, from its ``_capacity`` and ``_quotas``.

    Sources that share no document have flows of their own. A source that shares none at all takes what its one pattern
    has, at most twice; the others are put into components, and the flow of each is found in one task, from a row per
    pattern of it.
    """
    joint = patterns.where("size(_quotas) > 1").select(F.col("_quotas")[0]["name"].alias("a"), F.explode("_quotas.name").alias("b"))
    alone = F.least(F.col("_quotas")[0]["quota"], F.col("_capacity") * 2).alias("_routed")
    if joint.isEmpty():
        return patterns.where("size(_quotas) > 0").select("_spelled", alone)
    roots = components(joint)
    roots = roots.union(roots.select("root", "root")).distinct()
    found = patterns.where("size(_quotas) > 0").join(roots, F.col("_quotas")[0]["name"] == F.col("node"), "left")
    shared = found.where("root is not null").select("_spelled", "_capacity", "_quotas", "root")
    flows = shared.groupBy("root").applyInArrow(_flows, "_spelled string, _routed bigint")
    return found.where("root is null").select("_spelled", alone).union(flows)


def _placed(df: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """``df`` with the spelled-out membership pattern, the size and the place in the seeded order of each row."""
    names = F.col(source)
    if not isinstance(df.schema[source].dataType, T.ArrayType):
        names = F.array(names.cast("string"))
    names = F.array_sort(F.array_distinct(F.coalesce(names.cast("array<string>"), F.array().cast("array<string>"))))
    return df.withColumns(
        {
            # Patterns are joined by their text, as null is a name too and = knows no null.
            "_spelled": F.to_json(F.struct(names.alias("s")), {"ignoreNullFields": "false"}),
            "_size": word_count(text_of(text)),
            "_order": F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1),
        }
    )


@dataclass(frozen=True)
class Mix:
    """What a mix has decided: a table with a row per membership pattern."""

    rows: DataFrame
    doc_id: str
    text: str
    source: str
    seed: int

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with columns ``_size``, ``_times``, ``_sources``, ``_source_sizes`` and ``_targets``.

        Spark knows the size of the stored patterns, and sends them to all tasks if they are few.
        """
        placed = _placed(df, self.doc_id, self.text, self.source, self.seed).join(self.rows, "_spelled", "left")
        more = F.coalesce((F.col("_order") <= F.col("_cut")).cast("int"), F.lit(0))
        return placed.withColumn("_times", F.coalesce("_uses", F.lit(0)) + more).drop("_spelled", "_order", "_uses", "_cut")


def plan_mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> Mix:
    """Decide how often each document is used so that every source comes near its target number of words.

    ``source`` holds a name or an array of names, as sources may overlap; a null name is a source of its own, a null or
    empty array belongs to none and is never taken. Sources in code point order (null last) get ``weights`` in turn and
    share ``share`` times the words of all documents; a target stops at ``most`` (at most 2) times its source's size.
    Documents are summed by membership pattern, the flow routes the patterns' words to the sources, second uses only
    after first ones, and seeded documents are chosen pattern by pattern, always whole. Patterns and sources are tables
    of any size; only sources that are linked by shared documents meet in one task.

    The order depends on id, text and seed alone, so reruns agree. Rows equal in id and text stand at the same place and
    are taken together. A null text has no words.
    """
    docs = _placed(df.select(doc_id, text, source), doc_id, text, source, seed).select("_spelled", "_size", "_order")
    docs = keep(docs, "mix-sizes")
    patterns = keep(docs.groupBy("_spelled").agg(F.sum("_size").alias("_capacity")), "mix-patterns")
    names = F.from_json("_spelled", "s array<string>")["s"]
    links = patterns.select("_spelled", "_capacity", F.posexplode(names).alias("_at", "_source"))
    links = links.withColumn("_name", F.to_json(F.struct("_source"), {"ignoreNullFields": "false"}))
    sources = links.groupBy("_name", "_source").agg(F.sum("_capacity").alias("_source_size"))
    sources = numbered(sources.orderBy(F.col("_source").asc_nulls_last()), "_place").drop("_source")
    total = share * (patterns.agg(F.sum("_capacity")).first()[0] or 0)
    sources = _targets(sources, weights, total, most)
    # The members of a pattern, in their order.
    member = F.struct("_at", "_source", "_source_size", "_target", "_name", F.rint("_target").cast("bigint").alias("_quota"))
    members = links.join(sources, "_name").groupBy("_spelled", "_capacity").agg(F.array_sort(F.collect_list(member)).alias("m"))
    quotas = F.transform("m", lambda m: F.struct(m["_name"].alias("name"), m["_quota"].alias("quota")))
    members = keep(members.withColumn("_quotas", quotas), "mix-members")
    routed = keep(members.join(_routes(members), "_spelled").where("_capacity > 0"), "mix-routes")
    uses = F.expr("_routed div _capacity")
    want = routed.select("_spelled", (F.col("_routed") - uses * F.col("_capacity")).alias("_want")).where("_want > 0")
    rows = routed.join(_cuts(docs, want), "_spelled", "left").select(
        "_spelled", uses.cast("int").alias("_uses"), "_cut", *[F.col(f"m.{c}").alias(f"{c}s") for c in ("_source", "_source_size", "_target")]
    )
    # Patterns without words are never taken, but have sources like others.
    empty = members.where("_capacity = 0").select(
        "_spelled", F.lit(0).alias("_uses"), F.lit(None).cast("bigint").alias("_cut"),
        *[F.col(f"m.{c}").alias(f"{c}s") for c in ("_source", "_source_size", "_target")],
    )
    return Mix(keep(rows.union(empty), "mix"), doc_id, text, source, seed)


def mix_sources(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """How often each document is used, by `plan_mix`.

    One result row per input row: ``doc_id``, ``sources``, ``size`` (words), ``source_sizes``, ``targets`` (an entry per
    source the row belongs to), ``times`` and ``taken`` (words the mix takes, repeats counted). Null ids are ids; an
    empty table gives an empty result; other columns are not read.
    """
    mixed = plan_mix(df, doc_id, text, source, **how).apply(df.select(doc_id, text, source))
    return mixed.select(
        F.col(doc_id).alias("doc_id"),
        F.col("_sources").alias("sources"),
        F.col("_size").alias("size"),
        F.col("_source_sizes").alias("source_sizes"),
        F.col("_targets").alias("targets"),
        F.col("_times").alias("times"),
        (F.col("_size") * F.col("_times")).alias("taken"),
    )


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix with all their columns, a document used twice as two rows."""
    # The columns travel as one, so that no name can clash.
    rows = df.select(F.struct("*").alias("row"), df[doc_id].alias("doc_id"), df[text].alias("text"), df[source].alias("source"))
    mixed = plan_mix(rows, "doc_id", "text", "source", **how).apply(rows).where("_times > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("row.*")
