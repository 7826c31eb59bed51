"""URL filters: host and path rules, and a tree of path templates judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.shared import keep

# Down to this depth every segment is a step of the template; below it only where branches part are there more steps.
DEPTH = 6
# Only in the SQL, where smaller branches are always part of the wildcard.
MIN_PAGES = 20
# Branches whose purity is this many standard errors away from their siblings' stay apart.
Z = 3.0
# Labelled pages that a parent's purity counts for.
SMOOTHING = 8.0
MIN_PURITY = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` ("allow" or "block") for a host with all its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url, both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: Sequence[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(str(rule))).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def shapes_of(path: Column) -> Column:
    """The segments of a path; runs of digits are generalised."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "<n>"))


def _apart() -> Column:
    """Whether a branch's share of good labels (_g of _l) is far from that of all its node's branches (_ng of _nl)."""
    share = (F.col("_ng") + 1) / (F.col("_nl") + 2)
    return F.abs(F.col("_g") - F.col("_l") * share) > F.lit(Z) * F.sqrt(F.col("_l") * share * (1 - share))


def _smoothed() -> Column:
    return (F.col("_g") + F.col("purity") * SMOOTHING) / (F.col("_l") + SMOOTHING)


def template_tree(shapes: DataFrame) -> DataFrame:
    """From (host, shape, pages, labelled, good), one row each, to (host, shape, template, purity).

    Level by level below each host: the branches at a node are its pages' next segments. Branches whose share of good
    labels is within Z standard errors of all branches' are similar to them and merge into the wildcard; the others stay
    apart, however few pages they have. A node's purity is smoothed by its parent's, the host's by that of all hosts.
    Below DEPTH levels the rest of a path is one wildcard, until branches of it part (see ``_deeper``).
    """
    total = shapes.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    # One row: the share of good pages among all labelled ones, one half without labels.
    all_hosts = total.select(((F.coalesce("g", F.lit(0)) + 1) / (F.coalesce("l", F.lit(0)) + 2)).alias("_all"))
    host = shapes.groupBy("host").agg(F.sum("good").alias("_hg"), F.sum("labelled").alias("_hl"))
    host = host.join(F.broadcast(all_hosts), how="left", on=F.lit(True)).select(
        "host", ((F.col("_hg") + F.col("_all") * SMOOTHING) / (F.col("_hl") + SMOOTHING)).alias("purity")
    )
    tree = shapes.join(host, "host").withColumn("template", F.lit(""))
    for level in range(DEPTH + 1):
        # Paths that end above this level keep their template; they form a branch of their own.
        segment = F.get("shape", F.lit(level)) if level < DEPTH else F.when(F.size("shape") > DEPTH, F.lit("**"))
        tree = tree.withColumn("_segment", F.coalesce(segment, F.lit("")))
        branch = tree.groupBy("host", "template", "_segment").agg(F.sum("good").alias("_g"), F.sum("labelled").alias("_l"))
        node = branch.groupBy("host", "template").agg(F.sum("_g").alias("_ng"), F.sum("_l").alias("_nl"))
        branch = branch.join(node, ["host", "template"]).select(
            "host",
            "template",
            "_segment",
            "_g",
            "_l",
            F.when(F.col("_segment") == "", F.lit(""))
            .otherwise(F.concat(F.lit("/"), F.when(_apart(), F.col("_segment")).otherwise(F.lit("*"))))
            .alias("_step"),
        )
        merged = branch.groupBy("host", "template", "_step").agg(F.sum("_g").alias("_g"), F.sum("_l").alias("_l"))
        step = branch.select("host", "template", "_segment", "_step").join(merged, ["host", "template", "_step"])
        tree = tree.join(step, ["host", "template", "_segment"]).select(
            "host",
            "shape",
            "labelled",
            "good",
            F.col("template").alias("base"),
            F.concat("template", "_step").alias("template"),
            F.when(F.col("_step") == "", F.col("purity")).otherwise(_smoothed()).alias("purity"),
        )
        tree = keep(tree, "url-tree")
    return _deeper(tree).select("host", "shape", "template", "purity")


def _deeper(tree: DataFrame) -> DataFrame:
    """Part the branches below DEPTH levels, at any depth, with ``base`` as the template without the last wildcard.

    At each node all levels of its labelled pages are tried at once, those above taken for wildcards, and the first
    level with a branch that stays apart makes new nodes of its branches; levels without one change nothing. So there
    are as many rounds as branches part below each other, however long paths are, and unlabelled pages add none.
    """
    tree = tree.withColumn("at", F.lit(DEPTH))
    while True:
        # A path's end is a branch too, which counts among its node's but stays.
        rest = F.concat(F.slice("shape", F.col("at") + 1, F.size("shape")), F.array(F.lit("")))
        open_ = tree.where("size(shape) > at AND labelled > 0")
        cells = open_.select("host", "base", "good", "labelled", F.posexplode(rest).alias("_skip", "_segment"))
        branch = cells.groupBy("host", "base", "_skip", "_segment").agg(F.sum("good").alias("_g"), F.sum("labelled").alias("_l"))
        node = branch.groupBy("host", "base", "_skip").agg(F.sum("_g").alias("_ng"), F.sum("_l").alias("_nl"))
        named = branch.join(node, ["host", "base", "_skip"]).where(_apart() & (F.col("_segment") != ""))
        named = keep(named.select("host", "base", "_skip", "_segment", F.lit(True).alias("_named")), "url-branches")
        if named.isEmpty():
            return tree
        first = named.groupBy("host", "base").agg(F.min("_skip").alias("_skip"))
        level = F.col("at") + F.col("_skip")
        tree = tree.join(first, ["host", "base"], "left")
        tree = tree.withColumn("_segment", F.when(F.size("shape") > F.col("at"), F.get("shape", level)))
        tree = tree.join(named, ["host", "base", "_skip", "_segment"], "left")
        moves = F.col("_segment").isNotNull()
        step = F.concat(F.lit("/"), F.when(F.col("_named"), F.col("_segment")).otherwise(F.lit("*")))
        # What does not move is done.
        tree = tree.select(
            "host",
            "shape",
            "labelled",
            "good",
            "template",
            "purity",
            moves.alias("_moves"),
            F.when(moves, F.concat("base", F.repeat(F.lit("/*"), F.col("_skip")), step)).otherwise(F.col("base")).alias("base"),
            F.when(moves, level + 1).otherwise(F.size("shape")).alias("at"),
        )
        tree = keep(tree, "url-tree")
        sums = tree.where("_moves").groupBy("host", "base").agg(F.sum("good").alias("_g"), F.sum("labelled").alias("_l"))
        end = F.when(F.size("shape") > F.col("at"), F.lit("/*")).otherwise(F.lit(""))
        tree = tree.join(sums, ["host", "base"], "left").select(
            "host",
            "shape",
            "labelled",
            "good",
            "base",
            "at",
            F.when(F.col("_moves"), F.concat("base", end)).otherwise(F.col("template")).alias("template"),
            F.when(F.col("_moves"), _smoothed()).otherwise(F.col("purity")).alias("purity"),
        )
        tree = keep(tree, "url-tree")


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[UrlRule],
    page_id: str = "page_id",
    url: str = "url",
    label_id: str = "doc_id",
    good: str = "quality = 1 and toxic = 0",
    bad: str = "quality = 0 or toxic = 1",
) -> DataFrame:
    """Judge every url by the longest fitting rule, else by the purity of its host's path template.

    ``labels`` says for some page ids whether they are ``good`` or ``bad`` (SQL over its columns; neither where it is
    null, bad where rows disagree). A template whose smoothed share of good pages is below MIN_PURITY is rejected.
    Rules are compiled into one expression, so they should be some hundreds at most.

    Result, one row per input row: ``page_id``, ``host``, ``path``, ``rule`` (null where none fits), ``verdict``,
    ``template`` and ``purity``. Null urls and urls without ``://`` have an empty host and path and are judged like any
    other by the template of the empty host. Null ids have no label. Repeated rows are judged alike and counted each.
    Other columns are not read. Only distinct shapes of a host's paths go through the tree, so a host that holds a large
    part of all rows is summed before the shuffle.
    """
    host, path = host_and_path(F.col(url))
    kind = F.when(F.expr(bad), F.lit(0)).when(F.expr(good), F.lit(1))
    marks = labels.select(F.col(label_id).alias("_label_id"), kind.alias("_good")).where("_good is not null")
    marks = marks.groupBy("_label_id").agg(F.min("_good").alias("_good"))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", shapes_of(F.col("path")))
    marked = rows.join(marks, F.col("page_id") == F.col("_label_id"), "left")
    shapes = marked.groupBy("host", "shape").agg(
        F.count("*").alias("pages"),
        F.count("_good").alias("labelled"),
        F.coalesce(F.sum("_good"), F.lit(0)).cast("bigint").alias("good"),
    )
    tree = template_tree(keep(shapes, "url-shapes"))
    text, verdict = rule_of(rules, F.col("host"), F.col("path"))
    learned = F.when(F.col("purity") < MIN_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(tree, ["host", "shape"], "left").select(
        "page_id",
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(verdict, learned).alias("verdict"),
        "template",
        "purity",
    )
