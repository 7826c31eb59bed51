"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.shared import SPACE, WORD_CLASS, text_of, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by at from this or an not have has "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch in "
    "de la le les et des en un une du que est pour dans par au sur ne se pas plus avec "
    "el los las del y al lo su una con por para es no como más o"
)


@dataclass(frozen=True)
class Rule:
    """A document is rejected if ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# The measures are SQL over the counts of `measured`; all are ratios, so that the length of a text does not matter.
RULES = (
    Rule("word_length", "word_chars / n_words", least=2.0, most=14.0),
    Rule("symbols", "n_symbols / n_words", most=0.1),
    Rule("stop_words", "n_stop_words / n_words", least=0.04),
    Rule("repeated_lines", "n_dup_lines / n_lines", most=0.7),
    Rule("open_lines", "n_open_lines / n_lines", most=0.9),
    Rule("shouting", "n_shouted / n_words", most=0.5),
)


def measured(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: its id and the counts that the rules use.

    The words are a column of their own below the counts, so that the text is split once; the rest is one projection.
    """
    stop = [w for word in dict.fromkeys(STOP_WORDS.split()) for w in (word, word.capitalize())]
    body = F.col("_text")
    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text"))
    rows = rows.select(
        "doc_id",
        "_text",
        words_of(body).alias("_words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD_CLASS)).alias("_lines"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    rows = rows.withColumn("_hashes", F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    # Only texts in which some window comes back have their windows sorted.
    hashes = F.col("_hashes")
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    rows = rows.withColumn("_windows", F.when(repeats, placed))
    seen = F.col("_windows")
    again = F.filter(
        seen,
        lambda x, i: (F.get(seen, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(seen, i - 1)["h"] == x["h"])),
    )
    within = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    counts = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.translate(body, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.when(seen.isNotNull(), F.size(F.array_distinct(within))).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(lines, lambda line: line.rlike(r"(\.\.\.|…)[ \t-\r]*\z"))).cast("bigint").alias("n_open_lines"),
        F.size(F.filter(words, lambda w: w.isin(stop))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: w.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$")))
        .cast("bigint")
        .alias("n_shouted"),
    )
    # Unpacked from an array of one: a filter on the counts then stays above them. Else Spark would move it down and
    # put the splitting of the text into the functions of each single word.
    return rows.select("doc_id", F.inline(F.array(counts)))


def verdict(rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Whether a measured document fails the base rules, and whether it is kept."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    kept = ~base
    for rule in rules:
        value = F.expr(rule.measure.replace("/", "/ nullif(") + ", 0)") if "/" in rule.measure else F.expr(rule.measure)
        if rule.least is not None:
            kept &= F.coalesce(value >= F.lit(rule.least), F.lit(False))
        if rule.most is not None:
            kept &= F.coalesce(value <= F.lit(rule.most), F.lit(False))
    return base, kept


def quality_rules(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Judge every document by a table of thresholds, without user functions and without a shuffle.

    A null text counts as empty and has no words, so it fails the base rules. Every row is judged by itself: repeated
    rows and repeated or null ids give one result row each. Other columns of the input are not read. Words in repeated
    three-word windows are found by sorting the windows' 64-bit hashes within the text.

    The stop words are English, German, French and Spanish, and ``word_length`` counts words between blanks: nearly all
    clean documents in other languages, or in scripts without blanks, are rejected. Give ``rules`` of your own for those.
    """
    base, kept = verdict(rules)
    return measured(df, doc_id, text).withColumn("base_failed", base).withColumn("kept", kept)


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` whose text the rules keep, with all their columns."""
    rows = df.select(F.struct("*").alias("row"), text_of(text).alias("text"))
    base, kept = verdict(rules)
    return measured(rows, "row", "text").where(kept).select("doc_id.*")
