"""Heads, hit fragments and highlighting of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import ENDS_WORD, JOINER, WORD_CHAR, Leaf, any_true, labelled, words
from docsieve.schema import Snippet, fields_of

OPEN, CLOSE = "<em>", "</em>"
BETWEEN = " ... "
# Control characters that stand for the marks while a text is cut up.
_START, _END = "\u0002", "\u0003"


def _hits(text: Column, queries, field: str | None) -> Column | None:
    """Case-insensitive pattern for all positive leaves that ask a field; longer ones first, so phrases win.

    It is the same for all rows, unless a leaf is about words that only the text itself can tell (/regex/, word~1).
    Null where nothing can be a hit.
    """
    leaves = [leaf for q in labelled(queries).values() for leaf in q.leaves(field)]
    fixed = sorted({p for leaf in leaves if (p := leaf.pattern())}, key=lambda p: (-len(p), p))
    tested = [leaf for leaf in leaves if type(leaf).fits is not Leaf.fits]
    if not tested:
        return F.lit(f"(?iu)(?:{'|'.join(fixed)})") if fixed else None
    fitting = F.array_distinct(F.filter(words(text), lambda w: any_true(leaf.fits(w) for leaf in tested)))

    def border(word: Column) -> Column:
        plain = F.replace(word, F.lit("."), F.lit("\\."))
        before = [F.lit(f"(?<!{WORD_CHAR}"), plain, F.lit(f")(?<!{WORD_CHAR}{JOINER}"), plain, F.lit(")" + ENDS_WORD)]
        return F.concat(plain, *before)

    every = F.concat(F.array(*map(F.lit, fixed)).cast("array<string>"), F.transform(fitting, border))
    return F.when(F.size(every) > 0, F.concat(F.lit("(?iu)(?:"), F.array_join(every, "|"), F.lit(")")))


def _replace_hits(text: Column, queries, field: str | None, replacement: str) -> Column:
    pattern = _hits(text, queries, field)
    if pattern is None:
        return text
    return F.coalesce(F.regexp_replace(text, pattern, F.lit(replacement)), text)


def highlight(text: Column, queries, field: str | None = None) -> Column:
    """Wrap each hit in marks; the whole word for a prefix, the whole phrase for a phrase."""
    return _replace_hits(text, queries, field, f"{OPEN}$0{CLOSE}")


def highlight_merge(text: Column) -> Column:
    """Join marks that only a blank separates."""
    return F.replace(text, F.lit(f"{CLOSE} {OPEN}"), F.lit(" "))


def highlight_strip(text: Column) -> Column:
    """Remove all marks."""
    return F.replace(F.replace(text, F.lit(OPEN)), F.lit(CLOSE))


def snippet_head(text: Column, chars: int) -> Column:
    """The first ``chars`` characters, plus the rest of the word that stands at the cut."""
    rest = F.regexp_extract(F.substring(text, chars + 1, 2**31 - 1), rf"^(?:{WORD_CHAR}+|(?s:.))", 0)
    return F.concat(F.substring(text, 1, chars), rest)


def _head_of(text: Column, chars: int) -> Column:
    """At most ``chars`` characters from the start, without a word that the cut would break."""
    cut = F.regexp_replace(F.substring(text, 1, chars + 1), rf"(?:{WORD_CHAR}+|(?s:.))\z", "")
    return F.when(F.length(text) <= chars, text).otherwise(cut)


def _tail_of(text: Column, chars: int) -> Column:
    """At most ``chars`` characters from the end, without a word that the cut would break."""
    cut = F.regexp_replace(F.right(text, F.lit(chars + 1)), rf"^(?:{WORD_CHAR}+|(?s:.))", "")
    return F.when(F.length(text) <= chars, text).otherwise(cut)


def fragments(
    text: Column, queries, size: int, most: int, mark: bool = False, field: str | None = None
) -> Column:
    """The first ``most`` hits, each with up to half of ``size`` characters on either side.

    Fragments never overlap: what follows one hit is not shown again before the next.
    """
    side = max(size // 2, 1)
    clean = F.translate(text, _START + _END, "")
    # The text is searched once; everything else works on the parts around the first hits.
    parts = F.split(_replace_hits(clean, queries, field, f"{_START}$0{_END}"), _START, most + 2)

    def fragment(part: Column, at: Column, parts: Column) -> Column:
        before = F.substring_index(F.get(parts, at), _END, -1)
        shown = F.when(at == 0, F.lit(0)).otherwise(F.length(_head_of(before, side)))
        left = _tail_of(F.substring(before, shown + 1, F.length(before)), side)
        hit = F.substring_index(part, _END, 1)
        right = _head_of(F.substring_index(part, _END, -1), side)
        return F.trim(F.concat(left, F.concat(F.lit(OPEN), hit, F.lit(CLOSE)) if mark else hit, right))

    # The one-element array binds the parts, so that they are made once per row.
    bound = F.transform(
        F.array(parts), lambda p: F.transform(F.slice(p, 2, most), lambda part, at: fragment(part, at, p))
    )
    return F.get(bound, 0)


def snippet(
    text: Column, params: Snippet, queries=None, mark: bool = False, field: str | None = None
) -> Column:
    """Fragments around the hits, or the head where there are none (or none are wanted)."""
    head = snippet_head(text, params.nomatch_chars)
    if params.max_matches == 0 or not labelled(queries):
        return head
    joined = F.array_join(fragments(text, queries, params.match_chars, params.max_matches, mark, field), BETWEEN)
    return F.coalesce(F.nullif(joined, F.lit("")), head)


def present(
    df: DataFrame, fields: dict[str, Snippet | None], queries=None, mark: bool = False
) -> list[Column]:
    """Columns for output: snippets where asked for, marks where wanted, values as they are elsewhere."""
    declared = fields_of(df)
    columns = []
    for name, params in fields.items():
        kind = declared[name].type if name in declared else None
        value = F.col(name)
        if params is not None:
            if kind not in ("text", "keyword"):
                raise ValueError(f"{name!r} is not a text and has no snippets")
            value = snippet(value, params, queries, mark, name)
        elif mark and kind == "text":
            value = highlight(value, queries, name)
        columns.append(value.alias(name))
    return columns
