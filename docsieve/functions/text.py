"""Word splitting and word queries over text, keyword and tag columns.

A query is a small tree of predicates (``Word``, ``Prefix``, ``Phrase`` ... joined by ``&``, ``|``, ``~``)
that compiles to one Boolean Column. On text, a leaf first asks for the plain substring, which is cheap and
rules out most rows, and only then checks word borders with a pattern.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.schema import KEYWORD_LIKE, fields_of, mark_words, words_columns

# A word is a run of letters, marks, digits and underscores, which may hold single
# apostrophes or full stops inside.
WORD_CHAR = r"[\p{L}\p{M}\p{N}_]"
GAP_CHAR = r"[^\p{L}\p{M}\p{N}_]"
JOINER = "['’.]"
WORD = f"{WORD_CHAR}+(?:{JOINER}{WORD_CHAR}+)*"

# From this many leaves on, the lower-cased text is bound once per row instead of once per leaf.
_BIND_FROM = 2
# From this many leaves on, splitting a text into words once is cheaper than searching it for each leaf.
_SPLIT_FROM = 16
# So many labels are sent to all executors at most.
MAX_SENT_LABELS = 100_000


def words(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalise(text: Column) -> Column:
    """Words joined and surrounded by single blanks, so that word tests become substring tests."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def store_words(df: DataFrame, text_field: str) -> DataFrame:
    """Add the normalised text as a column; queries then use it instead of splitting the text again."""
    column = f"{text_field}__words"
    return mark_words(df.withColumn(column, normalise(F.col(text_field))), column, text_field)


def words_of(text: str) -> list[str]:
    """``words`` for a Python string, used on query terms."""

    def inside(char: str) -> bool:
        return char == "_" or unicodedata.category(char)[0] in "LMN"

    text = text.lower()
    found, current = [], ""
    for i, char in enumerate(text):
        joins = char in "'’." and current and i + 1 < len(text) and inside(text[i + 1])
        if inside(char) or joins:
            current += char
        elif current:
            found.append(current)
            current = ""
    return found + [current] if current else found


def quote(literal: str) -> str:
    """A literal inside a Java pattern."""
    return re.escape(literal)


def starts_word(literal: str) -> str:
    """Pattern for a literal at the start of a word. The literal leads, so the engine can search for it fast."""
    lit = quote(literal)
    return f"{lit}(?<!{WORD_CHAR}{lit})(?<!{WORD_CHAR}{JOINER}{lit})"


ENDS_WORD = f"(?!{WORD_CHAR})(?!{JOINER}{WORD_CHAR})"
REST_OF_WORD = f"{WORD_CHAR}*(?:{JOINER}{WORD_CHAR}+)*"


def whole_word(word: str) -> str:
    return starts_word(word) + ENDS_WORD


def word_sequence(sequence: Sequence[str]) -> str:
    between = f"(?!{JOINER}{WORD_CHAR}){GAP_CHAR}++"
    head, *tail = sequence
    return between.join([starts_word(head), *(quote(w) for w in tail)]) + ENDS_WORD


@dataclass(frozen=True)
class Subject:
    """One searchable column as a leaf sees it."""

    kind: str  # text, keyword, tag or other
    value: Column
    lower: Column | None = None
    stored: Column | None = None
    # The condition of a field filter, for fields of other kinds.
    filtered: Callable[[object], Column] | None = None

    def words(self) -> Column:
        if self.stored is not None:
            return F.split(F.trim(self.stored), " ")
        return F.regexp_extract_all(self.lower, F.lit(WORD), F.lit(0))

    def joined(self) -> Column:
        if self.stored is not None:
            return self.stored
        return F.concat(F.lit(" "), F.array_join(self.words(), " "), F.lit(" "))

    def may_hold(self, pieces: Iterable[str]) -> Column:
        """Cheap necessary condition: the text holds each piece somewhere."""
        haystack = self.stored if self.stored is not None else self.lower
        return all_true(haystack.contains(p) for p in dict.fromkeys(pieces) if p)


def all_true(conditions: Iterable[Column]) -> Column:
    return _fold(list(conditions), lambda a, b: a & b, True)


def any_true(conditions: Iterable[Column]) -> Column:
    return _fold(list(conditions), lambda a, b: a | b, False)


def _fold(conditions: Sequence[Column], join, empty: bool) -> Column:
    """Joined pair by pair, as Spark cannot plan a chain of a thousand conditions."""
    if not conditions:
        return F.lit(empty)
    while len(conditions) > 1:
        pairs = [conditions[i : i + 2] for i in range(0, len(conditions), 2)]
        conditions = [join(*pair) if len(pair) == 2 else pair[0] for pair in pairs]
    return conditions[0]


class Query:
    """Base of the predicate tree."""

    def __and__(self, other: Query) -> Query:
        return AllOf((self, other))

    def __or__(self, other: Query) -> Query:
        return AnyOf((self, other))

    def __invert__(self) -> Query:
        return NoneOf((self,))

    def column(self, subjects: Mapping[str, Subject]) -> Column:
        raise NotImplementedError

    def leaves(self, field: str | None = None) -> list[Leaf]:
        """Leaves whose hits may be marked in a field (or, without one, in any text)."""
        return []

    def size(self) -> int:
        return 1


class Leaf(Query):
    def column(self, subjects: Mapping[str, Subject]) -> Column:
        tests = {"text": self.on_text, "keyword": self.on_keyword, "tag": self.on_tag, "other": self.on_other}
        found = []
        for s in subjects.values():
            test = tests[s.kind](s)
            # Tests of plain values stay as they are, so that they reach the scan.
            found.append(s.value.isNotNull() & test if s.kind == "other" else F.coalesce(test, F.lit(False)))
        return any_true(found)

    def leaves(self, field: str | None = None) -> list[Leaf]:
        return [self]

    def on_text(self, subject: Subject) -> Column:
        raise NotImplementedError

    def keyword_test(self, value: Column) -> Column:
        raise NotImplementedError

    def on_keyword(self, subject: Subject) -> Column:
        return self.keyword_test(subject.value)

    def on_tag(self, subject: Subject) -> Column:
        return F.exists(subject.value, self.keyword_test)

    def on_other(self, subject: Subject) -> Column:
        """Test of a number, date or truth value."""
        raise ValueError(f"{type(self).__name__} looks for words, and the field has none")

    def pattern(self) -> str | None:
        """Java pattern of a hit in running text, or None where it depends on the words of the text."""
        return None

    def fits(self, word: Column) -> Column | None:
        """Test of a single word, for leaves without a pattern."""
        return None


@dataclass(frozen=True)
class Word(Leaf):
    text: str

    def on_text(self, subject: Subject) -> Column:
        found = []
        for word in words_of(self.text):
            if subject.stored is not None:
                found.append(subject.stored.contains(f" {word} "))
            else:
                found.append(subject.may_hold([word]) & subject.lower.rlike(whole_word(word)))
        return any_true(found)

    def on_other(self, subject: Subject) -> Column:
        return subject.filtered([self.text])

    def keyword_test(self, value: Column) -> Column:
        return value == F.lit(self.text)

    def pattern(self) -> str | None:
        return "|".join(whole_word(w) for w in words_of(self.text)) or None


@dataclass(frozen=True)
class Prefix(Leaf):
    text: str

    def _start(self) -> str | None:
        """The start of a word, or None if no word can start like this."""
        start = self.text.lower()
        return start if words_of(f"{start}x") == [f"{start}x"] else None

    def on_text(self, subject: Subject) -> Column:
        start = self._start()
        if start is None:
            return F.lit(False)
        if subject.stored is not None:
            return subject.stored.contains(f" {start}")
        return subject.may_hold([start]) & subject.lower.rlike(starts_word(start))

    def keyword_test(self, value: Column) -> Column:
        return value.startswith(self.text)

    def pattern(self) -> str | None:
        start = self._start()
        return starts_word(start) + REST_OF_WORD if start else None


@dataclass(frozen=True)
class Phrase(Leaf):
    text: str

    def on_text(self, subject: Subject) -> Column:
        sequence = words_of(self.text)
        if not sequence:
            return F.lit(False)
        if subject.stored is not None:
            return subject.stored.contains(f" {' '.join(sequence)} ")
        return subject.may_hold(sequence) & subject.lower.rlike(word_sequence(sequence))

    def on_other(self, subject: Subject) -> Column:
        return subject.filtered([self.text])

    def keyword_test(self, value: Column) -> Column:
        return value == F.lit(self.text)

    def pattern(self) -> str | None:
        sequence = words_of(self.text)
        return word_sequence(sequence) if sequence else None


@dataclass(frozen=True)
class Wildcard(Leaf):
    """``?`` stands for one character of a word, ``*`` for any number."""

    text: str

    def _translate(self, text: str, one: str) -> str:
        return "".join({"?": one, "*": f"{one}*"}.get(p, quote(p)) for p in re.split(r"([?*])", text) if p)

    def on_text(self, subject: Subject) -> Column:
        text = self.text.lower()
        pattern = f" {self._translate(text, '[^ ]')} "
        return subject.may_hold(re.split(r"[?*]+", text)) & subject.joined().rlike(pattern)

    def keyword_test(self, value: Column) -> Column:
        return value.rlike(f"(?s)^{self._translate(self.text, '.')}$")

    def pattern(self) -> str | None:
        one = f"(?:{WORD_CHAR}|{JOINER}(?={WORD_CHAR}))"
        start = f"(?<!{WORD_CHAR})(?<!{WORD_CHAR}{JOINER})(?={WORD_CHAR})"
        return start + self._translate(self.text.lower(), one) + ENDS_WORD


@dataclass(frozen=True)
class Regex(Leaf):
    """A pattern that a whole word (or keyword value) must fit."""

    text: str

    def on_text(self, subject: Subject) -> Column:
        return F.exists(subject.words(), self.fits)

    def fits(self, word: Column) -> Column:
        return word.rlike(f"^(?:{self.text})$")

    def keyword_test(self, value: Column) -> Column:
        return value.rlike(f"(?s)^(?:{self.text})$")


@dataclass(frozen=True)
class Near(Leaf):
    """Words within ``slop`` moves of standing next to each other, in any order."""

    text: str
    slop: int

    def on_text(self, subject: Subject) -> Column:
        terms = words_of(self.text)
        if not terms:
            return F.lit(True)
        distinct = dict.fromkeys(terms)
        found = subject.may_hold(terms)
        if subject.stored is None:  # only texts that have all words are split
            found = all_true([found, *[subject.lower.rlike(whole_word(term)) for term in distinct]])

        def near(tokens: Column) -> Column:
            places = F.transform(tokens, lambda word, at: F.when(word.isin(*distinct), F.struct(at.alias("at"), word.alias("word"))))
            held = F.array(F.filter(places, lambda place: place.isNotNull()))
            return F.exists(held, lambda those: self._fits(those, terms, tokens))

        return found & F.exists(F.array(subject.words()), near)

    def _fits(self, held: Column, terms: Sequence[str], tokens: Column) -> Column:
        """Whether the places that hold a searched word, in order, let all words be near.

        Moving word i back by i places, all words must fall into a span of slop + 1 places. A sweep over the moved places
        keeps where each word was last seen; the span of those is the smallest that ends there.
        """

        def moved(i: int, term: str) -> Column:
            own = F.filter(held, lambda place: place["word"] == F.lit(term))
            return F.transform(own, lambda place: F.struct((place["at"] - i).alias("at"), F.lit(i).alias("term")))

        swept = F.array_sort(F.concat(*[moved(i, term) for i, term in enumerate(terms)]))
        never = F.lit(-(2**30))
        start = F.struct(F.array(*[never] * len(terms)).cast("array<int>").alias("last"), F.lit(False).alias("near"))

        def step(state: Column, place: Column) -> Column:
            last = F.transform(state["last"], lambda at, i: F.when(i == place["term"], place["at"]).otherwise(at))
            near = state["near"] | (place["at"] - F.array_min(last) <= self.slop)
            return F.struct(last.alias("last"), near.alias("near"))

        near = F.aggregate(swept, start, step, lambda state: state["near"])
        repeated = {term: [i for i, other in enumerate(terms) if other == term] for term in terms}
        repeated = {term: own for term, own in repeated.items() if len(own) > 1}
        return near & F.exists(swept, lambda place: self._distinct(tokens, place["at"], repeated, terms)) if repeated else near

    def _distinct(self, tokens: Column, start: Column, repeated: Mapping[str, Sequence[int]], terms: Sequence[str]) -> Column:
        """Whether the span of places from ``start`` has a place for each word.

        A word given several times needs places of its own: any run of its spans must hold it as often as there are spans
        (Hall's condition).
        """

        def span(first: int, last: int) -> Column:
            begin = F.greatest(start + first, F.lit(0))
            return F.slice(tokens, begin + 1, F.greatest(start + last + self.slop + 1 - begin, F.lit(0)))

        tests = [F.array_contains(span(i, i), term) for i, term in enumerate(terms) if term not in repeated]
        for term, own in repeated.items():
            for a, first in enumerate(own):
                for b, last in enumerate(own[a:], a):
                    tests.append(F.size(F.array_remove(span(first, last), term)) + b - a < F.size(span(first, last)))
        return all_true(tests)

    def keyword_test(self, value: Column) -> Column:
        return value == F.lit(self.text)

    def pattern(self) -> str | None:
        return "|".join(whole_word(w) for w in words_of(self.text)) or None


@dataclass(frozen=True)
class Fuzzy(Leaf):
    """Words within one or two edits: insert, delete, replace, or swap two neighbours."""

    text: str
    edits: int = 2

    def __post_init__(self) -> None:
        if self.edits not in (0, 1, 2):
            raise ValueError("a fuzzy query allows 0, 1 or 2 edits")

    def _test(self, term: str, value: Column) -> Column:
        def swapped(word: str) -> list[str]:
            return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]

        def near(other: str, edits: int) -> Column:
            return F.levenshtein(value, F.lit(other), edits) >= 0

        once = sorted(set(swapped(term)) - {term})
        options = [near(term, self.edits)]
        if self.edits == 1 and once:
            options.append(value.isin(once))
        if self.edits == 2:
            options += [near(w, 1) for w in once]
            twice = sorted({v for w in once for v in swapped(w)} - {term})
            if twice:
                options.append(value.isin(twice))
        # Lengths further apart than the edits allow cannot match; this spares most comparisons.
        return F.length(value).between(len(term) - self.edits, len(term) + self.edits) & any_true(options)

    def on_text(self, subject: Subject) -> Column:
        return F.exists(subject.words(), self.fits)

    def fits(self, word: Column) -> Column:
        return self._test(self.text.lower(), word)

    def keyword_test(self, value: Column) -> Column:
        return self._test(self.text, value)


@dataclass(frozen=True)
class Between(Leaf):
    """Values of a field from ``low`` to ``high``; None for an open end, ``without`` names the ends that do not count."""

    low: str | None
    high: str | None
    without: frozenset[str] = frozenset()

    def bounds(self) -> dict[str, str]:
        found = {}
        if self.low is not None:
            found["gt" if "low" in self.without else "gte"] = self.low
        if self.high is not None:
            found["lt" if "high" in self.without else "lte"] = self.high
        return found

    def on_text(self, subject: Subject) -> Column:
        raise ValueError("a range needs a field of single values")

    def keyword_test(self, value: Column) -> Column:
        tests = {"gt": value.__gt__, "gte": value.__ge__, "lt": value.__lt__, "lte": value.__le__}
        return value.isNotNull() & all_true(tests[op](F.lit(bound)) for op, bound in self.bounds().items())

    def on_other(self, subject: Subject) -> Column:
        return subject.filtered(self.bounds()) if self.bounds() else F.lit(True)

    def leaves(self, field: str | None = None) -> list[Leaf]:
        return []


class Subjects(dict):
    """Searchable fields, and beside them the ``others``, which are searched only by their name."""

    def __init__(self, searchable: Mapping[str, Subject], others: Mapping[str, Subject]) -> None:
        super().__init__(searchable)
        self.others = dict(others)

    def of(self, field: str) -> Subject:
        found = self.get(field) or self.others.get(field)
        if found is None:
            raise ValueError(f"{field!r} is not a searchable field")
        return found


@dataclass(frozen=True)
class Exists(Query):
    field: str

    def column(self, subjects: Subjects) -> Column:
        """As the field filter of that name: an empty list is no value."""
        return subjects.others[""].filtered((self.field, {"exists": True}))


@dataclass(frozen=True)
class InField(Query):
    field: str
    part: Query

    def column(self, subjects: Subjects) -> Column:
        return self.part.column(Subjects({self.field: subjects.of(self.field)}, subjects.others))

    def leaves(self, field: str | None = None) -> list[Leaf]:
        return self.part.leaves(field) if field in (None, self.field) else []

    def size(self) -> int:
        return self.part.size()


@dataclass(frozen=True)
class _Group(Query):
    parts: tuple[Query, ...]

    def size(self) -> int:
        return sum(p.size() for p in self.parts)

    def leaves(self, field: str | None = None) -> list[Leaf]:
        return [leaf for p in self.parts for leaf in p.leaves(field)]


class AnyOf(_Group):
    def column(self, subjects: Mapping[str, Subject]) -> Column:
        return any_true(p.column(subjects) for p in self.parts)


class AllOf(_Group):
    def column(self, subjects: Mapping[str, Subject]) -> Column:
        return all_true(p.column(subjects) for p in self.parts)


class NoneOf(_Group):
    def column(self, subjects: Mapping[str, Subject]) -> Column:
        return ~any_true(p.column(subjects) for p in self.parts)

    def leaves(self, field: str | None = None) -> list[Leaf]:
        return []


def _list(texts: Iterable[str]) -> Column:
    """A constant array, made from a single literal."""
    return F.split(F.lit("\x00".join(texts)), "\x00")


def _starts(values: Column, length: int) -> Column:
    return F.transform(values, lambda value: F.substring(value, 1, length))


def _sequences(values: Column, length: int, firsts: Iterable[str]) -> Column:
    """All runs of ``length`` words that begin with one of some words, each joined by blanks."""
    heads, last = list(firsts), F.greatest(F.size(values) - length, F.lit(0))
    places = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(values, i).isin(heads))
    return F.transform(places, lambda i: F.array_join(F.slice(values, i + 1, length), " "))


def _shape(leaf: Query) -> tuple[str, int, str] | None:
    """How a leaf is looked up among the words of a text: as a word, a start or a phrase of some length, and the term."""
    if isinstance(leaf, (Word, Phrase)):
        found = words_of(leaf.text)
        if len(found) == 1:
            return "word", 1, found[0]
        return ("phrase", len(found), " ".join(found)) if isinstance(leaf, Phrase) and found else None
    if isinstance(leaf, Prefix):
        start = leaf._start()
        return ("start", len(start), start) if start else None
    return None


def _looked_up(shape: tuple[str, int], terms: Iterable[str], words: Column) -> Column:
    """The part of a text's words that can be one of the terms of a shape."""
    kind, length = shape
    if kind == "word":
        return words
    if kind == "start":
        return _starts(words, length)
    return _sequences(words, length, sorted({term.split(" ")[0] for term in terms}))


class Lexicon(Query):
    """Any of many words, starts and phrases. The words of a text are looked up, which costs the same for any number."""

    def __init__(self, leaves: Iterable[Leaf], field: str | None = None) -> None:
        self.field, self.parts = field, tuple(leaves)

    def size(self) -> int:
        return len(self.parts)

    def leaves(self, field: str | None = None) -> list[Leaf]:
        return list(self.parts) if self.field in (None, field) or field is None else []

    def _on_words(self, words: Column) -> Column:
        """Looked for until the first is found: words and starts word by word, then phrases."""
        tables: dict[tuple[str, int], dict[str, None]] = {}
        for kind, length, term in filter(None, map(_shape, self.parts)):
            tables.setdefault((kind, length), {})[term] = None

        def known(word: Column) -> Column:
            parts = [(F.substring(word, 1, n) if kind == "start" else word, terms) for (kind, n), terms in single]
            return any_true(part.isin(list(terms)) for part, terms in parts)

        def held(n: int, terms: Iterable[str]) -> Column:
            heads = list(dict.fromkeys(term.split(" ")[0] for term in terms))
            places = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
            run = lambda i: F.array_join(F.slice(words, i + 1, n), " ")
            return F.exists(places, lambda i: F.get(words, i).isin(heads) & run(i).isin(list(terms)))

        single = [(shape, terms) for shape, terms in sorted(tables.items(), reverse=True) if shape[0] != "phrase"]
        tests = [F.exists(words, known)] if single else []
        return any_true(tests + [held(n, terms) for (kind, n), terms in sorted(tables.items()) if kind == "phrase"])

    def _on_value(self, value: Column) -> Column:
        whole = [p.text for p in self.parts if not isinstance(p, Prefix)]
        starts: dict[int, list[str]] = {}
        for part in self.parts:
            if isinstance(part, Prefix):
                starts.setdefault(len(part.text), []).append(part.text)
        tests = [value.isin(whole)] if whole else []
        return any_true(tests + [F.substring(value, 1, n).isin(texts) for n, texts in starts.items()])

    def column(self, subjects: Mapping[str, Subject]) -> Column:
        tests = []
        for subject in [subjects.of(self.field)] if self.field else subjects.values():
            if subject.kind == "other":
                return any_true(InField(self.field, part).column(subjects) for part in self.parts)
            if subject.kind == "text":
                # A one-element array binds the words, so that a text is split once.
                tests.append(F.exists(F.array(subject.words()), self._on_words))
            elif subject.kind == "tag":
                tests.append(F.exists(subject.value, self._on_value))
            else:
                tests.append(self._on_value(subject.value))
        return any_true(F.coalesce(test, F.lit(False)) for test in tests)


def _flat(query: Query) -> list[Query]:
    return [part for p in query.parts for part in _flat(p)] if type(query) is AnyOf else [query]


def gathered(query: Query) -> Query:
    """The same query, in which words, starts and phrases of which any may match are looked up together if they are many."""
    if type(query) in (AllOf, NoneOf):
        return type(query)(tuple(gathered(p) for p in query.parts))
    if type(query) is not AnyOf:
        return query
    plain: dict[str | None, list[Leaf]] = {}
    others = []
    for part in _flat(query):
        field, leaf = (part.field, part.part) if isinstance(part, InField) else (None, part)
        if _shape(leaf) is not None:
            plain.setdefault(field, []).append(leaf)
        else:
            others.append(gathered(part))
    if sum(map(len, plain.values())) < _SPLIT_FROM:
        return AnyOf(tuple(gathered(p) for p in query.parts))
    parts = [Lexicon(leaves, field) for field, leaves in plain.items()] + others
    return AnyOf(tuple(parts)) if len(parts) > 1 else parts[0]


_CLAUSE = re.compile(
    r"""\s*(?:
        (?P<joint>AND|OR|NOT|&&|\|\|)(?=\s|$)
      | (?P<sign>[-+!])?(?:(?P<field>[\w.]+):)?
        (?: (?P<group>\() | (?P<open>[\[{])\s*(?P<low>[^\s\]}]+)\s+TO\s+(?P<high>[^\s\]}]+)\s*(?P<close>[\]}]) | "(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))? | /(?P<regex>[^/]+)/ | (?P<term>[^\s"()]+) )
    )""",
    re.VERBOSE,
)


def _term(text: str) -> Query:
    fuzzy = re.fullmatch(r"(.+)~(\d?)", text)
    if fuzzy:
        return Fuzzy(fuzzy[1], int(fuzzy[2] or 2))
    if re.fullmatch(r"[^?*]+\*", text):
        return Prefix(text[:-1])
    return Wildcard(text) if re.search(r"[?*]", text) else Word(text)


def shorthand(text: str) -> Query:
    """Read a typed query: words, "phrases", pre*, te?t, /regex/, word~1, "a b"~5, field:word, field:[a TO b], (groups),
    joined by AND, OR, NOT, + and -. Words side by side mean OR.
    """
    query, end = _read(text.strip(), 0, False)
    return query


def _read(text: str, at: int, inside: bool) -> tuple[Query, int]:
    """A query up to the end of the text or, ``inside`` a group, to its closing bracket; and where that ends."""
    clauses: list[tuple[str, Query]] = []  # (must | should | not, query)
    joint, negate, closed = None, False, False
    while at < len(text):
        closing = re.compile(r"\s*\)").match(text, at)
        if closing and inside:
            at, closed = closing.end(), True
            break
        clause = _CLAUSE.match(text, at)
        if not clause or (clause["group"] and clause["field"]):
            raise ValueError(f"cannot read {text[at:]!r}")
        at = clause.end()
        if clause["joint"]:
            if clause["joint"] == "NOT":
                negate = True
            else:
                joint = clause["joint"]
            continue
        if clause["group"]:
            query, at = _read(text, at, True)
        elif clause["field"] == "_exists_":
            query: Query = Exists(clause["term"])
        elif clause["phrase"] is not None:
            query = Near(clause["phrase"], int(clause["slop"])) if clause["slop"] else Phrase(clause["phrase"])
        elif clause["open"]:
            low, high = (None if end == "*" else end.strip('"') for end in (clause["low"], clause["high"]))
            without = {"low": clause["open"] == "{", "high": clause["close"] == "}"}
            query = Between(low, high, frozenset(end for end, out in without.items() if out))
            if not clause["field"]:
                raise ValueError("a range needs a field")
        elif clause["regex"]:
            query = Regex(clause["regex"])
        else:
            query = _term(clause["term"])
        if clause["field"] and clause["field"] != "_exists_":
            query = InField(clause["field"], query)
        both = joint in ("AND", "&&")
        if both and clauses and clauses[-1][0] == "should":
            clauses[-1] = ("must", clauses[-1][1])
        if negate or clause["sign"] in ("-", "!"):
            occur = "not"
        else:
            occur = "must" if both or clause["sign"] == "+" else "should"
        clauses.append((occur, query))
        joint, negate = None, False

    if inside and not closed:
        raise ValueError("a bracket is not closed")
    by = {kind: tuple(q for occur, q in clauses if occur == kind) for kind in ("must", "should", "not")}
    parts: list[Query] = list(by["must"])
    if by["should"] and not by["must"]:
        parts.append(by["should"][0] if len(by["should"]) == 1 else AnyOf(by["should"]))
    if by["not"]:
        parts.append(NoneOf(by["not"]))
    if by["should"] and by["must"]:
        parts.append(_Optional(by["should"]))
    if not parts:
        raise ValueError("empty query")
    return (parts[0] if len(parts) == 1 else AllOf(tuple(parts))), at


class _Optional(_Group):
    """Clauses that need not match next to required ones; they only count for highlighting."""

    def column(self, subjects: Mapping[str, Subject]) -> Column:
        return F.lit(True)

    def size(self) -> int:
        return 0


def as_query(query: str | Query) -> Query:
    return shorthand(query) if isinstance(query, str) else query


def labelled(queries: str | Query | Sequence[str | Query] | Mapping[str, str | Query] | None) -> dict[str, Query]:
    """Queries by label. A single query gets label "1", a list "0", "1" and so on."""
    if queries is None:
        return {}
    if isinstance(queries, (str, Query)):
        queries = {"1": queries}
    elif not isinstance(queries, Mapping):
        queries = {str(i): q for i, q in enumerate(queries)}
    return {label: as_query(q) for label, q in queries.items()}


def split_labels(typed: str) -> dict[str, str]:
    """The typed form: ``label = query`` parts separated by semicolons or newlines; the label is optional."""
    found = {}
    for part in re.split(r"[;\n]", typed):
        label, equals, query = part.partition("=")
        if not part.strip():
            continue
        found[label.strip() if equals else part.strip()] = query.strip() if equals else part.strip()
    return found


def search_kinds(df: DataFrame) -> dict[str, str]:
    """Searchable field -> kind."""
    kinds = {}
    for name, field in fields_of(df).items():
        if field.type in ("text", "tag"):
            kinds[name] = field.type
        elif field.type in KEYWORD_LIKE:
            kinds[name] = "keyword"
    return kinds


def _subjects(df: DataFrame, lower_of) -> Subjects:
    from docsieve.operators.filters import field_condition

    stored, known = words_columns(df), search_kinds(df)
    others = {
        name: Subject("other", F.col(name), filtered=lambda spec, name=name: field_condition(df, name, spec))
        for name, field in fields_of(df).items()
        if name not in known and field.type in ("number", "integer", "boolean", "date")
    }
    # Under no name: any field's condition.
    others[""] = Subject("other", F.lit(None), filtered=lambda both: field_condition(df, *both))
    searchable = {
        name: Subject(
            kind,
            F.col(name),
            lower_of(name) if kind == "text" else None,
            F.col(stored[name]) if name in stored else None,
        )
        for name, kind in search_kinds(df).items()
    }
    return Subjects(searchable, others)


def _unstored_texts(df: DataFrame) -> list[str]:
    stored = words_columns(df)
    return [name for name, kind in search_kinds(df).items() if kind == "text" and name not in stored]


def match(df: DataFrame, query: str | Query) -> Column:
    """Boolean Column: the document matches the query; never null."""
    query, texts = gathered(as_query(query)), _unstored_texts(df)
    if query.size() < _BIND_FROM or not texts:
        return query.column(_subjects(df, lambda name: F.lower(F.col(name))))
    # A one-element array binds the lower-cased texts, so that they are made once for all leaves.
    bound = F.array(F.struct(*[F.lower(F.col(n)).alias(n) for n in texts]))
    return F.exists(bound, lambda row: query.column(_subjects(df, lambda n: row[n] if n in texts else None)))


def any_of(queries) -> Query | None:
    """OR over labelled queries; None if there are none."""
    found = tuple(labelled(queries).values())
    return AnyOf(found) if len(found) > 1 else found[0] if found else None


def match_any(df: DataFrame, queries) -> Column:
    """OR over labelled queries; with none given, everything matches."""
    query = any_of(queries)
    return F.lit(True) if query is None else match(df, query)


def where_matches(df: DataFrame, queries) -> DataFrame:
    """Documents that match any of the queries.

    A filter on a lower-cased column would be pushed below it and make it again for each leaf. So the column comes
    from a one-row generator: leaves then share it, in generated code, and field filters still pass below.
    """
    query, texts = any_of(queries), _unstored_texts(df)
    if query is None:
        return df
    query = gathered(query)
    if query.size() < _BIND_FROM or not texts:
        return df.where(match(df, query))
    lowered = {n: f"__lower_{n}" for n in texts}
    row = F.struct(*[F.lower(F.col(n)).alias(alias) for n, alias in lowered.items()])
    bound = df.select("*", F.inline(F.array(row)))
    subjects = _subjects(df, lambda n: F.col(lowered[n]) if n in lowered else None)
    return bound.where(query.column(subjects)).drop(*lowered.values())


def _plain(query: Query, kinds: Mapping[str, str]) -> tuple[Leaf, str | None] | None:
    """The leaf and field (None for all) of a query for one word, start or phrase in texts; None for other queries."""
    field = query.field if isinstance(query, InField) else None
    leaf = query.part if isinstance(query, InField) else query
    if _shape(leaf) is None or (field and kinds.get(field) != "text"):
        return None
    return leaf, field


def _marks_of(values: Column, marks: Mapping[str, list[str]]) -> Column:
    """Marks of those values of an array that have some, for arrays of a few values. The table is a constant."""
    listed = "\x02".join(f"{value}\x03{','.join(several)}" for value, several in marks.items())
    table = F.str_to_map(F.lit(listed), F.lit("\x02"), F.lit("\x03"))
    return F.flatten(F.transform(F.array_intersect(values, _list(marks)), lambda value: F.split(table[value], ",")))


def _headed(head: str, terms: Column) -> Column:
    return F.transform(terms, lambda term: F.concat(F.lit(head), term))


def _term_keys(
    df: DataFrame, plain: Mapping[str, tuple[Leaf, str | None]], marks: Mapping[str, str]
) -> tuple[list[Column], list[Column], list[tuple[str, str]]]:
    """What a document holds of the terms of labels: keys of terms in texts, marks of labels found in other fields, and
    the label of each key.

    The words of a text, their starts and runs of them are cut with the terms, which costs much the same for any number.
    """
    texts: dict[tuple[str, str | None, str, int], dict[str, None]] = {}
    others: dict[tuple[str, str, int], dict[str, list[str]]] = {}
    rows, kinds = [], search_kinds(df)
    for label, (leaf, field) in plain.items():
        how, length, term = _shape(leaf)
        rows.append((f"{field or ''}|{how}{length}|{term}", label))
        for name, kind in kinds.items():
            if kind == "text" and field in (None, name):
                texts.setdefault((name, field, how, length), {})[term] = None
            elif kind != "text" and field is None:
                shape = ("start", len(leaf.text)) if isinstance(leaf, Prefix) else ("word", 1)
                others.setdefault((name, *shape), {}).setdefault(leaf.text, []).append(marks[label])
    none = F.array().cast("array<string>")

    def hits(name: str, words: Column) -> Column:
        """Keys of one field; the terms of each kind are cut with what the words can be."""
        keys = []
        for (field_name, field, how, length), terms in texts.items():
            if field_name == name:
                cut = F.array_intersect(_looked_up((how, length), terms, words), _list(terms))
                keys.append(_headed(f"{field or ''}|{how}{length}|", cut))
        return F.concat(*keys)

    keys, labels = [], []
    for name in dict.fromkeys(name for name, *_ in texts):
        # A one-element array binds the words, so that a text is split once.
        bound = F.transform(F.array(f"__words_{name}"), lambda words: hits(name, words))  # noqa: B023
        keys.append(F.coalesce(F.flatten(bound), none))
    for (name, how, length), terms in others.items():
        values = F.col(name) if kinds[name] == "tag" else F.array(F.col(name))
        labels.append(F.coalesce(_marks_of(_looked_up((how, length), terms, values), terms), none))
    return keys, labels, rows


def label_matches(df: DataFrame, queries, name: str = "_query") -> DataFrame:
    """One row per document and matching label. All labels are tested in one pass over the texts."""
    found, columns, kinds = labelled(queries), df.columns, search_kinds(df)
    many = sum(q.size() for q in found.values()) >= _SPLIT_FROM
    plain = {label: leaf for label, q in found.items() if many and (leaf := _plain(q, kinds))}
    others = {label: q for label, q in found.items() if label not in plain}
    if many:
        texts, stored = [n for n, kind in kinds.items() if kind == "text"], words_columns(df)
        split = {n: F.split(F.trim(F.col(stored[n])), " ") if n in stored else words(F.col(n)) for n in texts}
        df = df.withColumns({f"__words_{n}": column for n, column in split.items()})
    if sum(q.size() for q in others.values()) >= _SPLIT_FROM:
        for text in _unstored_texts(df):
            joined = F.concat(F.lit(" "), F.array_join(f"__words_{text}", " "), F.lit(" "))
            df = mark_words(df.withColumn(f"__joined_{text}", joined), f"__joined_{text}", text)
    lowered = {n: f"__lower_{n}" for n in _unstored_texts(df)} if others else {}
    bound = df.withColumns({alias: F.lower(F.col(n)) for n, alias in lowered.items()}) if lowered else df
    subjects = _subjects(df, lambda n: F.col(lowered[n]) if n in lowered else None)
    if not plain:
        labels = F.array(*[F.when(q.column(subjects), F.lit(label)) for label, q in others.items()]).cast("array<string>")
        return bound.select(*columns, F.explode(labels).alias(name)).where(F.col(name).isNotNull())
    marks = {label: f"={i}" for i, label in enumerate(found)}
    keys, own, rows = _term_keys(df, plain, marks)
    rows = [(key, label, marks[label]) for key, label in [*rows, *((mark, label) for label, mark in marks.items())]]
    own.append(F.array(*[F.when(q.column(subjects), F.lit(marks[label])) for label, q in others.items()]).cast("array<string>"))
    table = df.sparkSession.createDataFrame(rows, "__key string, __label string, __mark string")
    bound = bound.withColumn("__own", F.array_compact(F.concat(*own)))
    held = bound.select(*columns, "__own", F.explode(F.array_distinct(F.concat("__own", *keys))).alias("__key"))
    # The labels were typed or listed by the caller, so they are few next to any text.
    held = held.join(F.broadcast(table) if len(rows) <= MAX_SENT_LABELS else table, "__key")
    # A label that was found in another field as well counts once.
    again = (F.col("__key") != F.col("__mark")) & F.array_contains("__own", F.col("__mark"))
    return held.where(~again).select(*columns, F.col("__label").alias(name))
