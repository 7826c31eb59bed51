"""Main text of web pages: templates deduced from tokens that occur alike on the pages of a host."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.shared import arrow_map, keep, slices, text_of
from docsieve.llm.urls import host_and_path

# A class of tokens is valid if it has so many tokens and is found on so many distinct pages, and on this share of the host's.
MIN_TOKENS = 3
MIN_PAGES = 4
MIN_SHARE = 0.9
# An element of the template is gone into if it has this share of the text around it, and this share of the headings.
TEXT_SHARE = 0.5
HEADING_SHARE = 0.9
# A page whose article, as the template has it, holds less than this share of its text is taken without the template.
LEAST_SHARE = 0.1

# What a token is, in the bits above its hash.
TEXT, OPEN, CLOSE, CONTAINER = 1, 2, 4, 8

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>
      | <[!?][^>]*+(?:>|\Z)
    """,
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

# Elements of HTML by their use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
ASIDE = frozenset("nav aside form menu dialog button select option head".split())
CONTAINERS = frozenset("div section article main table tbody tr td center".split())
HEADINGS = frozenset(["h1", "h2"])
# Not part of the text outside of an article, where they belong to the page.
PAGE_ONLY = frozenset(["header"])
ALWAYS_ASIDE = frozenset(["footer"])
MAIN = frozenset(["article", "main"])
# What ends an open element of the same name, unless one of these lies between.
CLOSES_ITSELF = {
    "p": frozenset("div article section main aside td li body blockquote".split()),
    "li": frozenset("ul ol menu dir".split()),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]),
    "td": frozenset(["tr", "table"]),
    "th": frozenset(["tr", "table"]),
    "option": frozenset(["select"]),
}
ASIDE_NAMES = frozenset(
    "nav navbar navigation menu sidebar aside footer ad ads advert adverts advertisement banner sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice popup modal newsletter subscribe signup login share sharing social related "
    "recommended breadcrumb breadcrumbs comment comments disqus respond reply widget toolbar masthead complementary contentinfo "
    "search form alert dialog".split()
)
# Parts of a name that say nothing about what an element is, and those that say that it is something else.
NEUTRAL = frozenset(
    "area list box left right top bottom wrapper container section slot unit bar block inner outer buttons links main site page "
    "primary secondary global header".split()
)


class Node:
    """A token of a page: a tag or a run of text, with a hash that also covers the elements around it.

    ``parent`` is the element around it. ``aside`` is 0 for text of the page, 1 for what is never part of an article, and
    the element's key inside a page header, which may be that of the article.
    """

    __slots__ = ("key", "parent", "text", "aside", "main", "heading", "ends_block")

    def __init__(self, key: int, parent: int, text: str | None, aside: int, main: bool, heading: bool, ends_block: bool) -> None:
        self.key, self.parent, self.text, self.aside = key, parent, text, aside
        self.main, self.heading, self.ends_block = main, heading, ends_block


def _names_aside(name: str) -> bool:
    """Whether a whole class, id or role names an aside: ``site-footer`` and ``ad-slot-1`` do, ``has-sidebar`` and ``ad-free`` do not."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    return any(p in ASIDE_NAMES for p in parts) and all(p in ASIDE_NAMES or p in NEUTRAL for p in parts)


def _is_aside(name: str, names: list[str]) -> bool:
    if name in ASIDE or name in ALWAYS_ASIDE:
        return True
    if name in ("html", "body") or name in MAIN:
        return False
    return any(map(_names_aside, names))


def tokens(html: str, named: bool = True) -> list[Node]:
    """Tags and runs of text of a page, in order. Scripts, styles, comments and the like leave nothing.

    Elements are told apart by name, class, role, the elements around them and, if they hold blocks, their number among
    those alike. ``named``: whether classes, ids and roles may name asides.
    """
    out: list[Node] = []
    names: list[str] = []
    keys: list[int] = [0]
    asides: list[int] = [0]
    mains: list[bool] = [False]
    headings: list[bool] = [False]
    alike: list[Counter] = [Counter()]

    def add(key: int, text: str | None, ends_block: bool = False, depth: int = -1) -> None:
        out.append(Node(key, keys[depth], text, asides[depth], mains[depth], headings[depth], ends_block))

    def add_text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw and out:
                add(0, " ")
            return
        text = unescape(raw)
        add(zlib.crc32(" ".join(text.split()).encode(errors="surrogatepass"), keys[-1] & 0xFFFFFFFF) | TEXT << 32, text)

    def close(depth: int) -> None:
        del names[depth:], keys[depth + 1 :], asides[depth + 1 :], mains[depth + 1 :], headings[depth + 1 :], alike[depth + 1 :]

    at = 0
    for found in MARKUP.finditer(html):
        add_text(html[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCKS
        if found["end"] or found["end2"]:
            if name in names:
                depth = len(names) - 1 - names[::-1].index(name)
                add(zlib.crc32(b"/", keys[depth + 1] & 0xFFFFFFFF) | CLOSE << 32, None, block, depth + 1)
                close(depth)
            elif block:
                add(0, None, True)
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        if name in CLOSES_ITSELF and name in names:
            depth = len(names) - 1 - names[::-1].index(name)
            if CLOSES_ITSELF[name].isdisjoint(names[depth + 1 :]):
                close(depth)
        given = [(kind.lower(), value.strip("\"'").lower()) for kind, value in ATTRIBUTE.findall(attrs)] if attrs else []
        label = " ".join([name, *[re.sub(r"\d+", "#", value) for kind, value in given if kind != "id"]])
        if name in CONTAINERS:
            alike[-1][label] += 1
            label += f" {alike[-1][label]}"
        kind = CONTAINER if name in CONTAINERS else OPEN
        key = zlib.crc32(label.encode(errors="surrogatepass"), keys[-1] & 0xFFFFFFFF) | kind << 32
        if name == "br":
            add(key, " ")
            continue
        add(key, None, block)
        if name not in VOID and not attrs.endswith("/"):
            aside = asides[-1]
            if aside != 1 and _is_aside(name, [n for _, value in given for n in value.split()] if named else []):
                aside = 1
            elif not aside and name in PAGE_ONLY and not mains[-1]:
                aside = key
            names.append(name)
            keys.append(key)
            asides.append(aside)
            mains.append(mains[-1] or name in MAIN)
            headings.append(headings[-1] or name in HEADINGS)
            alike.append(Counter())
    add_text(html[at:])
    return out


def page_of(html: str) -> list[Node]:
    """The tokens of a page. Where names of classes would leave no text at all, they are not heeded."""
    page = tokens(html)
    return page if main_text(page, {}) else tokens(html, named=False)


def profile(page: list[Node]) -> np.ndarray:
    """Rows (token, occurrences, element around it, characters of text in it, those of them in headings), by token.

    Token 0 is the whole page. Asides count as no text.
    """
    rows: dict[int, list[int]] = {0: [1, 0, 0, 0]}
    for node in page:
        if not node.key:
            continue
        row = rows.setdefault(node.key, [0, node.parent if node.key >> 32 != CLOSE else 0, 0, 0])
        row[0] += 1
        if node.key >> 32 == TEXT and node.aside != 1:
            row[2] += len(node.text)
            row[3] += len(node.text) * node.heading
    # Elements come behind those around them.
    for key, (_, parent, chars, heads) in reversed(rows.items()):
        if key and (chars or heads):
            rows[parent][2] += chars
            rows[parent][3] += heads
    return np.array([[key, *row] for key, row in sorted(rows.items())], "<u8")


def valid_classes(keys: list[int], classes: dict[int, int]) -> set[int]:
    """Classes that are ordered and nested on a page.

    Ordered: the tokens of a class come in the same order each time, one round after the other. Nested: no round of a
    class begins inside a round of another, in one of its slots, and ends outside of that slot.
    """
    places: dict[int, list[int]] = {}
    for place, key in enumerate(keys):
        if key in classes:
            places.setdefault(classes[key], []).append(place)
    rounds: list[tuple[int, int, int, list[int]]] = []
    valid = set()
    for c, at in places.items():
        own = [keys[p] for p in at]
        size = len(set(own))
        if len(own) % size or any(own[i] != own[i % size] for i in range(len(own))) or len(set(own[:size])) < size:
            continue
        valid.add(c)
        rounds += [(at[i], at[i + size - 1], c, at[i : i + size]) for i in range(0, len(at), size)]
    # Wider rounds first; a round must fit into one slot of the round around it.
    open_: list[tuple[int, int, int, list[int]]] = []
    for begin, end, c, at in sorted(rounds, key=lambda r: (r[0], -r[1])):
        while open_ and open_[-1][1] < begin:
            open_.pop()
        if open_:
            _, outer_end, outer, outer_at = open_[-1]
            if end > outer_end or np.searchsorted(outer_at, begin) != np.searchsorted(outer_at, end):
                # The class with more tokens stays.
                valid.discard(c if len(at) <= len(outer_at) else outer)
                if len(at) <= len(outer_at):
                    continue
        open_.append((begin, end, c, at))
    return valid


def article_of(template: list[dict]) -> int:
    """The element of a host's template that holds the article: 0 if there is none.

    From the page inwards, the element with most of the text that differs between pages is gone into, as long as it has
    at least TEXT_SHARE of that around it, and the headings with it.
    """
    rows = {t["token"]: t for t in template}
    chars = {key: row["chars"] for key, row in rows.items()}
    heads = {key: row["heads"] for key, row in rows.items()}

    def around(key: int) -> Iterator[int]:
        while key:
            key = rows[key]["parent"] if key in rows else 0
            yield key

    for key, row in rows.items():
        if key >> 32 == TEXT and row["class"]:
            for outer in around(key):
                if outer in rows:
                    chars[outer] -= row["chars"]
                    heads[outer] -= row["heads"]
    inner: dict[int, list[int]] = {}
    fit = {key for key, row in rows.items() if key >> 32 == CONTAINER and row["single"] and row["class"]}
    for key in fit:
        inner.setdefault(next(k for k in around(key) if not k or k in fit), []).append(key)
    article = 0
    while article in inner:
        widest = max(inner[article], key=lambda key: (chars[key], key))
        if chars[widest] < max(1, TEXT_SHARE * chars.get(article, 0)) or heads[widest] < HEADING_SHARE * heads.get(article, 0):
            break
        article = widest
    return article


def _article_texts(page: list[Node], classes: dict[int, int], article: int) -> list[Node] | None:
    """The texts in an element, without asides; None if it holds too little of what the template leaves of the page."""
    inside, headers = set(), set()
    texts, own, all_ = [], 0, 0
    for node in page:
        if node.key == article or (node.parent in inside and node.text is None and node.key):
            inside.add(node.key)
        if node.text is None or node.aside == 1:
            continue
        varies = node.key >> 32 == TEXT and node.key not in classes
        all_ += len(node.text) * varies
        if node.parent in inside:
            own += len(node.text) * varies
            texts.append(node)
            if node.heading and varies and node.aside:
                headers.add(node.aside)
    if not own or own < LEAST_SHARE * all_:
        return None
    return [n for n in texts if not n.aside or n.aside in headers or n.main]


def main_text(page: list[Node], classes: dict[int, int], article: int = 0) -> str:
    """The blocks of text in the slots that the template leaves: those in its ``article``, with all text between them.

    Without such an element, the text in the elements that HTML has for articles is taken if there is some, else the text
    of all slots.
    """
    chosen = _article_texts(page, classes, article) if article else None
    if chosen is None:
        has_main = any(n.main and not n.aside and n.text and not n.text.isspace() for n in page)
        valid = valid_classes([n.key for n in page], classes) if classes and not has_main else ()
        chosen = [
            n
            for n in page
            if n.text is not None
            and not n.aside
            and (n.main or not has_main)
            # Outside of an article, text that is part of a valid class belongs to the template, not to a slot.
            and not (n.key >> 32 == TEXT and classes.get(n.key) in valid)
        ]
    taken = set(map(id, chosen))
    blocks, parts = [], []
    for node in page:
        if node.ends_block:
            blocks.append("".join(parts))
            parts = []
        elif node.text is not None:
            parts.append(node.text if id(node) in taken else " ")
    blocks.append("".join(parts))
    blocks = [" ".join(b.split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def _distinct_pages(pages: DataFrame) -> DataFrame:
    """Per host one row for all pages with the same text: a hash of that text, and the `profile` of the page.

    The text is what a page has without a template, so copies under other urls or with other menus are one page. Of the
    tokens of copies the smallest are taken, whatever the order; copies are folded in the tasks before the shuffle.
    """

    def each():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 1, 8_000_000):
                found: dict[tuple[str, bytes], bytes] = {}
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = page_of(html)
                    text = " ".join(main_text(page, {}).split())
                    key = host, blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest()
                    packed = profile(page).tobytes()
                    found[key] = min(found.get(key, packed), packed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in found], pa.string()),
                        pa.array(np.frombuffer(b"".join(k[1] for k in found), "<i8")),
                        pa.array(list(found.values()), pa.binary()),
                    ],
                    ["host", "page", "tokens"],
                )

        return work

    rows = arrow_map(pages.select("host", "html"), "host string, page bigint, tokens binary", each)
    return rows.groupBy("host", "page").agg(F.min("tokens").alias("tokens"))


_SUMMED = T.StructType([T.StructField("host", T.StringType())])
for _name in ("token", "pages", "times", "vector", "parent", "chars", "heads"):
    _SUMMED.add(_name, T.LongType())


def _occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token, summed per task: distinct pages, occurrences, a hash of the occurrence vector, and text.

    The vector has a number per page. Its hash is the sum over pages of a hash of page and number, so parts can be added
    up in any order. Token 0 is a page itself.
    """

    def each():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 2, 8_000_000):
                sums: dict[tuple[str, int], list[int]] = {}
                hosts, pages_, packed = (part.column(i).to_pylist() for i in range(3))
                for host, page, counted in zip(hosts, pages_, packed):
                    count = np.frombuffer(counted, "<u8").reshape(-1, 5)
                    marks = _mix(np.uint64(page % (1 << 64)) + count[:, 1] * np.uint64(0x9E3779B97F4A7C15)).tolist()
                    for (key, n, parent, chars, heads), mark in zip(count.tolist(), marks):
                        found = sums.get((host, key))
                        if found is None:
                            sums[host, key] = [1, n, mark, parent, chars, heads]
                        else:
                            found[0] += 1
                            found[1] += n
                            found[2] += mark
                            found[4] += chars
                            found[5] += heads
                rows = list(sums.values())
                vectors = np.array([r[2] % (1 << 64) for r in rows], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in sums]),
                        pa.array([k[1] for k in sums], pa.int64()),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array((vectors >> 1).astype(np.int64) // 2),
                        *[pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4, 5)],
                    ],
                    _SUMMED.names,
                )

        return work

    return arrow_map(_distinct_pages(pages), _SUMMED, each)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, article): per host the tokens of its equivalence classes, as pairs of 64-bit numbers token, class,
    and the element of the template that holds the article.

    Tokens with one occurrence vector form a class. Classes need MIN_TOKENS tokens and nearly all of the host's distinct
    pages, so that an article that comes often is not taken for a template, and a host's template is no longer than its pages are, and one row a host is bounded.
    """
    seen = _occurrences(pages).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"),
        F.sum("times").alias("times"),
        # Sums of hashes wrap around; as decimals they cannot overflow.
        F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"),
        F.max("parent").alias("parent"),
        F.sum("chars").alias("chars"),
        F.sum("heads").alias("heads"),
    )
    seen = keep(seen.where(f"token = 0 or pages >= {MIN_PAGES}"), "page-tokens")
    total = seen.where("token = 0").select("host", F.col("pages").alias("total")).where(f"total >= {MIN_PAGES}")
    often = seen.join(total, "host").where(F.col("pages") >= F.col("total") * MIN_SHARE)
    found = F.collect_list(F.struct("token", "parent", "chars", "heads")).alias("tokens")
    classes = often.groupBy("host", "pages", "times", "vector").agg(found)
    valid = F.when(F.size("tokens") >= MIN_TOKENS, F.xxhash64("pages", "times", "vector")).alias("class")
    rows = classes.select("host", valid, (F.col("pages") == F.col("times")).alias("single"), F.explode("tokens").alias("t"))
    row = F.struct("t.*", "class", "single")
    hosts = rows.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("template"))

    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = batch.column(1).to_pylist()
            pairs = [[{"token": t["token"], "class": t["class"]} for t in template if t["class"] and t["token"]] for template in known]
            kind = pa.list_(pa.struct([("token", pa.int64()), ("class", pa.int64())]))
            articles = pa.array(map(article_of, known), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pairs, kind), articles], ["host", "template", "article"])

        return work

    return arrow_map(hosts, "host string, template array<struct<token: bigint, class: bigint>>, article bigint", each)


def extract_main(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page.

    Tags and runs of text are told apart by the elements around them. Those with one occurrence vector over a host's
    pages form a class, and the classes its template. The article is the element of the template that holds most of the
    text that differs between pages (`article_of`), and all text in it is taken, whether it differs or not, but for menus,
    footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, which are known by their element or
    by a class, id or role that names nothing else. Without such an element (few pages, no template, or a page that departs
    from it) the elements that HTML has for articles decide, and if there are none the slots of the whole page are taken.
    If names of classes leave no text of a page, they are not heeded there. Result, one row per input row: ``page_id``,
    ``url``, ``text``, ``n_chars``.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by line feeds.
    A null html counts as empty and has an empty text; a null url belongs to the empty host. Hosts with fewer than
    MIN_PAGES distinct pages have no template; rows of a host whose text is the same before a template is dropped are one
    page there, whatever their number, urls and menus. Every row still has its result. Other columns are not read. A host
    that holds a large part of all pages is summed in the tasks, and its pages are dealt out by the join's skew handling.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (page_id, url)}
    host = host_and_path(F.col(url))[0]
    pages = df.select(df[page_id].alias("page_id"), df[url].alias("url"), host.alias("host"), text_of(df[html]).alias("html"))
    known = keep(templates(pages.select("host", "html")), "page-templates")
    rows = pages.join(known, "host", "left").select("page_id", "url", "html", "template", "article")
    schema = f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars bigint"

    def each():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 2, 8_000_000):
                texts = [
                    main_text(page_of(html), {t["token"]: t["class"] for t in template or ()}, article or 0)
                    for html, template, article in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

        return work

    return arrow_map(rows, schema, each)
