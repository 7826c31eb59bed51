from __future__ import annotations

import re
from html import unescape

from llm_samples import SF

from docsieve.llm.pages import article_of, extract_main, main_text, page_of, templates, tokens, valid_classes


def text(html: str, classes=None) -> str:
    return main_text(tokens(html), classes or {})


def test_blocks():
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a>Menu</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><header><h1>A &amp; B</h1></header><p>one  <b>two</b>\n three<br>four"
        "<p>five &lt;six&gt; &eacute;<script>var a = '<p>no</p>';</script><aside>aside</aside><div class='ad'>buy</div>"
        "<form><label>f</label></form><section id='comments'><p>first!</p></section><ul><li>x<li>y</ul></article>"
        "<div>outside</div><footer>&copy; foot</footer>"
    )
    assert text(html) == "A & B\none two three four\nfive <six> é\nx\ny"


def test_without_an_article():
    html = "<nav>menu</nav><div><h2>Head</h2>text<div role=navigation>skip</div> more</div><div class=sidebar>s</div><p>end"
    assert text(html) == "Head\ntext\nmore\nend"


def test_odd_markup():
    assert text("") == ""
    assert text("no markup at   all") == "no markup at all"
    assert text("1 < 2 > 1 <") == "1 < 2 > 1 <"
    assert text("<article>a<!-- <p>no</p> --><p title='a>b'>b</p></b></article></div>") == "a\nb"
    assert text("<p>a<!-- never closed") == "a"
    assert text('<article><p class="x>y</p>z</article>') != ""
    assert text("<p>" * 2000 + "deep") == "deep"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<p>\x00&#0;&bogus;&#x41;</p>") == "\x00�&bogus;A"


def test_classes_have_to_be_ordered_and_nested():
    classes = {1: 7, 2: 7, 3: 7, 4: 8, 5: 8}
    assert valid_classes([1, 2, 3, 1, 2, 3], classes) == {7}
    assert valid_classes([1, 3, 2, 1, 2, 3], classes) == set()
    assert valid_classes([1, 9, 4, 5, 2, 4, 5, 3], classes) == {7, 8}
    # The second class begins in one slot of the first and ends in another.
    assert valid_classes([1, 4, 2, 5, 3], classes) == {7}


def pages_of_a_host(spark, count=8):
    rows = [
        (
            i,
            f"http://h.org/{i}",
            f"<body><div>Share this</div><main><h1>Title {i}</h1><div>By the editors</div>" + f"<p>Story {i} goes on.</p>" * (i % 3 + 1) + "</main></body>",
        )
        for i in range(count)
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS template", "3 AS text")


def test_template_text_is_dropped_outside_of_the_article_only(spark):
    """A line that stands in every article is part of each; one that stands beside them is template."""
    found = {r["page_id"]: r["text"] for r in extract_main(pages_of_a_host(spark)).collect()}
    assert found[1] == "Title 1\nBy the editors\nStory 1 goes on.\nStory 1 goes on."
    few = {r["page_id"]: r["text"] for r in extract_main(pages_of_a_host(spark, 2)).collect()}
    assert few[1] == "Title 1\nBy the editors\nStory 1 goes on.\nStory 1 goes on."
    host = templates(pages_of_a_host(spark).selectExpr("'h.org' AS host", "page_id AS page", "html")).collect()
    assert len(host) == 1 and len(host[0]["template"]) > 6


def test_query(spark):
    """Against the known form of the test pages: an article between menu, advert and footer."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r for r in extract_main(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        body = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        wanted = "\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["text"] == wanted
        assert found[r["page_id"]]["n_chars"] == len(wanted) and found[r["page_id"]]["url"] == r["url"]


def test_odd(spark):
    rows = [(None, None, None), (1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://a.b/", ""), (3, "u", "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "html AS text", "url AS token")
    found = sorted(((r["page_id"] or 0), r["text"]) for r in extract_main(df).collect())
    assert found == [(0, ""), (1, "x"), (1, "x"), (2, ""), (3, ("long " * 100_000).strip())]
    assert extract_main(df.limit(0)).collect() == []


def texts_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in extract_main(df).collect()}


def test_repeated_rows_keep_their_text(spark):
    """Copies of a page are no template: ten equal rows, with or without a few other pages beside them."""
    html = "<html><body><div><p>x</p><p>y</p></div></body></html>"
    assert texts_of(spark, [(i, "http://h.org/a", html) for i in range(10)]) == dict.fromkeys(range(10), "x\ny")
    mixed = [(i, "http://h.org/a", html) for i in range(60)]
    mixed += [(60 + i, f"http://h.org/{i}", f"<html><body><div><p>other {i}</p></div></body></html>") for i in range(4)]
    found = texts_of(spark, mixed)
    assert [found[i] for i in range(64)] == ["x\ny"] * 60 + [f"other {i}" for i in range(4)]


def test_one_article_under_many_urls(spark):
    """The same article under ten urls of a host, each with a menu and links of its own, keeps its text."""
    html = "<body><nav>here: {0}</nav><article><h1>Title</h1><p>One <a href='?page={0}'>story</a>.</p><p>End.</p></article></body>"
    rows = [(i, f"http://h.org/a?utm_source=s{i}&page={i}", html.format(i)) for i in range(10)]
    assert texts_of(spark, rows) == dict.fromkeys(range(10), "Title\nOne story.\nEnd.")
    # Where there are enough different pages, the template is found as before, and copies get it too.
    pages = pages_of_a_host(spark).select("page_id", "url", "html").collect()
    copies = [(100 + i, f"http://h.org/copy/{i}", pages[0]["html"]) for i in range(80)]
    found = texts_of(spark, [tuple(r) for r in pages] + copies)
    assert found[1] == "Title 1\nBy the editors\nStory 1 goes on.\nStory 1 goes on."
    assert found[100] == found[0] == "Title 0\nBy the editors\nStory 0 goes on."


STORY = "Story {0} tells of things that happen on day {0} only, and goes on for a while as stories do. "


def plain_page(i: int, banner: str = "", attributes: bool = False, paragraph: str = "p") -> str:
    """A page whose elements have no telling names: a menu, an advert that differs, the article, notes that differ, and a foot."""
    mark = (lambda c: f" class='{c}'") if attributes else (lambda c: "")
    body = "".join(f"<{paragraph}>{STORY.format(f'{i}-{k}')}</{paragraph}>" for k in range(i % 3 + 2))
    return (
        f"<html><body>{banner}<div{mark('x1')}><ul><li>Home</li><li>News</li><li>Sport</li></ul></div>"
        f"<div{mark('x2')}>Buy thing {i}</div>"
        f"<div{mark('x3')}><h1>Head {i}</h1><{paragraph}>Dear readers,</{paragraph}>{body}<{paragraph}>Read on.</{paragraph}></div>"
        f"<div{mark('x4')}><div>Seen {i} times</div><div>Also {i + 1}</div></div><div{mark('x5')}>All rights kept</div></body></html>"
    )


def plain_text(i: int) -> str:
    lines = [f"Head {i}", "Dear readers,", *[STORY.format(f"{i}-{k}").strip() for k in range(i % 3 + 2)], "Read on."]
    return "\n".join(lines)


def test_only_the_template_separates(spark):
    """Without telling names the template alone finds the article; text that stands in every article stays."""
    for attributes, paragraph in ((False, "p"), (True, "p"), (True, "div")):
        html = {i: plain_page(i, attributes=attributes, paragraph=paragraph) for i in range(12)}
        found = texts_of(spark, [(i, f"http://h.org/{i}", html[i]) for i in html])
        assert found == {i: plain_text(i) for i in html}
        # With templates off the same pages keep everything.
        off = main_text(page_of(html[1]), {})
        assert "Buy thing 1" in off and "Home" in off and "All rights kept" in off
    # Too few pages for a template.
    few = texts_of(spark, [(i, f"http://h.org/{i}", html[i]) for i in range(3)])
    assert "Buy thing 1" in few[1]


def test_a_page_that_departs_from_the_template(spark):
    """Pages with a banner, which moves all elements on, and pages with other elements keep their whole text."""
    rows = [(i, f"http://h.org/{i}", plain_page(i)) for i in range(40)]
    rows += [(40 + i, f"http://h.org/b{i}", plain_page(i, "<div>Banner</div>")) for i in range(2)]
    rows.append((50, "http://h.org/other", "<html><body><table><tr><td>Quite another page</td></tr></table></body></html>"))
    found = texts_of(spark, rows)
    assert found[7] == plain_text(7)
    assert all(line in found[41].split("\n") for line in plain_text(1).split("\n"))
    assert found[50] == "Quite another page"


def test_article_without_headings_and_page_without_template():
    assert article_of([]) == 0
    base = {"heads": 0, "single": True, "class": 5}
    outer, inner, menu = (8 << 32) + 1, (8 << 32) + 2, (8 << 32) + 3
    rows = [
        {"token": 0, "parent": 0, "chars": 100, **base},
        {"token": outer, "parent": 0, "chars": 100, **base},
        {"token": inner, "parent": outer, "chars": 60, **base},
        {"token": menu, "parent": outer, "chars": 40, **base},
    ]
    assert article_of(rows) == inner
    rows[2]["heads"], rows[1]["heads"], rows[0]["heads"] = 1, 9, 9
    assert article_of(rows) == outer


def test_names_count_as_a_whole():
    story = "<p>Story</p>"
    for kept in ("has-sidebar", "search-results", "ad-free", "related-work", "no-comments", "shadow", "form-of-life"):
        assert text(f"<div class='{kept}'>{story}</div><p>end") == "Story\nend", kept
    for dropped in ("sidebar", "site-footer", "main-nav", "ad-slot-1", "comment-list", "x comments", "cookie_notice"):
        assert text(f"<div class='{dropped}'>{story}</div><p>end") == "end", dropped
    assert text("<fieldset>a <label>b</label> c</fieldset><form>d <label>e</label><fieldset>f</fieldset></form>") == "a b c"
    # Where names would leave nothing, they are not heeded.
    assert main_text(page_of(f"<div class='notice'>{story}</div>"), {}) == "Story"


def test_header_of_the_article(spark):
    """A header with the article's heading belongs to it, that of the page does not."""
    html = "<body><header><a>Site</a></header><div><header><h1>Head {0}</h1></header><p>" + STORY + "</p><div class=comments>c {0}</div></div></body>"
    found = texts_of(spark, [(i, f"http://h.org/{i}", html.format(i)) for i in range(8)])
    assert found == {i: f"Head {i}\n{STORY.format(i).strip()}" for i in range(8)}
