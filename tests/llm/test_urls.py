from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.llm.queries import URL_RULES
from docsieve.llm.urls import DEPTH, host_and_path, shapes_of, url_filter


def parts(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = host_and_path(F.col("url"))
    return [tuple(r) for r in df.select(host, path).collect()]


def test_host_and_path(spark):
    urls = {
        "http://A.Example.COM/En/x?y#z": ("a.example.com", "/En/x"),
        "https://x.net": ("x.net", ""),
        "https://x.net?a/b": ("x.net", ""),
        "https://x.net#a/b": ("x.net", ""),
        "x.net/a": ("", ""),
        "": ("", ""),
        None: ("", ""),
        "a://b://c/d": ("b:", "//c/d"),
        "://": ("", ""),
        "ftp://É.de/é": ("É.de", "/é"),
        "http://x.net/a\nb?c": ("x.net", "/a\nb"),
    }
    assert parts(spark, list(urls)) == list(urls.values())


def judged(spark, urls, labels=()):
    pages = spark.createDataFrame(list(urls), "page_id bigint, url string").withColumns({"host": F.lit(1), "good": F.lit(2), "shape": F.lit(3)})
    marks = spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").withColumn("pages", F.lit(1))
    return url_filter(pages, marks, URL_RULES)


def test_longest_rule(spark):
    urls = [
        "http://example.com/en/x",
        "http://www.example.com/en/x",
        "http://a.www.example.com/en/x",
        "http://m.example.com/en/x",
        "http://notexample.com/en/x",
        "http://x.net/es/y",
        "http://x.net/ES/y",
        "http://x.com",
        "http://net/fr/",
        "http://x.org/en/",
    ]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged(spark, enumerate(urls)).collect()}
    assert [found[i] for i in range(len(urls))] == [
        ("example.com/en/", "block"),
        ("www.example.com/en/", "allow"),
        ("www.example.com/en/", "allow"),
        ("example.com/en/", "block"),
        ("com/", "allow"),
        ("net/es/", "block"),
        (None, "allow"),
        (None, "allow"),
        ("net/fr/", "block"),
        (None, "allow"),
    ]


def test_bad_template_is_rejected(spark):
    """On one host /spam/ is labelled bad and /news/ good; values of ids do not matter, other hosts stay allowed."""
    urls = [(i, f"http://a.org/{'spam' if i % 2 else 'news'}/{i}/x{i}.html") for i in range(400)]
    urls += [(1000 + i, f"http://b.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(100)]
    labels = [(i, 1 - i % 2, 0) for i in range(0, 200)]
    rows = judged(spark, urls, labels).collect()
    assert len(rows) == 500
    for r in rows:
        bad = r["host"] == "a.org" and "/spam/" in r["path"]
        assert r["verdict"] == ("block" if bad else "allow"), r
    assert {r["template"] for r in rows if r["host"] == "a.org"} == {"/spam/*/*", "/news/*/*"}
    # Branches without labels are similar, so they are merged.
    assert {r["template"] for r in rows if r["host"] == "b.org"} == {"/*/*"}


def test_odd(spark):
    deep = "http://d.org/" + "/".join(map(str, range(5000)))
    urls = [(None, None), (1, ""), (1, ""), (2, deep), (3, "http://d.org//a///b/")]
    labels = [(1, 0, None), (1, 1, 0), (None, 0, 1), (2, None, None)]
    rows = judged(spark, urls, labels).collect()
    assert len(rows) == 5
    assert {r["template"] for r in rows if r["page_id"] == 2} == {"/*" * (DEPTH + 1)}
    assert all(r["verdict"] in ("allow", "block") for r in rows)
    assert judged(spark, [], []).collect() == []
    shape = spark.range(1).select(shapes_of(F.lit("/a1b22/2020-01-02/x"))).first()[0]
    assert shape == ["a<n>b<n>", "<n>-<n>-<n>", "x"]


def test_bad_branch_far_down(spark):
    """Branches part at the eighth level and again at the tenth; what has no labels follows its node."""
    base = "/*" * 7
    branches = [
        (60, "/news/{}.html", 1, "allow", base + "/news/*"),
        (60, "/spam/p/q/r{}", 0, "block", base + "/spam/*/q/*"),
        (10, "/spam/p/q", None, "block", base + "/spam/*/q"),
        (60, "/spam/p/good/r/{}", 1, "allow", base + "/spam/*/good/*"),
        (5, "/other/{}", None, "allow", base + "/*/*"),
        (5, "", None, "allow", base),
    ]
    urls, labels, wanted = [], [], {}
    for count, rest, good, verdict, template in branches:
        for i in range(count):
            urls.append((len(wanted), f"http://d.org/a/2020/01/02/b/c/{'xy'[i % 2]}" + rest.format(i)))
            labels += [] if good is None else [(len(wanted), good, 0)]
            wanted[len(wanted)] = (verdict, template)
    rows = judged(spark, urls, labels).collect()
    assert len(rows) == len(urls)
    assert {r["page_id"]: (r["verdict"], r["template"]) for r in rows} == wanted


def test_small_bad_branch(spark):
    """A branch of 15 labelled pages parts from its siblings, and no longer lowers their purity."""
    urls = [(i, f"http://a.org/{chr(97 + i // 10)}{chr(97 + i % 10)}/{i}") for i in range(100)]
    urls += [(100 + i, f"http://a.org/spam/{i}") for i in range(15)]
    rows = judged(spark, urls, [(i, int(i < 100), 0) for i in range(115)]).collect()
    assert {(r["template"], r["verdict"]) for r in rows} == {("/*/*", "allow"), ("/spam/*", "block")}
    assert min(r["purity"] for r in rows if r["verdict"] == "allow") > 0.98
