from __future__ import annotations

import datetime as dt
import random

import pytest
from core_samples import values
from pyspark.sql import functions as F

from docsieve.functions.ids import mime_from_extension, path_extension, path_file, path_folder
from docsieve.operators.access import ROLES, allowed_fields, check_request, effective_role, project_allowed, role_rules
from docsieve.operators.objects import (
    REGISTER,
    delete_objects,
    list_objects,
    object_total,
    quota_running,
    reconcile_objects,
    register_objects,
)
from docsieve.schema import Field, Snippet

OLD, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2)
REQUEST = "index string, field string, filepath string, size bigint, position bigint, force boolean"


@pytest.fixture(scope="module")
def register(spark):
    rows = [
        ("p", "f", "a/x.png", "a", 24, "image/png", OLD, None),
        ("p", "f", "a/b/y.png", "a/b", 10, "image/png", OLD, None),
        ("p", "g", "z.png", "", 5, "image/png", NOW, None),
        ("q", "f", "a/x.png", "a", 7, "image/png", OLD, None),
    ]
    return spark.createDataFrame(rows, REGISTER)


def requests(spark, *rows):
    return spark.createDataFrame([(*r, i, False) if len(r) == 4 else (*r[:4], i, r[4]) for i, r in enumerate(rows)], REQUEST)


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.tar.GZ",), ("x.png",), ("a/noext",), ("a.b/c",)], "p string")
    p = F.col("p")
    assert values(df.select(path_folder(p), path_file(p), path_extension(p))) == [
        ("a/b", "c.tar.GZ", "gz"), ("", "x.png", "png"), ("a", "noext", ""), ("a.b", "c", ""),
    ]
    assert [r[0] for r in df.select(mime_from_extension(path_extension(p))).collect()] == [None, "image/png", None, None]


def test_totals_and_listing(register):
    assert dict(map(tuple, object_total(register).collect())) == {"p": 39, "q": 7}

    def paths(**options):
        return sorted(r["filepath"] for r in list_objects(register, "p", **options).collect())

    assert paths() == ["z.png"]
    assert paths(recursive=True) == ["a/b/y.png", "a/x.png", "z.png"]
    assert paths(directory="/a/") == ["a/x.png"]
    assert paths(directory="a", recursive=True) == ["a/b/y.png", "a/x.png"]
    assert paths(recursive=True, contains="x.") == ["a/x.png"]
    assert delete_objects(register, "p").count() == 1
    assert delete_objects(register, "p", "f").count() == 2
    assert delete_objects(register, "p", "f", ["a/x.png"]).count() == 3


def test_registering(spark, register):
    wanted = requests(
        spark,
        ("p", "f", "a/x.png", 24),  # as it is: skipped
        ("p", "f", "a/b/y.png", 30),  # 20 more
        ("p", "f", "new/n.jpg", 100),
        ("p", "f", "new/n.jpg", 120),  # asked for twice: the last counts
    )
    done = register_objects(register, wanted, "image", 10_000, NOW)
    rows = {r["filepath"]: (r["path"], r["size"], r["content_type"], r["registered"]) for r in done.register.where("index = 'p'").collect()}
    assert rows == {
        "a/x.png": ("a", 24, "image/png", OLD),
        "a/b/y.png": ("a/b", 30, "image/png", NOW),
        "z.png": ("", 5, "image/png", NOW),
        "new/n.jpg": ("new", 120, "image/jpeg", NOW),
    }
    assert done.refused.count() == 0
    forced = requests(spark, ("p", "f", "a/x.png", 24, True))
    again = register_objects(register, forced, "image", 10_000, NOW, force="force").register
    assert again.where("filepath = 'a/x.png' and index = 'p'").first()["registered"] == NOW


def test_a_bad_request_refuses_its_project(spark, register):
    wanted = requests(spark, ("p", "f", "ok.png", 1), ("p", "f", "no.xyz", 1), ("q", "f", "ok.png", 1), ("r", "f", "m.mp4", 1))
    done = register_objects(register, wanted, "image", 10_000, NOW)
    assert sorted(values(done.refused.select("index", "filepath", "reason"))) == [
        ("p", "no.xyz", "unknown extension"), ("r", "m.mp4", "type does not fit the field"),
    ]
    assert sorted(r["index"] for r in done.register.where("filepath = 'ok.png'").collect()) == ["q"]
    over = register_objects(register, requests(spark, ("q", "f", "big.png", 100)), "image", 50, NOW)
    assert [r["reason"] for r in over.refused.collect()] == ["over quota"] and over.register.count() == 4
    with pytest.raises(ValueError):
        register_objects(register, wanted, "text", 1, NOW)


def test_running_totals_by_brute_force(spark, register):
    """One project holds most requests, sizes go up and down, and the limit is crossed more than once."""
    rng = random.Random(3)
    rows = [(rng.choice(["p"] * 8 + ["q", "r"]), "f", f"{i}.png", rng.randint(1, 100)) for i in range(6000)]
    known = [(*r[:3], "", rng.randint(1, 100), "image/png", OLD, None) for r in rows if rng.random() < 0.5]
    stored = spark.createDataFrame(known, REGISTER)
    limit = 190_000
    expected, totals, broken = {}, {}, set()
    sizes = {(k[0], k[2]): k[4] for k in known}
    for k in known:
        totals[k[0]] = totals.get(k[0], 0) + k[4]
    for index, _, path, size in rows:
        old = sizes.get((index, path))
        if old == size:
            continue
        totals[index] = totals.get(index, 0) + size - (old or 0)
        if totals[index] > limit:
            broken.add(index)
        expected[index, path] = (totals[index], index not in broken)
    found = quota_running(requests(spark, *rows), stored, limit).collect()
    assert {(r["index"], r["filepath"]): (r["running_total"], r["within_quota"]) for r in found} == expected
    assert broken == {"p"}


def test_reconciling(spark, register):
    listing = spark.createDataFrame(
        [("p", "f", "a/x.png", 25), ("p", "f", "new/n.png", 3)], "index string, field string, filepath string, size bigint"
    )
    found = {(r["index"], r["filepath"]): (r["path"], r["size"], r["last_synced"]) for r in reconcile_objects(register, listing, NOW).collect()}
    assert found == {
        ("p", "a/x.png"): ("a", 25, NOW),
        ("p", "new/n.png"): ("new", 3, NOW),
        ("p", "z.png"): ("", 5, None),  # its upload may still be under way
    }


RULES = [
    ("user@domain.com", "p", "READER"),
    ("*@domain.com", "p", "METAREADER"),
    ("*@domain.com", "q", "WRITER"),
    ("user@domain.com", "q", "NONE"),
    ("*", "open", "OBSERVER"),
    ("user@domain.com", "_server", "ADMIN"),
]


def roles(spark, **options):
    users = spark.createDataFrame([("user@domain.com",), ("other@domain.com",), ("guest@x.org",)], "email string")
    rules = spark.createDataFrame(RULES, "email string, role_context string, role string")
    return {(r["email"].split("@")[0], r["role_context"]): r["role"] for r in effective_role(users, rules, **options).collect()}


def test_roles(spark):
    everything = roles(spark)
    assert everything == {
        ("user", "p"): "READER",
        ("user", "q"): "NONE",
        ("user", "open"): "OBSERVER",
        ("user", "_server"): "ADMIN",
        ("other", "p"): "METAREADER",
        ("other", "q"): "WRITER",
        ("other", "open"): "OBSERVER",
        ("guest", "open"): "OBSERVER",
    }
    # The strongest rule counts, even where a weaker one would give more.
    assert {k: v for k, v in roles(spark, min_role="METAREADER").items() if k[1] == "q"} == {("other", "q"): "WRITER"}


def test_rules_by_pattern(spark):
    rules = spark.createDataFrame([*RULES, ("*@domain.com", "open", "READER"), ("*", "open", "NONE")], "email string, role_context string, role string")
    found = role_rules(rules)
    assert {(r["email"], r["role_context"]): (r["role"], r["overrides"]) for r in found.collect()} == {
        ("user@domain.com", "p"): ("READER", "METAREADER"),
        ("*@domain.com", "p"): ("METAREADER", None),
        ("*@domain.com", "q"): ("WRITER", None),
        ("user@domain.com", "q"): ("NONE", "WRITER"),
        ("*", "open"): ("OBSERVER", None),
        ("*@domain.com", "open"): ("READER", "OBSERVER"),
        ("user@domain.com", "_server"): ("ADMIN", None),
    }
    assert role_rules(rules.limit(0)).collect() == []


def test_expanded_rules_are_the_roles(spark):
    """Random rules, some of them twice: rows grow with the rules, and expanding them loses nothing."""
    dice = random.Random(5)
    people = [f"u{i}@d{i % 4}.example" for i in range(40)]
    patterns = [*people, *[f"*@d{i}.example" for i in range(5)], "*"]
    rows = [(dice.choice(patterns), f"p{dice.randrange(12)}", dice.choice(list(ROLES))) for _ in range(300)]
    rules = spark.createDataFrame(rows, "email string, role_context string, role string")
    users = spark.createDataFrame([(p,) for p in people], "email string")
    compact = role_rules(rules)
    assert compact.count() == len({r[:2] for r in rows})
    expected = {}
    for person in people:
        for pattern in ("*", "*@" + person.split("@")[1], person):
            for context in {r[1] for r in rows if r[0] == pattern}:
                expected[person, context] = max((r[2] for r in rows if r[:2] == (pattern, context)), key=ROLES.get)
    for given in (rules, compact):
        found = effective_role(users, given).collect()
        assert {(r["email"], r["role_context"]): r["role"] for r in found} == expected and len(found) == len(expected)
    some = effective_role(users, compact, contexts=["p1", "p7"]).collect()
    assert {(r["email"], r["role_context"]): r["role"] for r in some} == {k: v for k, v in expected.items() if k[1] in ("p1", "p7")}
    # Who has no rule of their own has what the rule overrides.
    narrow = {(r["email"], r["role_context"]): r["overrides"] for r in compact.collect()}
    without = effective_role(users, compact.where("email like '*%'")).collect()
    without = {(r["email"], r["role_context"]): r["role"] for r in without}
    assert all(without.get(k) == v for k, v in narrow.items() if not k[0].startswith("*"))


def plan_nodes(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from plan_nodes(children.apply(i))


def test_users_times_projects_are_not_gathered(spark):
    """What users have from wider rules goes straight to the result: nothing sorts, groups or shuffles it."""
    people = [f"u{i}@d{i % 2}.example" for i in range(300)]
    rows = [("*", f"p{i}", "OBSERVER") for i in range(30)] + [("*@d0.example", f"p{i}", "READER") for i in range(20, 60)]
    rows += [(person, "p25", "WRITER") for person in people]
    users = spark.createDataFrame([(p,) for p in people], "email string")
    rules = spark.createDataFrame(rows, "email string, role_context string, role string")
    caps = users.selectExpr("email", "'NONE' server_role", "'READER' default_project_role", "map('p1', 'NONE') project_roles")
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        for given in (None, caps):
            found = effective_role(users, rules, given)
            assert len(found.collect()) == 150 * 60 + 150 * 30
            held = {}
            for node in plan_nodes(found._jdf.queryExecution().executedPlan()):
                for metric in ("shuffleRecordsWritten", "numOutputRows"):
                    if node.nodeName().endswith(("Exchange", "Aggregate")) and node.metrics().contains(metric):
                        held[node.nodeName()] = max(held.get(node.nodeName(), 0), node.metrics().apply(metric).value())
            # Rules for everyone are there in 128 copies.
            assert held and max(held.values()) <= len(rows) + 30 * 128, held
    finally:
        spark.conf.set(name, before)


def test_odd_rules(spark):
    """Unknown roles count where there is no other; projects, addresses and restrictions may be missing or come twice."""
    users = spark.createDataFrame([("a@x",), ("a@x",), ("b@x",), ("c@y",), ("*",), (None,)], "email string")
    rows = [
        ("a@x", "p", "?"), ("*@x", "p", "READER"), ("*", "p", "OBSERVER"),
        ("a@x", "q", "?"), ("a@x", "q", None), ("*@x", "r", "?"), ("*", "r", "WRITER"),
        ("a@x", None, "ADMIN"), ("*@x", None, "READER"), ("*", None, "NONE"), (None, "p", "ADMIN"), ("*@z", "s", "ADMIN"),
    ]
    rules = spark.createDataFrame(rows, "email string, role_context string, role string")
    found = sorted(effective_role(users, rules).collect(), key=str)
    everyone = {"p": "OBSERVER", "r": "WRITER", None: "NONE"}
    expected = {(email, context): role for email in ("c@y", "*", None) for context, role in everyone.items()}
    expected |= {("a@x", "p"): "READER", ("a@x", "q"): None, ("a@x", "r"): "WRITER", ("a@x", None): "ADMIN"}
    expected |= {("b@x", "p"): "READER", ("b@x", "r"): "WRITER", ("b@x", None): "READER"}
    assert {(r["email"], r["role_context"]): r["role"] for r in found} == expected and len(found) == len(expected)
    caps = spark.createDataFrame(
        [("a@x", None, "METAREADER", None), ("a@x", None, "OBSERVER", None)],
        "email string, server_role string, default_project_role string, project_roles map<string,string>",
    )
    capped = [(r["role_context"], r["role"]) for r in effective_role(users, rules, caps).where("email = 'a@x'").collect()]
    assert sorted(capped, key=str) == sorted([(c, r) for c in ("p", "q", "r", None) for r in ("METAREADER", "OBSERVER")], key=str)


def test_key_restrictions(spark):
    caps = spark.createDataFrame(
        [("user@domain.com", "WRITER", "OBSERVER", {"p": "METAREADER"}), ("other@domain.com", None, "READER", None)],
        "email string, server_role string, default_project_role string, project_roles map<string,string>",
    )
    capped = roles(spark, caps=caps)
    assert capped["user", "_server"] == "WRITER" and capped["user", "p"] == "METAREADER" and capped["user", "q"] == "NONE"
    assert capped["other", "q"] == "READER" and capped["other", "p"] == "METAREADER" and capped["guest", "open"] == "OBSERVER"


LIMITED = {
    "text": Field("text", access="snippet", max_snippet=Snippet(50, 1, 20)),
    "title": Field("text", access="read"),
    "cat": Field("keyword"),
}


def test_allowed_fields():
    assert allowed_fields([LIMITED], ["METAREADER"]) == {"text": Snippet(50, 1, 20), "title": None}
    assert allowed_fields([LIMITED], ["READER"]) == {"text": None, "title": None, "cat": None}
    assert allowed_fields([LIMITED], ["OBSERVER"]) == allowed_fields([LIMITED], [None]) == {}
    other = {"text": Field("text", access="snippet", max_snippet=Snippet(10, 3, 30)), "title": Field("text")}
    assert allowed_fields([LIMITED, other], ["METAREADER", "METAREADER"]) == {"text": Snippet(10, 1, 20)}
    assert allowed_fields([LIMITED, other], ["METAREADER", "READER"]) == {"text": Snippet(50, 1, 20), "title": None}


@pytest.mark.parametrize("wanted,good", [
    (Snippet(50, 1, 20), True), (Snippet(49, 0, 19), True), (None, False),
    (Snippet(51, 1, 20), False), (Snippet(50, 2, 20), False), (Snippet(50, 1, 21), False),
])
def test_requests_above_the_limit_are_refused(wanted, good):
    check_request({"text": wanted}, LIMITED, "READER")
    if good:
        check_request({"text": wanted, "title": None}, LIMITED, "METAREADER")
    else:
        with pytest.raises(PermissionError):
            check_request({"text": wanted}, LIMITED, "METAREADER")
    for fields, role in (({"cat": None}, "METAREADER"), ({}, "OBSERVER")):
        with pytest.raises(PermissionError):
            check_request(fields, LIMITED, role)


def test_limited_view(docs):
    shown = project_allowed(docs, {"text": Snippet(5), "title": None}, "test")
    assert sorted(values(shown)) == [("1", "a test", "title"), ("2", "and this", "bla")]
