"""Queries that list documents: projections, filters, word queries, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions.snippets import highlight, highlight_merge, highlight_strip, snippet_head
from docsieve.functions.text import Phrase, Prefix, Word, store_words
from docsieve.operators.access import allowed_fields, project_allowed
from docsieve.operators.filters import select
from docsieve.operators.scroll import snapshot
from docsieve.operators.search import next_batch, page_meta, project_fields, search
from docsieve.plans.corpora import (
    BENCHMARK,
    CONVERSATIONS,
    DOCUMENTS,
    EVENTS,
    ORDERS,
    RATED_DOCUMENTS,
    TAGGED_ORDERS,
    benchmark,
    conversations,
    documents,
    events,
    joined_sql,
    limited_fields,
    orders,
    pieces_sql,
    rated_documents,
    tagged_orders,
    words_sql,
)
from docsieve.plans.registry import query
from docsieve.schema import Field, Snippet
from docsieve.sources.projects import scan_multi, scan_project

N = joined_sql("text")


@query(
    "scan_project",
    f"SELECT _id, lang, n_chars FROM {DOCUMENTS} WHERE lang = 'en' AND n_chars >= 500",
)
def _(spark, sf_dir):
    filters = {"lang": "en", "n_chars": {"gte": 500}}
    return scan_project(documents(spark, sf_dir), filters=filters, exclude=["text", "source"])


@query(
    "scan_multi",
    f"""SELECT _id, text, lang, role FROM (
        SELECT _id, text, lang, NULL AS role FROM {DOCUMENTS}
        UNION ALL SELECT _id, text, NULL, role FROM {CONVERSATIONS}
        UNION ALL SELECT _id, text, NULL, NULL FROM {BENCHMARK})""",
)
def _(spark, sf_dir):
    projects = [documents(spark, sf_dir), conversations(spark, sf_dir), benchmark(spark, sf_dir)]
    return project_fields(scan_multi(projects), ["text", "lang", "role"])


@query("project_fields", f"SELECT _id, source, lang FROM {DOCUMENTS}")
def _(spark, sf_dir):
    return project_fields(documents(spark, sf_dir), ["source", "lang"])


@query(
    "snippet_head",
    f"""SELECT _id, substr(text, 1, 60)
        || regexp_extract(substr(text, 61), '^(?:[\\p{{L}}\\p{{M}}\\p{{N}}_]+|(?s:.))') AS text FROM {DOCUMENTS}""",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), fields={"text": Snippet(nomatch_chars=60)}, page=None)


_MARK = "'<em>' || x || '</em>'"
_HEAD = (
    r"CASE WHEN length({0}) <= 20 THEN {0}"
    r" ELSE regexp_replace(left({0}, 21), '(?:[\p{{L}}\p{{M}}\p{{N}}_]+|(?s:.))$', '') END"
)
_TAIL = (
    r"CASE WHEN length({0}) <= 20 THEN {0}"
    r" ELSE regexp_replace(right({0}, 21), '^(?:[\p{{L}}\p{{M}}\p{{N}}_]+|(?s:.))', '') END"
)


@query(
    "snippet_matches",
    f"""WITH d AS (SELECT _id, list_transform({pieces_sql("text")}, lambda x:
            CASE WHEN lower(x) = 'that' THEN chr(2) || x || chr(3) ELSE x END) AS pieces FROM {DOCUMENTS}
          WHERE contains({N}, ' that ')),
        parts AS (SELECT _id, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS part
          FROM (SELECT _id, string_split(array_to_string(pieces, ''), chr(2)) AS p FROM d)),
        cut AS (SELECT _id, k, CASE WHEN k = 0 THEN '' ELSE string_split(part, chr(3))[1] END AS hit,
            CASE WHEN k = 0 THEN part ELSE string_split(part, chr(3))[2] END AS after FROM parts),
        around AS (SELECT *, {_HEAD.format("after")} AS tail, lag(after) OVER (PARTITION BY _id ORDER BY k) AS gap
          FROM cut),
        rest AS (SELECT *, CASE WHEN k = 1 THEN gap
            ELSE substr(gap, length(lag(tail) OVER (PARTITION BY _id ORDER BY k)) + 1) END AS before FROM around)
        SELECT _id, string_agg(trim({_TAIL.format("before")} || '<em>' || hit || '</em>' || tail), ' ... ' ORDER BY k)
          AS text FROM rest WHERE k BETWEEN 1 AND 3 GROUP BY _id""",
)
def _(spark, sf_dir):
    wanted = {"text": Snippet(nomatch_chars=60, max_matches=3, match_chars=40)}
    return search(documents(spark, sf_dir), "text:that", fields=wanted, page=None, highlight=True)


@query(
    "highlight",
    f"""SELECT _id, lang, array_to_string(list_transform({pieces_sql("text")}, lambda x:
          CASE WHEN lower(x) = 'the' OR starts_with(lower(x), 'eau') THEN {_MARK} ELSE x END), '') AS text
        FROM {DOCUMENTS} WHERE contains({N}, ' the ') OR contains({N}, ' eau')""",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "the eau*", fields=["text", "lang"], page=None, highlight=True)


@query(
    "highlight_merge",
    f"""SELECT _id, replace(array_to_string(list_transform({pieces_sql("text")}, lambda x:
          CASE WHEN lower(x) IN ('of', 'the') THEN {_MARK} ELSE x END), ''), '</em> <em>', ' ') AS merged,
          text AS plain FROM {DOCUMENTS}""",
)
def _(spark, sf_dir):
    marked = documents(spark, sf_dir).withColumn("marked", highlight(F.col("text"), "of the"))
    return marked.select(
        "_id", highlight_merge(F.col("marked")).alias("merged"), highlight_strip(F.col("marked")).alias("plain")
    )


@query(
    "project_allowed",
    f"""SELECT _id, lang, n_chars, substr(text, 1, 40)
        || regexp_extract(substr(text, 41), '^(?:[\\p{{L}}\\p{{M}}\\p{{N}}_]+|(?s:.))') AS text FROM {DOCUMENTS}""",
)
def _(spark, sf_dir):
    # Two projects with different limits: what is shown keeps to the smaller one.
    other = {**limited_fields(), "text": Field("text", access="snippet", max_snippet=Snippet(90, 3, 60))}
    allowed = allowed_fields([limited_fields(), other], ["METAREADER", "METAREADER"])
    return project_allowed(documents(spark, sf_dir), allowed)


# Filters


@query("filter_values", f"SELECT _id, lang, source FROM {DOCUMENTS} WHERE lang IN ('de', 'fr')")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), filters={"lang": ["de", "fr"]}, fields=["lang", "source"], page=None)


@query("filter_values_text", f"SELECT _id FROM {DOCUMENTS} WHERE contains({N}, ' the ') OR contains({N}, ' les ')")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), filters={"text": ["the", "les", "Not One Word"]}, page=None)


@query(
    "filter_values_tag",
    f"SELECT _id, array_to_string(tags, ',') AS tags FROM {TAGGED_ORDERS} WHERE list_has_any(tags, ['URGENT', 'P'])",
)
def _(spark, sf_dir):
    found = select(tagged_orders(spark, sf_dir), filters={"tags": ["URGENT", "P"]})
    return found.select("_id", F.array_join("tags", ",").alias("tags"))


@query(
    "filter_values_date",
    f"SELECT _id, ts FROM {EVENTS} WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-17')",
)
def _(spark, sf_dir):
    filters = {"ts": ["2024-01-03", "2024-01-17"]}
    return search(events(spark, sf_dir), filters=filters, fields=["ts"], page=None)


@query(
    "filter_range",
    f"""SELECT _id, o_orderdate, o_totalprice FROM {ORDERS}
        WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND CAST(o_orderdate AS DATE) <= DATE '1998-02-28'
          AND o_totalprice > 100000 AND o_totalprice < 250000.5""",
)
def _(spark, sf_dir):
    filters = {
        "o_orderdate": {"gte": "1996-03-01", "lte": "1998-02"},
        "o_totalprice": {"gt": 100000, "lt": 250000.5},
    }
    return search(orders(spark, sf_dir), filters=filters, fields=["o_orderdate", "o_totalprice"], page=None)


@query("filter_exists", f"SELECT _id, quality FROM {RATED_DOCUMENTS} WHERE quality IS NOT NULL")
def _(spark, sf_dir):
    return search(rated_documents(spark, sf_dir), filters={"quality": {"exists": True}}, fields=["quality"], page=None)


@query("filter_missing", f"SELECT _id, lang FROM {RATED_DOCUMENTS} WHERE quality IS NULL")
def _(spark, sf_dir):
    return search(rated_documents(spark, sf_dir), filters={"quality": {"exists": False}}, fields=["lang"], page=None)


@query(
    "filter_datepart",
    f"SELECT _id, ts FROM {EVENTS} WHERE (dayname(ts) = 'Monday' OR hour(ts) < 6) AND event_type = 'click'",
)
def _(spark, sf_dir):
    filters = {"ts": {"dayofweek": "Monday", "daypart": "Night"}, "event_type": "click"}
    return search(events(spark, sf_dir), filters=filters, fields=["ts"], page=None)


@query(
    "filter_combine",
    f"""SELECT _id, lang, n_chars, quality FROM {RATED_DOCUMENTS}
        WHERE (quality = 1 OR quality IS NULL) AND (n_chars IN (100, 200) OR (n_chars >= 1000 AND n_chars < 5000))""",
)
def _(spark, sf_dir):
    filters = {
        "quality": {"values": [1], "exists": False},
        "n_chars": {"values": [100, 200], "gte": 1000, "lt": 5000},
        "lang": [],
    }
    return search(rated_documents(spark, sf_dir), filters=filters, fields=["lang", "n_chars", "quality"], page=None)


@query("filter_ids", f"SELECT _id, lang FROM {DOCUMENTS} WHERE _id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def _(spark, sf_dir):
    rated = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("_id"))
    return project_fields(select(documents(spark, sf_dir), ids=rated), ["lang"])


@query("filter_id_list", f"SELECT _id, lang FROM {DOCUMENTS} WHERE _id IN ('3', '17', '20', '101')")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), ids="3, 17\n20,101,none", fields=["lang"], page=None)


# Word queries


@query("match_word", f"SELECT _id, lang FROM {DOCUMENTS} WHERE contains({N}, ' that ') OR lang = 'that'")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "that", fields=["lang"], page=None)


@query("match_word_keyword", f"SELECT _id, lang FROM {DOCUMENTS} WHERE contains({N}, ' es ') OR lang = 'es'")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "es", fields=["lang"], page=None)


@query("match_prefix", f"SELECT _id, lang FROM {DOCUMENTS} WHERE contains({N}, ' eau')")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "eau*", fields=["lang"], page=None)


@query("match_phrase", f"SELECT _id, lang FROM {DOCUMENTS} WHERE contains({N}, ' of the ')")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), '"of the"', fields=["lang"], page=None)


@query(
    "match_bool",
    f"""SELECT _id, lang FROM {DOCUMENTS} WHERE (contains({N}, ' the ') OR contains({N}, ' der '))
        AND NOT contains({N}, ' und ') AND (contains({N}, ' that ') OR contains({N}, ' was '))""",
)
def _(spark, sf_dir):
    tree = (Word("the") | Word("der")) & ~Word("und") & (Word("that") | Word("was"))
    return search(documents(spark, sf_dir), tree, fields=["lang"], page=None)


@query(
    "match_bool_typed",
    f"SELECT _id FROM {DOCUMENTS} WHERE contains({N}, ' the ') AND contains({N}, ' with ') AND NOT contains({N}, ' by ')",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "the AND with NOT by", page=None)


@query(
    "match_labels",
    f"""SELECT _id, lang FROM {DOCUMENTS}
        WHERE contains({N}, ' that ') OR contains({N}, ' eau') OR contains({N}, ' und der ')""",
)
def _(spark, sf_dir):
    labels = {"word": Word("that"), "start": Prefix("eau"), "phrase": Phrase("und der")}
    return search(documents(spark, sf_dir), labels, fields=["lang"], page=None)


# A thousand made-up labels: words and starts of two syllables, and phrases of two frequent words.
_SYLLABLES = [c + v for c in "bcdfghjklmnprstvz" for v in "aeiou"]
_MANY_WORDS = [a + b for a in _SYLLABLES for b in _SYLLABLES][::21][:334]
_MANY_STARTS = [a + b for a in _SYLLABLES for b in _SYLLABLES][7::21][:333]
_FREQUENT = "the of and to in that was der und die den von de la le les et des el los del en".split()
_MANY_PHRASES = [f"{a} {b}" for a in _FREQUENT for b in _FREQUENT if a > b][:231] + [f"{a} {a}" for a in _FREQUENT]
_MANY_PHRASES += [f"{a} {b} {c}" for a, b, c in zip(_FREQUENT * 4, _FREQUENT[3:] * 5, _FREQUENT[1:] * 5)][:80]


def _many_labels():
    leaves = [*map(Word, _MANY_WORDS), *map(Prefix, _MANY_STARTS), *map(Phrase, _MANY_PHRASES)]
    return {f"label {i}": leaf for i, leaf in enumerate(leaves)}


def _sql_list(texts) -> str:
    return "[" + ", ".join(f"'{text}'" for text in texts) + "]"


_MANY_SQL = f"""list_has_any(w, {_sql_list(_MANY_WORDS)})
    OR list_has_any(list_transform(w, lambda x: left(x, 4)), {_sql_list(t for t in _MANY_STARTS if len(t) == 4)})
    OR list_has_any(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                    {_sql_list(t for t in _MANY_PHRASES if t.count(" ") == 1)})
    OR list_has_any(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
                    {_sql_list(t for t in _MANY_PHRASES if t.count(" ") == 2)})"""
_MANY_VALUES = " OR ".join(
    f"{field} IN (SELECT unnest({_sql_list(_MANY_WORDS + _MANY_PHRASES)}))"
    f" OR left({field}, 4) IN (SELECT unnest({_sql_list(_MANY_STARTS)}))"
    for field in ("lang", "source")
)


@query(
    "match_labels_many",
    f"""SELECT _id, lang FROM (SELECT _id, lang, source, {words_sql("text")} AS w FROM {DOCUMENTS})
        WHERE {_MANY_SQL} OR {_MANY_VALUES}""",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), _many_labels(), fields=["lang"], page=None)


@query("match_stored_words", f"SELECT _id FROM {DOCUMENTS} WHERE contains({N}, ' that ') AND contains({N}, ' on the ')")
def _(spark, sf_dir):
    return search(store_words(documents(spark, sf_dir), "text"), 'that AND "on the"', page=None)


@query(
    "match_field",
    f"SELECT _id FROM {RATED_DOCUMENTS} WHERE lang = 'de' AND contains({N}, ' der ') AND quality IS NOT NULL",
)
def _(spark, sf_dir):
    return search(rated_documents(spark, sf_dir), "lang:de AND text:der AND _exists_:quality", page=None)


@query(
    "match_field_values",
    f"""SELECT _id, o_orderstatus, o_totalprice FROM {TAGGED_ORDERS}
        WHERE (o_totalprice >= 100000 AND o_totalprice < 250000.5) AND o_orderdate >= TIMESTAMP '1996-03-01'
          AND CAST(o_orderdate AS DATE) <= DATE '1998-02-28' AND o_orderstatus IN ('F', 'O') AND NOT o_custkey = 7
          AND tags IS NOT NULL AND len(tags) > 0""",
)
def _(spark, sf_dir):
    typed = (
        "+o_totalprice:[100000 TO 250000.5} +o_orderdate:[1996-03-01 TO 1998-02] +o_orderstatus:[F TO O]"
        " +_exists_:tags -o_custkey:7"
    )
    return search(tagged_orders(spark, sf_dir), typed, fields=["o_orderstatus", "o_totalprice"], page=None)


@query(
    "match_wildcard",
    f"SELECT _id FROM {DOCUMENTS} WHERE regexp_matches({N}, ' th[^ ]t ') OR regexp_matches({N}, ' eau[^ ]*ai ')",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "th?t eau*ai", page=None)


@query(
    "match_regex",
    f"SELECT _id FROM {DOCUMENTS} WHERE len(list_filter({words_sql('text')},"
    " lambda x: regexp_full_match(x, 'h(er|ea).*ing'))) > 0",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "/h(er|ea).*ing/", page=None)


@query(
    "match_near",
    f"""WITH w AS (SELECT _id, unnest(range(1, len(t) + 1)) AS p, unnest(t) AS word
          FROM (SELECT _id, {words_sql("text")} AS t FROM {DOCUMENTS})),
        a AS (SELECT _id, p FROM w WHERE word = 'by'), b AS (SELECT _id, p FROM w WHERE word = 'with')
        SELECT DISTINCT a._id FROM a JOIN b ON a._id = b._id WHERE abs(b.p - 1 - a.p) <= 4""",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), '"by with"~4', page=None)


@query(
    "match_near_repeated",
    f"""WITH w AS (SELECT _id, unnest(range(1, len(t) + 1)) AS p, unnest(t) AS word
          FROM (SELECT _id, {words_sql("text")} AS t FROM {DOCUMENTS})),
        the AS (SELECT _id, p, lead(p) OVER (PARTITION BY _id ORDER BY p) AS q FROM w WHERE word = 'the')
        SELECT DISTINCT _id FROM the WHERE q - 1 - p <= 2""",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), '"the the"~2', page=None)


@query(
    "match_fuzzy",
    f"SELECT _id FROM {DOCUMENTS} WHERE len(list_filter({words_sql('text')},"
    " lambda x: damerau_levenshtein(x, 'hteres') <= 1)) > 0",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "hteres~1", fields=None, page=None)


# Sorting and paging


@query(
    "sort_multi",
    f"""SELECT _id, quality, n_chars, row_number() OVER (ORDER BY quality DESC NULLS LAST, n_chars, _id) AS place
        FROM {RATED_DOCUMENTS} ORDER BY place LIMIT 200""",
)
def _(spark, sf_dir):
    # The place is made from the rows as they come out, so it shows their order.
    found = search(
        rated_documents(spark, sf_dir),
        fields=["quality", "n_chars"],
        sort=[{"quality": {"order": "desc"}}, "n_chars"],
        per_page=200,
    )
    return found.select("*", (F.monotonically_increasing_id() + 1).alias("place"))


@query("sort_random", f"SELECT _id, lang FROM {DOCUMENTS} ORDER BY md5(_id || ':42'), _id LIMIT 100")
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), fields=["lang"], sort="?", per_page=100, seed=42)


@query(
    "page",
    f"SELECT _id, n_chars, lang FROM {DOCUMENTS} WHERE lang = 'en' ORDER BY n_chars DESC, _id LIMIT 20 OFFSET 60",
)
def _(spark, sf_dir):
    return search(
        documents(spark, sf_dir),
        filters={"lang": "en"},
        fields=["n_chars", "lang"],
        sort={"n_chars": "desc"},
        page=3,
        per_page=20,
    )


@query(
    "page_far",
    f"""SELECT _id, o_orderstatus, o_totalprice FROM {ORDERS}
        ORDER BY o_orderstatus, o_totalprice DESC, _id LIMIT 100 OFFSET (SELECT count(*) - 250 FROM {ORDERS})""",
)
def _(spark, sf_dir):
    # Near the end of a snapshot, where a page is read from one or two of its ranges.
    df = project_fields(orders(spark, sf_dir), ["o_orderstatus", "o_totalprice"])
    sorted_orders = snapshot(df, ["o_orderstatus", {"o_totalprice": "desc"}])
    return sorted_orders.rows(sorted_orders.total - 250, 100)


@query(
    "scroll_after",
    f"""SELECT _id, quality, n_chars FROM {RATED_DOCUMENTS}
        WHERE quality < 1 OR quality IS NULL OR (quality = 1 AND (n_chars > 3000 OR (n_chars = 3000 AND _id > '5')))
        ORDER BY quality DESC NULLS LAST, n_chars, _id LIMIT 150""",
)
def _(spark, sf_dir):
    df = project_fields(rated_documents(spark, sf_dir), ["quality", "n_chars"])
    cursor = {"quality": 1, "n_chars": 3000, "_id": "5"}
    return snapshot(df, [{"quality": "desc"}, "n_chars"]).after(cursor, 150)


@query(
    "page_meta",
    f"""SELECT count(*) AS total_count, 20 AS per_page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS page_count, 3 AS page
        FROM {DOCUMENTS} WHERE contains({N}, ' the ')""",
)
def _(spark, sf_dir):
    return page_meta(documents(spark, sf_dir), 20, 3, "the")


@query(
    "page_after",
    f"""SELECT _id, n_chars, lang FROM {DOCUMENTS} WHERE n_chars < 3000 OR (n_chars = 3000 AND _id > '5')
        ORDER BY n_chars DESC, _id LIMIT 100""",
)
def _(spark, sf_dir):
    df = project_fields(documents(spark, sf_dir), ["n_chars", "lang"])
    return next_batch(df, 100, after={"n_chars": 3000, "_id": "5"}, sort={"n_chars": "desc"})
