"""What two of the queries mean, as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from docsieve.llm import quality, urls


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    stop = ", ".join(_quoted(x) for w in dict.fromkeys(quality.STOP_WORDS.split()) for x in (w, w.capitalize()))
    kept = ["NOT base_failed"]
    for rule in quality.RULES:
        top, bottom = rule.measure.split(" / ")
        value = f"{top}::DOUBLE / nullif({bottom}, 0)"
        kept += [f"coalesce({value} >= {rule.least}, false)"] if rule.least is not None else []
        kept += [f"coalesce({value} <= {rule.most}, false)"] if rule.most is not None else []
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (SELECT r, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
twice AS (
  SELECT r, i FROM win
  QUALIFY count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t-\r]*\z'))) AS n_open_lines,
    len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '^\P{{Ll}}*\p{{Lu}}\P{{Ll}}*\p{{Lu}}\P{{Ll}}*$'))) AS n_shouted
  FROM w LEFT JOIN rep USING (r)),
b AS (
  SELECT *, n_words < {quality.MIN_WORDS}
    OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  {" AND ".join(kept)} AS kept
FROM b"""


def url_sql(rules: Sequence[urls.UrlRule]) -> str:
    fits = {
        r: f"((host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)}))"
        for r in sorted(rules, key=lambda r: (-len(str(r)), str(r)))
    }
    text = " ".join(f"WHEN {f} THEN {_quoted(str(r))}" for r, f in fits.items())
    verdict = " ".join(f"WHEN {f} THEN {_quoted(r.verdict)}" for r, f in fits.items())
    s = float(urls.SMOOTHING)
    steps = [
        rf"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
seg AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS ss FROM q),
u AS (
  SELECT page_id, host, path, list_transform(ss[1:{urls.DEPTH}], lambda x: regexp_replace(x, '[0-9]+', '<n>', 'g'))
    || CASE WHEN len(ss) > {urls.DEPTH} THEN ['**'] ELSE [] END AS shape FROM seg),
l AS (
  SELECT doc_id, min(CASE WHEN quality = 0 OR toxic = 1 THEN 0 WHEN quality = 1 AND toxic = 0 THEN 1 END) AS good
  FROM labels GROUP BY doc_id),
sh AS (
  SELECT host, shape, count(*) AS n, count(good) AS l, coalesce(sum(good), 0)::BIGINT AS g
  FROM u LEFT JOIN l ON page_id = doc_id GROUP BY host, shape),
a AS (SELECT (coalesce(sum(g), 0)::DOUBLE + 1) / (coalesce(sum(l), 0)::DOUBLE + 2) AS al FROM sh),
h AS (SELECT host, (sum(g)::DOUBLE + any_value(al) * {s}) / (sum(l)::DOUBLE + {s}) AS purity FROM sh, a GROUP BY host),
t0 AS (SELECT sh.*, '' AS template, purity FROM sh JOIN h USING (host))"""
    ]
    for i in range(urls.DEPTH + 1):
        steps.append(f"""
b{i} AS (
  SELECT host, template, coalesce(shape[{i + 1}], '') AS segment, sum(n) AS n, sum(g)::DOUBLE AS g, sum(l)::DOUBLE AS l
  FROM t{i} GROUP BY ALL),
n{i} AS (SELECT host, template, (sum(g) + 1) / (sum(l) + 2) AS share FROM b{i} GROUP BY ALL),
s{i} AS (
  SELECT host, template, segment, g, l, CASE WHEN segment = '' THEN '' WHEN n >= {urls.MIN_PAGES}
    AND abs(g - l * share) > {urls.Z} * sqrt(l * share * (1 - share)) THEN '/' || segment ELSE '/*' END AS step
  FROM b{i} JOIN n{i} USING (host, template)),
m{i} AS (SELECT host, template, step, sum(g) AS g, sum(l) AS l FROM s{i} GROUP BY ALL),
t{i + 1} AS (
  SELECT t.host, t.shape, t.n, t.l, t.g, t.template || s.step AS template,
    CASE WHEN s.step = '' THEN purity ELSE (m.g + purity * {s}) / (m.l + {s}) END AS purity
  FROM t{i} t JOIN s{i} s ON s.host = t.host AND s.template = t.template AND s.segment = coalesce(t.shape[{i + 1}], '')
  JOIN m{i} m ON m.host = t.host AND m.template = t.template AND m.step = s.step)""")
    steps[-1] += f"""
SELECT page_id, host, path, CASE {text} END AS rule,
  coalesce(CASE {verdict} END, CASE WHEN purity < {urls.MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM u JOIN t{urls.DEPTH + 1} USING (host, shape)"""
    return ",".join(steps)
