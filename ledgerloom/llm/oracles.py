"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .licenses import LEAST_SHARE, TEMPLATES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URLS = f"""
WITH u AS (
  SELECT page_id, url,
    coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT u.page_id, u.host, u.path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best
"""


def _licenses() -> str:
    """Words meet the templates' words in a join; what a template has at one start is summed up. No index, no rare words."""
    rows = ", ".join(f"({k}, '{t.label}', '{t.licence}', {t.base}, {j}, '{w}', {j in t.mandatory()})" for k, t in enumerate(TEMPLATES) for j, w in enumerate(t.words()))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d),
t0(t, label, licence, base, j, w, must) AS (VALUES {rows}),
f AS (SELECT w, count(DISTINCT doc_id) AS n FROM e WHERE w IN (SELECT w FROM t0) GROUP BY w),
t1 AS (SELECT t0.*, greatest(1, floor(1000 * ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(n, 0))) + 0.5))::BIGINT AS x FROM t0 LEFT JOIN f USING (w)),
s AS (SELECT t, any_value(label) AS label, any_value(licence) AS licence, any_value(base) AS base, sum(x) AS total, count(*) FILTER (WHERE must) AS musts FROM t1 GROUP BY t),
l AS (SELECT licence, max(total) AS whole FROM s GROUP BY licence),
h AS (SELECT doc_id, t, i - j AS pos, sum(x) AS held, count(*) FILTER (WHERE must) AS stood FROM e JOIN t1 USING (w) GROUP BY ALL),
m AS (SELECT doc_id, pos, label, base, (held / whole)::DOUBLE AS share FROM h JOIN s USING (t) JOIN l USING (licence) WHERE stood = musts AND held >= {LEAST_SHARE} * total),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(pos) FILTER (WHERE base) AS first_word, max(pos) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(share) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(b, '') AS base_labels, coalesce(l, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, s.owner IS NOT NULL AND k.doc_id <> s.owner AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


#: Kind, pattern, the group of the match itself, the group of its value, the value's fewest characters. A token's pattern
#: takes the character before it, too, since this dialect can't look behind.
SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, 15),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 1, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 1),
)


def _secrets() -> str:
    def matches(no, name, pattern, whole, value, least):
        pattern = pattern.replace("'", "''")
        return f"""SELECT doc_id, source, {no} AS kind, '{name}' AS name, {least} AS least, unnest(c) AS m, unnest(v) AS v, unnest(m) AS t, generate_subscripts(m, 1) AS i, m AS ms, p
  FROM (SELECT doc_id, source, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {whole}) AS c, regexp_extract_all(text, '{pattern}', {value}) AS v, string_split_regex(text, '{pattern}') AS p FROM documents)"""

    every = " UNION ALL ".join(matches(no, *k) for no, k in enumerate(SECRETS))
    return f"""
WITH a AS ({every}),
s AS (SELECT doc_id, source, kind, name, v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) + length(t) - length(m) AS s, length(m) AS n
  FROM a WHERE length(v) >= least),
o AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM s GROUP BY v),
j AS (SELECT s.*, owners, repositories, owners >= 3 OR (owners > 1 AND repositories >= 10) AS copied, kind < 3 AS base, name || ':' || (s::BIGINT) || ':' || ((s + n)::BIGINT) AS t FROM s JOIN o USING (v)),
g AS (SELECT doc_id, count(*) FILTER (WHERE name = 'assign') AS n_assign, count(*) FILTER (WHERE name = 'access') AS n_access, count(*) FILTER (WHERE name = 'hex') AS n_hex,
  string_agg(t, ',' ORDER BY s, kind) FILTER (WHERE base) AS b, string_agg(t, ',' ORDER BY s, kind) AS spans, count(*) FILTER (WHERE NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_example,
  max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM documents LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = {"op7_secret_scan": _secrets(), "op3_url_filters": URLS, "op4_license_scan": _licenses(), "op8_line_dedup": LINES}
