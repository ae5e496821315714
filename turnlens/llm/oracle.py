"""SQL that gives the rows of those queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

import re

from . import decontamination, fill_middle, html_text, lexical_search, secrets, url_filter

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings),
w AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
s AS (SELECT x, count(*) AS copies FROM w GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, component_id, component_id = v.vec_id AS kept, coalesce(s.copies, 1) AS copies
FROM v JOIN c USING (vec_id) LEFT JOIN s ON s.x = v.x
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh FROM d),
cl AS (SELECT min(doc_id) AS id, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT id, n, unnest(sh) AS t FROM cl),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t = b.t AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
r(a, b) AS (SELECT id, id FROM cl UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS comp FROM r GROUP BY a)
SELECT doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp, doc_id) AS component_id, coalesce(comp, doc_id) = doc_id AS kept, coalesce(cl.id, doc_id) AS class_id
FROM s LEFT JOIN cl ON cl.sh = s.sh LEFT JOIN c ON c.id = cl.id
"""


def _glob(g: str) -> str:
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p).replace("/", "/")) for p in re.split(r"(\*\*|\*|\?)", g) if p) + "$"


def _urls() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(v)}, {quoted(r)}, {quoted(r[: r.index('/')])}, {quoted(r[r.index('/') :])})" for v, r in url_filter.RULES)
    glob = "CASE " + " ".join(f"WHEN regexp_matches(host || path, {quoted('(?s)' + _glob(g))}) THEN {quoted(g)}" for g in url_filter.GLOBS) + " END"
    return f"""
WITH h AS (SELECT page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(v, rule, rh, rp) AS (VALUES {rules}),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
g AS (SELECT *, {glob} AS gl FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN gl IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN rule IS NULL THEN gl END AS "glob" FROM g LEFT JOIN f USING (page_id)
"""


def _secrets() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, (kind, pattern, group, least) in enumerate((*secrets.BASE, *secrets.WEAK)):
        parts.append(f"SELECT doc_id, {i} AS kind, text, regexp_extract_all(text, {quoted(pattern)}) AS m, regexp_extract_all(text, {quoted(pattern)}, {group}) AS q, string_split_regex(text, {quoted(pattern)}) AS g, {least} AS least FROM d")
    names = "[" + ", ".join(quoted(k) for k in secrets.ORDER) + "]"
    at = {k: i for i, k in enumerate(secrets.ORDER)}
    some = lambda kinds: ", ".join(str(at[k]) for k in kinds)
    near = f"(b.s - a.e <= {secrets.SCOPE} AND a.s - b.e <= {secrets.SCOPE} AND (b.s >= a.e OR b.e <= a.s))"
    exists = lambda kinds: f"EXISTS (SELECT 1 FROM sp b WHERE b.doc_id = a.doc_id AND b.kind IN ({some(kinds)}) AND {near})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
sp AS (SELECT doc_id, kind, e - length(m[i]) AS s, e FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y))) AS BIGINT) AS e FROM i) WHERE length(q[i]) >= least),
op AS (SELECT * FROM sp a WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM sp b WHERE b.doc_id = a.doc_id AND b.kind < 3 AND b.s < a.e AND a.s < b.e)),
lk AS (SELECT * FROM op a WHERE kind = {at["identity"]} AND {exists(secrets.SECRET)} OR kind = {at["random"]} AND {exists(secrets.IDENTITY)} OR kind = {at["endpoint"]} AND {exists(secrets.IDENTITY)} AND {exists(secrets.SECRET)}),
al AS (SELECT * FROM sp WHERE kind < 3 UNION ALL SELECT * FROM lk),
o AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind >= 3) AS n_linked,
  string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans FROM al GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN o USING (doc_id)
"""


ORACLE = {
    "op3_embeddings": VECTORS,
    "op4_decontamination": decontamination.ORACLE,
    "op5_minhash": MINHASH,
    "op6_urls": _urls(),
    "op9_secrets": _secrets(),
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_html_text": html_text.ORACLE,
    "op13_search": lexical_search.ORACLE,
}
