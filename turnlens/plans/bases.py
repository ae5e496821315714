"""SQL of the working tables, for the oracle: the same surrogates as ``sources.conversations`` in DuckDB's dialect."""

T = """t AS (SELECT conv_id AS dia_no, CAST(conv_id % 2 AS INTEGER) AS label, CAST(turn AS INTEGER) AS pos,
  CASE WHEN role = 'user' THEN 'user' ELSE 'system' END AS role, replace(text, chr(10), ' ') AS text FROM conversations)"""
_W = "regexp_split_to_array(trim(s), ' +')"
TA = f"""ta AS (SELECT *, list_transform(list_filter(regexp_split_to_array(text, '[.?!]+ *'), lambda s: trim(s) <> ''), lambda s: {{
  'intent': ['inform','request','greet','thank','bye'][length({_W}[1]) % 5 + 1], 'domain': 'general',
  'slot': ['name','price',''][length({_W}[-1]) % 3 + 1], 'value': CASE WHEN length({_W}[-1]) % 3 = 2 THEN '' ELSE {_W}[-1] END }}) AS acts FROM t)"""
U = "u AS (SELECT *, CAST(row_number() OVER (PARTITION BY dia_no, label ORDER BY pos) - 1 AS INTEGER) AS turn_no FROM t WHERE role = 'user')"
UA = "ua AS (SELECT *, CAST(row_number() OVER (PARTITION BY dia_no, label ORDER BY pos) - 1 AS INTEGER) AS turn_no FROM ta WHERE role = 'user')"
UT = "ut AS (SELECT dia_no, label, turn_no, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS tok FROM u)"
K = """k AS (SELECT dia_no, label, turn_no, CAST(i - 1 AS INTEGER) AS idx, tok[i] AS token, (length(tok[i]) % 5 - 2) / 10.0 AS score
  FROM (SELECT *, unnest(range(1, len(tok) + 1)) AS i FROM ut))"""
AX = """ax AS (SELECT dia_no, label, turn_no, CAST(i - 1 AS INTEGER) AS act_i, acts[i].intent AS intent, acts[i].domain AS domain, acts[i].slot AS slot, acts[i].value AS value
  FROM (SELECT *, unnest(range(1, len(acts) + 1)) AS i FROM ua))"""
P = """p AS (SELECT dia_no, label, turn_no, logit, 1 / (1 + exp(-logit)) AS prob, CAST(1 / (1 + exp(-logit)) >= 0.5 AS INTEGER) AS pred
  FROM (SELECT dia_no, label, turn_no, round(coalesce(sum(score), 0), 6) AS logit FROM ut LEFT JOIN k USING (dia_no, label, turn_no) GROUP BY ALL))"""
NG = """ng AS (SELECT dia_no, label, turn_no, n, lower(array_to_string(tok[i:i+n-1], ' ')) AS ngram, round(list_sum(sc[i:i+n-1]) / n, 9) AS score
  FROM (SELECT dia_no, label, turn_no, tok, list_transform(tok, lambda x: (length(x) % 5 - 2) / 10.0) AS sc, n, unnest(range(1, len(tok) - n + 2)) AS i
        FROM ut, (SELECT unnest([1, 2, 3]) AS n) WHERE len(tok) >= n))"""


#: Each turn with all but its three strongest tokens masked.
MASKED_TURNS = "SELECT dia_no, label, turn_no, coalesce(string_agg(CASE WHEN r <= 3 THEN token ELSE '<mask>' END, ' ' ORDER BY idx), '') AS masked_sample FROM ut LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY abs(score) DESC, idx) AS r FROM k) USING (dia_no, label, turn_no) GROUP BY ALL"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


#: Counts by class and scope of the n-grams, acts of the turn attached; then metrics.
COUNTS = """rows_ AS (SELECT ng.*, a.intent, a.domain, a.slot FROM ng JOIN (SELECT DISTINCT dia_no, label, turn_no, intent, domain, slot FROM ax) a USING (dia_no, label, turn_no)),
c AS (SELECT 'global' AS scope, '' AS intent, '' AS domain, '' AS slot, ngram, sum(CAST(score > 0 AS INTEGER)) AS a_n, sum(CAST(score < 0 AS INTEGER)) AS b_n,
   sum(CASE WHEN score > 0 THEN score ELSE 0 END) AS a_s, sum(CASE WHEN score < 0 THEN score ELSE 0 END) AS b_s FROM rows_ WHERE score <> 0 GROUP BY ngram
 UNION ALL SELECT 'act', intent, domain, slot, ngram, sum(CAST(score > 0 AS INTEGER)), sum(CAST(score < 0 AS INTEGER)),
   sum(CASE WHEN score > 0 THEN score ELSE 0 END), sum(CASE WHEN score < 0 THEN score ELSE 0 END) FROM rows_ WHERE score <> 0 GROUP BY intent, domain, slot, ngram)"""


def metric_sql(name: str) -> str:
    """CTE ``m``: scope, intent, domain, slot, ngram, score."""
    a, b = ("abs(a_s)", "abs(b_s)") if name in ("lsr", "fwlsr", "agg_s") else ("CAST(a_n AS DOUBLE)", "CAST(b_n AS DOUBLE)")
    own = "(2.0*(a+b)/(ta+tb))"
    logit = lambda x, t: f"ln(({x}+{own})/({t}+2.0-{x}-{own}+1e-9))"
    delta = f"({logit('a', 'ta')}-{logit('b', 'tb')})"
    score = {
        "lor": f"{delta}/sqrt(1/(a+{own}+1e-9)+1/(b+{own}+1e-9))",
        "fwlor": f"{delta}*sqrt((a+{own})/(ta+2.0)+(b+{own})/(tb+2.0))",
        "agg_o": "2.0*(CASE WHEN ta=0 THEN 0 ELSE a/ta END)-1.0*(CASE WHEN tb=0 THEN 0 ELSE b/tb END)",
    }[{"lsr": "lor", "fwlsr": "fwlor", "agg_s": "agg_o"}.get(name, name)]
    return f"""m AS (SELECT scope, intent, domain, slot, ngram, {score} AS score FROM
  (SELECT *, sum(a) OVER (PARTITION BY scope, intent, domain, slot) AS ta, sum(b) OVER (PARTITION BY scope, intent, domain, slot) AS tb
   FROM (SELECT scope, intent, domain, slot, ngram, {a} AS a, {b} AS b FROM c)))"""


PROFILE = with_(T, TA, U, UA, UT, AX, NG, COUNTS)
