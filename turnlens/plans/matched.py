"""From tokens matched with acts to profiles: match, phrases, slot tags, n-grams, and removal orders that profiles give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import matching as M
from ..operators import profile as PR
from ..sources import conversations as C
from . import bases as B
from . import profiles
from .registry import HE, KEY, TAG_SQL, query, r6

TURN = "dia_no, label, turn_no"
#: Tokens and acts of a turn as vectors, their similarity, and what a token keeps: within 0.9 of the range of its row.
PAIRS_SQL = f"""tv AS (SELECT {TURN}, idx AS i, token, score, {HE.format("lower(token)")} AS x FROM k),
 av AS (SELECT {TURN}, act_i AS j, intent, domain, slot, value, {HE.format("lower(trim(regexp_replace(concat_ws(' ', intent, slot, value), ' +', ' ', 'g')))")} AS x FROM ax),
 sm AS (SELECT {TURN}, i, j, list_cosine_similarity(tv.x, av.x) AS sim FROM tv JOIN av USING ({TURN})),
 rk AS (SELECT *, row_number() OVER (PARTITION BY {TURN}, i ORDER BY sim DESC, j) AS ri, row_number() OVER (PARTITION BY {TURN}, j ORDER BY sim DESC, i) AS rj FROM sm),
 ct AS (SELECT {TURN}, i, j, round_even(2 * sim - avg(CASE WHEN ri <= 5 THEN sim END) OVER (PARTITION BY {TURN}, i) - avg(CASE WHEN rj <= 5 THEN sim END) OVER (PARTITION BY {TURN}, j), 4) AS csls FROM rk),
 mt AS (SELECT {TURN}, i, j, csls FROM (SELECT *, min(csls) OVER w + 0.9 * (max(csls) OVER w - min(csls) OVER w) AS lim FROM ct WINDOW w AS (PARTITION BY {TURN}, i)) WHERE csls >= lim)"""
#: Phrases of the tokens that belong to an act: runs of neighbours, the act's value tagged, runs of the tag as one token.
SPANS_SQL = f"""mr AS (SELECT {TURN}, i, j, token, score, intent, domain, slot, value FROM mt JOIN tv USING ({TURN}, i) JOIN av USING ({TURN}, j)),
 il AS (SELECT *, i - row_number() OVER (PARTITION BY {TURN}, j ORDER BY i) AS g, CASE WHEN slot <> '' AND value <> '' THEN {TAG_SQL.format(text="token", value="value", slot="slot")} ELSE token END AS t FROM mr),
 lg AS (SELECT *, CASE WHEN t = '<' || slot || '>' AND coalesce(lag(t) OVER (PARTITION BY {TURN}, j, g ORDER BY i) = t, false) THEN 0 ELSE 1 END AS fresh FROM il),
 rn AS (SELECT *, sum(fresh) OVER (PARTITION BY {TURN}, j, g ORDER BY i) AS run FROM lg),
 tk AS (SELECT {TURN}, j, g, run, intent, domain, slot, any_value(t) AS t, avg(score) AS s, sum(score) AS total, count(*) AS held, min(i) AS i FROM rn GROUP BY ALL),
 ph AS (SELECT {TURN}, j, intent, domain, slot, min(i) AS first, list(t ORDER BY run) AS tok, list(s ORDER BY run) AS sc, sum(total) / sum(held) AS utt_expl FROM tk GROUP BY {TURN}, j, g, intent, domain, slot)"""
MATCHED = B.with_(B.T, B.TA, B.U, B.UA, B.UT, B.K, B.AX, PAIRS_SQL)
GRAMS_SQL = """rows_ AS (SELECT intent, domain, slot, lower(array_to_string(tok[q:q+n-1], ' ')) AS ngram, round(list_sum(sc[q:q+n-1]) / n, 9) AS score
   FROM (SELECT *, unnest(range(1, len(tok) - n + 2)) AS q FROM ph, (SELECT unnest([1, 2, 3]) AS n) WHERE len(tok) >= n)),
 """ + B.COUNTS[B.COUNTS.index("c AS (") :]


def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    return C.explained_tokens(spark, d).select(*KEY, F.col("idx").alias("i"), "token", "score", M.hashed_embedding(F.lower("token")).alias("vec"))


def act_vectors(spark: SparkSession, d: str) -> DataFrame:
    text = M.da_to_text(F.col("intent"), F.col("slot"), F.col("value"))
    return profiles.turn_acts(spark, d).select(*KEY, F.col("act_i").alias("j"), "intent", "domain", "slot", "value", M.hashed_embedding(F.lower(text)).alias("vec"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    return M.match_corpus(token_vectors(spark, d).select(*KEY, "i", "vec"), act_vectors(spark, d).select(*KEY, "j", "vec"), KEY)


def phrases_of(spark: SparkSession, d: str) -> DataFrame:
    rows = matches(spark, d).join(token_vectors(spark, d).drop("vec"), [*KEY, "i"]).join(act_vectors(spark, d).drop("vec"), [*KEY, "j"])
    return PR.phrases(rows.withColumnRenamed("i", "idx"), [*KEY, "j", "intent", "domain"], "value", "slot")


def matched_rows(spark: SparkSession, d: str, max_n: int = 3) -> DataFrame:
    """N-grams of matched phrases with the act that they belong to: what profiles are built from."""
    grams = PR.ngrams(F.transform("tokens", lambda t: F.lower(t)), F.col("scores"), max_n)
    rows = phrases_of(spark, d).select("intent", "domain", "slot", F.explode(grams).alias("g"))
    return rows.select("intent", "domain", "slot", F.col("g.ngram").alias("ngram"), F.round("g.score", 9).alias("score"))


@query("match_corpus", MATCHED + f"SELECT {TURN}, i, j, csls FROM mt")
def match_corpus(spark, d):
    return matches(spark, d).select(*KEY, "i", "j", "csls")


@query("match_assemble", MATCHED + f" SELECT {TURN}, j, any_value((length(av.value) % 5 - 2) / 10.0) AS da_expl, count(*) AS n, round(avg(score), 6) + 0.0 AS utt_expl, string_agg(token, ' ' ORDER BY i) AS tokens FROM mt JOIN tv USING ({TURN}, i) JOIN av USING ({TURN}, j) GROUP BY {TURN}, j")
def match_assemble(spark, d):
    acts = act_vectors(spark, d).select(*KEY, "j", C.lexicon_weight(F.col("value")).alias("da_expl"))
    rows = M.match_assemble(matches(spark, d), token_vectors(spark, d).select(*KEY, "i", "token", "score"), acts, KEY)
    return rows.select(*KEY, "j", "da_expl", F.size("utt").cast("long").alias("n"), (r6("utt_expl") + 0.0).alias("utt_expl"), F.array_join(F.transform("utt", lambda x: x["token"]), " ").alias("tokens"))


@query("matched_phrases", MATCHED + "," + SPANS_SQL + f" SELECT {TURN}, j, first, array_to_string(tok, ' ') AS phrase, round(utt_expl, 6) + 0.0 AS utt_expl FROM ph")
def matched_phrases(spark, d):
    return phrases_of(spark, d).select(*KEY, "j", "first", "phrase", (r6("utt_expl") + 0.0).alias("utt_expl"))


def _profile_query(name: str) -> None:
    @query(f"matched_profile_{name}", MATCHED + "," + SPANS_SQL + "," + GRAMS_SQL + "," + B.metric_sql(name) + " SELECT scope, intent, domain, slot, ngram, round(score, 6) AS score FROM m")
    def run(spark, d):
        return PR.profile_build(matched_rows(spark, d), name).select("scope", "intent", "domain", "slot", "ngram", r6("score").alias("score"))


for _name in ("fwlor", "agg_s"):
    _profile_query(_name)


# Removal orders --------------------------------------------------------------------------------------------------------

WORDS_SQL = B.PROFILE + "," + B.metric_sql("agg_s").replace("m AS (", "m AS MATERIALIZED (", 1) + "," + B.K + "," + B.P + f""",
 wd AS MATERIALIZED (SELECT {TURN}, lower(token) AS token, max(score) AS own, any_value(pred) AS pred FROM k JOIN p USING ({TURN}) GROUP BY {TURN}, lower(token)),
 kn AS MATERIALIZED (SELECT DISTINCT {TURN}, intent, domain, slot FROM ax SEMI JOIN (SELECT * FROM m WHERE scope = 'act') USING (intent, domain, slot)),
 ac AS MATERIALIZED (SELECT {TURN}, ngram AS token, sum(q.score) AS score FROM wd JOIN kn USING ({TURN}) JOIN (SELECT intent AS i2, domain AS d2, slot AS s2, ngram, score FROM m WHERE scope = 'act') q ON i2 = intent AND d2 = domain AND s2 = slot AND q.ngram = wd.token GROUP BY ALL),
 gl AS MATERIALIZED (SELECT ngram AS token, score FROM m WHERE scope = 'global'),
 sc AS (SELECT 'act' AS method, wd.*, round(coalesce(CASE WHEN EXISTS (SELECT 1 FROM kn WHERE kn.dia_no = wd.dia_no AND kn.label = wd.label AND kn.turn_no = wd.turn_no) THEN ac.score ELSE gl.score END, 0), 9) AS s FROM wd LEFT JOIN ac USING ({TURN}, token) LEFT JOIN gl USING (token)
  UNION ALL SELECT 'global', wd.*, round(coalesce(gl.score, 0), 9) FROM wd LEFT JOIN gl USING (token)
  UNION ALL SELECT 'local', wd.*, own FROM wd),
 ro AS (SELECT method, {TURN}, token, CAST(row_number() OVER (PARTITION BY method, {TURN} ORDER BY CASE WHEN pred = 1 THEN -s ELSE s END, token) AS INTEGER) AS step FROM sc
  UNION ALL SELECT 'random', {TURN}, token, CAST(row_number() OVER (PARTITION BY {TURN} ORDER BY md5('2025|' || dia_no || '|' || turn_no || '|' || label || '|' || token)) AS INTEGER) FROM wd)"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Removal orders of every turn's words (turn key, method, step, token): by the turn's own attributions, by the profiles
    of its acts (by the global one where no act has a profile), by the global profile, and at random."""
    p = profiles.profile(spark, d, "agg_s")
    own = C.explained_tokens(spark, d).groupBy(*KEY, F.lower("token").alias("ngram")).agg(F.max("score").alias("own"))
    words, pred = own.select(*KEY, "ngram"), C.predictions(spark, d).select(*KEY, "pred")
    by_act = J.lookup_profile(profiles.turn_acts(spark, d), words, p)
    of_all = words.join(p.where("scope = 'global'").select("ngram", "score"), "ngram")
    scored = lambda method, found: own.join(found.select(*KEY, "ngram", "score"), [*KEY, "ngram"], "left").select(*KEY, F.lit(method).alias("method"), F.col("ngram").alias("token"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    local = own.select(*KEY, F.lit("local").alias("method"), F.col("ngram").alias("token"), F.col("own").alias("score"))
    rows = local.unionByName(scored("act", by_act)).unionByName(scored("global", of_all)).join(pred, KEY)
    ranked = E.removal_order_original(rows, keys=[*KEY, "method"]).select(*KEY, "method", "step", "token")
    return ranked.unionByName(E.random_order(own.select(*KEY, F.col("ngram").alias("token"))).select(*KEY, F.lit("random").alias("method"), "step", "token"))


@query("removal_orders", WORDS_SQL + f" SELECT {TURN}, method, step, token FROM ro")
def removal_orders(spark, d):
    return orders(spark, d)


@query("aopc_compare", WORDS_SQL + f""", od AS (SELECT {TURN}, method, list(token ORDER BY step) AS ord FROM ro GROUP BY ALL),
 st AS (SELECT {TURN}, method, CAST(s AS INTEGER) AS step, list_filter(tok, lambda x: NOT list_contains(list_slice(ord, 1, s), lower(x))) AS state FROM ut JOIN od USING ({TURN}), (SELECT unnest(range(0, 10)) AS s)),
 pb AS (SELECT {TURN}, method, step, 1 / (1 + exp(-coalesce(list_sum(list_transform(state, lambda x: (length(x) % 5 - 2) / 10.0)), 0))) AS prob FROM st),
 ap AS (SELECT method, step, first_value(prob) OVER w - avg(prob) OVER w AS aopc FROM pb WINDOW w AS (PARTITION BY {TURN}, method ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT method, step, round(avg(aopc), 6) AS aopc FROM ap GROUP BY ALL""")
def aopc_compare(spark, d):
    """Perturbation curves of the four orders, K = 10, as means over all turns."""
    order = orders(spark, d).groupBy(*KEY, "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "token"))), lambda x: x["token"]).alias("order"))
    states = E.remove_iterative(C.explanations(spark, d).select(*KEY, "tok").join(order, KEY), 10)
    logit = F.aggregate(F.transform("state", C.lexicon_weight), F.lit(0.0), lambda a, x: a + x)
    curves = E.aopc(states.withColumn("prob", 1 / (1 + F.exp(-logit))), [*KEY, "method"])
    return curves.groupBy("method", "step").agg(r6(F.avg("aopc")).alias("aopc"))


