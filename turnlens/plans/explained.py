"""Explanations by the attribution operators, what is selected and masked by them, the turn-by-turn pipeline, and trained detectors.

The scorer is the linear lexicon, so that masks and gradients have known results and SQL can state them. Scores are rounded
before anything is ranked by them, as solvers leave noise in the last digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FUSIONS
from ..operators import attribution as AT
from ..operators import dialogue as D
from ..operators import features as FE
from ..operators import fusion as FU
from ..operators import scoring as S
from ..operators import selection as SE
from ..sources import conversations as C
from ..streaming import pipeline as P
from . import bases as B
from .registry import ACTS_SQL, KEY, query, r6, utt_acts

LEXICON = S.LexiconScorer()


def weights(words: list[str]) -> np.ndarray:
    """The lexicon as an embedding of one dimension."""
    return np.array([[LEXICON.weight(w)] for w in words])


def one(x: np.ndarray) -> np.ndarray:
    return np.ones_like(x)


def slope(x: np.ndarray) -> np.ndarray:
    """The gradient of the probability, the sigmoid of the sum."""
    p = 1 / (1 + np.exp(-x.sum()))
    return np.full_like(x, p * (1 - p))


def single(found: DataFrame) -> DataFrame:
    """Explanations of single features as arrays of (idx, text, score) in the order of the features."""
    flat = F.transform(F.filter("explanation", lambda e: F.size(e["features"]) == 1), lambda e: F.struct(F.get(e["features"], F.lit(0))["idx"].alias("idx"), F.get(e["features"], F.lit(0))["text"].alias("text"), F.round(e["score"], 6).alias("score")))
    return found.withColumn("explanation", F.array_sort(flat))


@query("ig_utterance", B.with_(B.T, B.U, B.UT, B.K, B.P) + """, q AS (SELECT dia_no, label, turn_no, list_transform(range(0, 101), lambda i: 1 / (1 + exp(-logit * i / 100.0))) AS s FROM p),
 g AS (SELECT dia_no, label, turn_no, (list_sum(list_transform(s, lambda x: x * (1 - x))) - (s[1] * (1 - s[1]) + s[101] * (1 - s[101])) / 2) / 100 AS slope FROM q)
 SELECT dia_no, label, turn_no, idx, token, round(score * slope, 6) + 0.0 AS score FROM k JOIN g USING (dia_no, label, turn_no)""")
def ig_utterance(spark, d):
    """Integrated gradients of the probability: a hundred steps of the trapezoid rule."""
    found = single(AT.integrated_gradients(C.explanations(spark, d), weights, slope, np.zeros(1), 100))
    return found.select(*KEY, F.explode("explanation").alias("e")).select(*KEY, "e.idx", F.col("e.text").alias("token"), (r6("e.score") + 0.0).alias("score"))


#: Weights of the tokens of serialised acts: words of the parts, and three separators inside each act.
PARTS_SQL = """pt AS (SELECT dia_no, label, turn_no, act_i, (length(t) % 5 - 2) / 10.0 AS w FROM (SELECT *, unnest(list_filter(regexp_split_to_array(intent || ' ' || domain || ' ' || slot || ' ' || value, '\\s+'), lambda x: x <> '') || ['<slot_sep>', '<slot_sep>', '<slot_sep>']) AS t FROM ax))"""


@query("ig_da", B.with_(B.T, B.TA, B.U, B.UA, B.AX, PARTS_SQL) + "SELECT dia_no, label, turn_no, act_i, round(sum(w), 6) + 0.0 AS score FROM pt GROUP BY ALL")
def ig_da(spark, d):
    """Integrated gradients of the logit over the tokens of serialised acts, summed for each act."""
    rows = AT.gradients_by_act(C.user_turns(spark, d), weights, one, np.zeros(1), 20)
    return rows.select(*KEY, "act_i", (r6("score") + 0.0).alias("score"))


@query("expl_utt_turn", B.with_(B.T, B.U, B.UT, B.K) + B.MASKED_TURNS)
def expl_utt_turn(spark, d):
    """Attribution of every turn by masks (Shapley-Taylor), the three strongest tokens, the masked turn."""
    turns = C.explanations(spark, d)
    found = single(AT.attribute(turns, LEXICON.logit, "shapley_taylor", 1)).withColumn("mask", SE.importance_mask(SE.important_ids(SE.topk_absolute(F.col("explanation"), 3)), F.col("n_features")))
    return found.join(turns.select(*KEY, "tok"), KEY).select(*KEY, FE.mask_apply_utt(F.col("tok"), F.col("mask")).alias("masked_sample"))


act_logit = S.ActScorer().logit


AS_SQL = "sa AS (SELECT *, (length(value) % 5 - 2) / 10.0 AS score FROM ax WHERE intent <> 'none')"


@query("expl_da_turn", B.with_(B.T, B.TA, B.U, B.UA, B.AX, AS_SQL) + "SELECT dia_no, label, turn_no, string_agg(intent || '|' || domain || '|' || slot || '|' || value, ';' ORDER BY act_i) AS masked_sample FROM (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY abs(score) DESC, act_i) AS r FROM sa) WHERE r <= 2 GROUP BY ALL")
def expl_da_turn(spark, d):
    """Attribution of every turn's acts by masks, the two strongest, the turn with only these."""
    turns = C.user_turns(spark, d).where(F.size("acts") > 0)
    found = single(AT.attribute_acts(turns, act_logit, "shapley_taylor", 1))
    mask = SE.importance_mask(SE.important_ids(SE.topk_absolute(F.col("explanation"), 2)), F.col("n_features"))
    return found.withColumn("mask", mask).join(turns.select(*KEY, "acts"), KEY).select(*KEY, utt_acts(FE.mask_apply_da(F.array("acts"), F.col("mask"))).alias("masked_sample"))


dialogue_logit = S.DialogueScorer().logit


def dialogue_masks(features: list[str], masks: np.ndarray) -> np.ndarray:
    """The logits that ``dialogue_logit`` gives to the masked texts."""
    weigh = lambda f: LEXICON.weight(f.rsplit("|", 1)[-1] if f.startswith(AT.ACT_MARK) or f.count("|") >= 3 else f)
    return masks @ np.array([weigh(f) for f in features])


@query("expl_dialogue", B.with_(B.T, B.TA, B.U, B.UA, B.UT, B.K, B.AX) + """, fe AS (SELECT dia_no, label, 'token' AS kind, turn_no, idx, score FROM k UNION ALL SELECT dia_no, label, 'act', turn_no, act_i, (length(value) % 5 - 2) / 10.0 FROM ax),
 rk AS (SELECT *, row_number() OVER (PARTITION BY dia_no, label ORDER BY abs(score) DESC, kind, turn_no, idx) AS r FROM fe)
 SELECT dia_no, label, coalesce(string_agg(kind || ':' || turn_no || ':' || idx, ',' ORDER BY kind, turn_no, idx) FILTER (WHERE r <= 5), '') AS important FROM rk GROUP BY ALL""")
def expl_dialogue(spark, d):
    """Attribution of whole dialogues over all user tokens and acts at once, and the five strongest of either kind."""
    found = AT.attribute_dialogue(C.explanations(spark, d), dialogue_logit, "shapley_taylor", 1, on_masks=dialogue_masks)
    each = F.struct((-F.abs(F.round("score", 6))).alias("r"), "kind", "turn_no", "idx")
    top = F.transform(F.slice(F.array_sort(F.collect_list(each)), 1, 5), lambda x: F.struct(x["kind"].alias("kind"), x["turn_no"].alias("turn_no"), x["idx"].alias("idx")))
    shown = lambda x: F.concat_ws(":", x["kind"], x["turn_no"].cast("string"), x["idx"].cast("string"))
    return found.groupBy("dia_no", "label").agg(top.alias("top")).select("dia_no", "label", F.array_join(F.transform(F.array_sort("top"), shown), ",").alias("important"))


# The turn pipeline -----------------------------------------------------------------------------------------------------

ONLINE_SQL = B.with_(B.T, B.TA, B.U, B.UA) + f""", ms AS (SELECT dia_no, label, turn_no, list_reduce([text] || list_transform(list_filter(acts, lambda a: a.slot = 'name' AND a.value <> ''), lambda a: a.value), lambda t, v: replace(t, v, '[name]')) AS text,
   list_transform(acts, lambda a: {{'intent': a.intent, 'domain': a.domain, 'slot': a.slot, 'value': CASE WHEN a.slot = 'name' AND a.value <> '' THEN '[name]' ELSE a.value END}}) AS acts FROM ua),
 tk AS (SELECT dia_no, label, turn_no, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS tok, acts FROM ms),
 fe AS (SELECT dia_no, label, turn_no, 0 AS kind, CAST(i - 1 AS INTEGER) AS idx, tok[i] AS t, (length(tok[i]) % 5 - 2) / 10.0 AS w FROM (SELECT *, unnest(range(1, len(tok) + 1)) AS i FROM tk)
   UNION ALL SELECT dia_no, label, turn_no, 1, CAST(i - 1 AS INTEGER), {ACTS_SQL.format('[acts[i]]')}, (length(acts[i].value) % 5 - 2) / 10.0 FROM (SELECT *, unnest(range(1, len(acts) + 1)) AS i FROM tk)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no, kind ORDER BY abs(w) DESC, idx) AS r FROM fe),
 pt AS (SELECT tk.dia_no, tk.label, tk.turn_no, coalesce(sum(w) FILTER (WHERE kind = 0), 0) AS lu, coalesce(sum(w) FILTER (WHERE kind = 1), 0) AS la, coalesce(sum(w) FILTER (WHERE r <= CASE WHEN kind = 0 THEN 3 ELSE 2 END), 0) AS kept,
   coalesce(string_agg(CASE WHEN r <= 3 THEN t ELSE '<mask>' END, ' ' ORDER BY idx) FILTER (WHERE kind = 0), '') AS masked, coalesce(string_agg(t, ';' ORDER BY idx) FILTER (WHERE kind = 1 AND r <= 2), '') AS masked_acts
   FROM tk LEFT JOIN rk USING (dia_no, label, turn_no) GROUP BY ALL)
 SELECT dia_no AS session_id, turn_no, masked, masked_acts, round(1 / (1 + exp(-lu)), 6) AS utt_prob, round(1 / (1 + exp(-la)), 6) AS da_prob, round(1 / (1 + exp(-sum(kept) OVER (PARTITION BY dia_no, label ORDER BY turn_no))), 6) AS dia_prob FROM pt"""


@query("turn_pipeline", ONLINE_SQL)
def turn_pipeline(spark, d):
    """The online pipeline as a batch: names hidden, acts extracted, both turn scores, both attributions, masked turn, and the
    dialogue's score over all masked turns so far."""
    rows = C.user_turns(spark, d).select(F.col("dia_no").alias("session_id"), F.col("turn_no").alias("seq"), "text")
    out = P.run_batch(rows)
    return out.select("session_id", "turn_no", "masked", "masked_acts", *[r6(c).alias(c) for c in ("utt_prob", "da_prob", "dia_prob")])


# Trained detectors -----------------------------------------------------------------------------------------------------

def _split(dia_no):
    return F.when(dia_no % 10 < 8, "train").when(dia_no % 10 == 8, "val").otherwise("test")


def _metrics(scored: DataFrame) -> DataFrame:
    from ..operators.evaluate import metrics_cls

    rows = scored.select("split", "label", F.col("prediction").cast("int").alias("pred"))
    return metrics_cls(rows, ["split"])


@query("train_turn_utt")
def train_turn_utt(spark, d):
    """A detector of utterances: fitted on the training split, measured on all three."""
    rows = C.user_turns(spark, d).select(*KEY, D.utt_sequence(F.col("text")).alias("input_sequence")).withColumn("split", _split(F.col("dia_no")))
    return _metrics(S.train_detector(rows.where("split = 'train'"), "input_sequence").transform(rows))


@query("train_turn_da")
def train_turn_da(spark, d):
    """A detector of acts, with the opponent's acts before them."""
    rows = D.da_turn(C.turns(spark, d)).select(*KEY, D.da_sequence(F.col("prev_acts"), F.col("acts")).alias("input_sequence")).withColumn("split", _split(F.col("dia_no")))
    return _metrics(S.train_detector(rows.where("split = 'train'"), "input_sequence").transform(rows))


@query("train_dia")
def train_dia(spark, d):
    """Detectors of whole dialogues in seven variants: acts, utterances, one sequence of both; two towers with a joint head, fused by
    concatenation, the larger or the mean; and one tower for both, all stopped by the validation split."""
    da, utt = D.multimodal_sequence(F.col("lines"))
    rows = C.dialogues(spark, d).select("dia_no", "label", F.coalesce(da, F.lit("")).alias("da"), F.coalesce(utt, F.lit("")).alias("utt"), D.da_utt_sequence(F.col("lines")).alias("both")).withColumn("split", _split(F.col("dia_no")))
    towers = {f: FU.Settings(f) for f in FUSIONS} | {"shared": FU.Settings("concat", shared=True)}
    found = S.dialogue_variants(rows, rows.where("split = 'train'")) | {n: FU.predict(rows, m) for n, m in FU.train(rows, towers).items()}
    out = None
    for name, scored in found.items():
        own = _metrics(scored).withColumn("variant", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query("batch_iter", B.with_(B.T, B.U) + f"SELECT dia_no, label, turn_no, CAST((row_number() OVER (PARTITION BY b ORDER BY h, dia_no, label, turn_no) - 1) // 16 AS INTEGER) AS batch, CAST(b AS INTEGER) AS part FROM (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (SELECT greatest(1, (count(*) + {16 * D.PART_BATCHES - 1}) // {16 * D.PART_BATCHES}) FROM u) AS b FROM (SELECT *, md5('2025|' || dia_no || '|' || label || '|' || turn_no) AS h FROM u))")
def batch_iter(spark, d):
    """Training batches of 16 in the order of a digest, part by part; the parts follow from the number of rows."""
    return D.batches(C.user_turns(spark, d).select(*KEY), KEY, 16).select(*KEY, "batch", "part")
