"""Resumable explanation by split, padded batches, subword ids, the trained embedder, clouds, and extraction with demonstrations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import api
from ..config import Config
from ..operators import acts as AC
from ..operators import attribution as AT
from ..operators import cloud
from ..operators import collate as CO
from ..operators import dialogue as D
from ..operators import embedder as EM
from ..operators import matching as M
from ..operators import nlu
from ..operators import profile as PR
from ..operators import report as R
from ..operators import scoring as S
from ..operators import tokenizer as TK
from ..sources import conversations as C
from ..sources.scratch import Scratch
from . import bases as B
from . import profiles
from .registry import ACTS_SQL, KEY, _serial_sql, join_acts, query

SPLIT_SQL = "CASE WHEN dia_no % 10 < 8 THEN 'train' WHEN dia_no % 10 = 8 THEN 'val' ELSE 'test' END AS split"


def split(dia_no: Column) -> Column:
    return F.when(dia_no % 10 < 8, "train").when(dia_no % 10 == 8, "val").otherwise("test")


@query("expl_split_driver", f"SELECT *, {SPLIT_SQL} FROM ({B.with_(B.T, B.U, B.UT, B.K)}{B.MASKED_TURNS})")
def expl_split_driver(spark, d):
    """Attributions of every split as a job in committed parts, and the masked turns that follow from them."""
    turns = C.explanations(spark, d)
    splits = turns.select("dia_no").distinct().withColumn("split", split(F.col("dia_no")))
    where = Scratch(spark, "explained").root
    found = api.explain_splits(turns, splits, Config(utt_explanation="stii", utt_k=3, perturbations=40), S.LogitScorer(), where, part_turns=4096)
    return found.select(*KEY, "masked_sample", "split")


_ID = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 49999 + 1"


@query("collate_multimodal", B.with_(B.T, B.TA) + f""", s AS (SELECT dia_no, label, list_filter(string_split('<cls> ' || string_agg(CASE WHEN len(acts) = 0 THEN 'none' ELSE {_serial_sql('acts')} END, ' <da_sep> ' ORDER BY pos) || ' <sep>', ' '), lambda x: x <> '') AS a,
   list_filter(regexp_split_to_array('<cls> ' || string_agg(text, ' <usr> ' ORDER BY pos) FILTER (WHERE role = 'user') || ' <sep>', '\\s+'), lambda x: x <> '') AS u FROM ta GROUP BY dia_no, label),
 e AS (SELECT dia_no, label, list_transform(a[1:256], lambda t: {_ID}) AS a, coalesce(list_transform(u[1:384], lambda t: {_ID}), []) AS u FROM s),
 p AS (SELECT *, (row_number() OVER (ORDER BY greatest(len(a), len(u)) // 8, md5('2025|' || dia_no || '|' || label), dia_no, label) - 1) // 16 AS batch FROM e),
 w AS (SELECT *, max(len(a)) OVER (PARTITION BY batch) AS wa, max(len(u)) OVER (PARTITION BY batch) AS wu FROM p)
 SELECT dia_no, label, CAST(batch AS BIGINT) AS batch, md5('2025|' || batch) AS turn, array_to_string(list_resize(a, wa, 0), ',') AS da_input_ids, array_to_string(list_resize(u, wu, 0), ',') AS utt_input_ids, CAST(len(a) AS INTEGER) AS n_da, CAST(len(u) AS INTEGER) AS n_utt FROM w""")
def collate_multimodal(spark, d):
    """Batches of 16 dialogues of similar length, both modalities padded to the longest of their batch."""
    da, utt = D.multimodal_sequence(F.col("lines"))
    rows = C.dialogues(spark, d).select("dia_no", "label", D.hashed_ids(da, 256).alias("da_input_ids"), F.when(F.exists("lines", lambda x: x["role"] == "user"), D.hashed_ids(utt, 384)).alias("utt_input_ids"))
    out = CO.collate(rows, ["da_input_ids", "utt_input_ids"], ["dia_no", "label"], 16)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return out.select("dia_no", "label", "batch", "turn", F.array_join("da_input_ids", ",").alias("da_input_ids"), F.array_join("utt_input_ids", ",").alias("utt_input_ids"), total("da_input_ids_mask").alias("n_da"), total("utt_input_ids_mask").alias("n_utt"))


#: The public vocabulary file that ``encode_subword`` reads.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@query("encode_subword")
def encode_subword(spark, d):
    """Subword ids of every user turn by a public vocabulary, with the engine's marks after it."""
    ids = TK.subword_ids(TK.new_tokenizer(spark, VOCABULARY), D.utt_sequence(F.col("text")))
    return C.user_turns(spark, d).select(*KEY, F.array_join(ids, ",").alias("input_ids"))


def described(spark, d):
    """User turns with the words of their acts, with and without values: turn key, split, utt, with_value, without_value."""
    acts = profiles.turn_acts(spark, d).select(*KEY, "act_i", M.da_to_text(F.col("intent"), F.col("slot"), F.col("value")).alias("w"), M.da_to_text(F.col("intent"), F.col("slot"), F.lit("")).alias("o"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("act_i", c))), lambda x: x[c]), " ")
    rows = acts.groupBy(*KEY).agg(joined("w").alias("with_value"), joined("o").alias("without_value"))
    return rows.join(C.user_turns(spark, d).select(*KEY, F.col("text").alias("utt")), KEY).withColumn("split", split(F.col("dia_no")))


@query("train_embedder")
def train_embedder(spark, d):
    """The matching embedder, trained on the pairs of the training split: for each split how many pairs, and the share of those
    whose description lies nearer than another turn's."""
    rows = described(spark, d)
    own = rows.where("split = 'train'").select("utt", "with_value", "without_value")
    model, _ = EM.train(M.train_pairs(own, own.limit(0)).select("utt", "acts"))
    judged = D.negatives_random_pair(rows.select(*KEY, "split", "utt", "with_value"), KEY, "with_value")
    vec = EM.embedded(EM.embedded(EM.embedded(judged, model, "utt", "_u"), model, "with_value", "_p"), model, "negative", "_n")
    above = (M.dot(F.col("_u"), F.col("_p")) > M.dot(F.col("_u"), F.col("_n"))).cast("double")
    return vec.where("with_value <> negative").groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(above), 3).alias("above"))


@query("cloud_layout")
def cloud_layout(spark, d):
    """The placed clouds of the whole corpus' phrases: a box for each phrase of either side."""
    import pandas as pd

    top = PR.top_profile(profiles.profile_global(profiles.profile_rows(spark, d)).withColumn("score", F.round("score", 6)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = cloud.layout(list(zip(pdf["phrase"], pdf["weight"])))
        return pd.DataFrame([(pdf["side"].iloc[0], *b) for b in boxes], columns=["side", "phrase", "x", "y", "width", "height", "size"])

    rows = R.clouds(top).select("side", "phrase", F.round("weight", 6).alias("weight"))
    return rows.groupBy("side").applyInPandas(run, "side string, phrase string, x double, y double, width double, height double, size double")


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''))"
_DIGEST = "md5('2025|' || {0}dia_no || '|' || {0}label || '|' || {0}pos)"
DEMOS_SQL = B.with_(B.T, B.TA) + f""", wo AS (SELECT dia_no, label, pos, unnest({_WORDS}) AS word FROM t WHERE role = 'user'),
 hd AS (SELECT word, count(*) AS df FROM wo GROUP BY word),
 li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY {_DIGEST.format('')}, dia_no, label, pos) AS p FROM wo) WHERE p <= {nlu.LISTED}),
 ak AS (SELECT * FROM (SELECT wo.*, df, row_number() OVER (PARTITION BY dia_no, label, pos ORDER BY df, word) AS r FROM wo JOIN hd USING (word)) WHERE r <= {nlu.ASKED}),
 me AS (SELECT ak.dia_no, ak.label, ak.pos, li.dia_no AS ed, li.label AS el, li.pos AS ep, round(sum(1.0 / df), 9) AS score FROM ak JOIN li USING (word) WHERE ak.dia_no <> li.dia_no GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY dia_no, label, pos ORDER BY score DESC, md5('2025|' || ed || '|' || el || '|' || ep), ed, el, ep) AS r FROM me)"""
LINE = ["dia_no", "label", "pos"]


def _demonstrated(spark, d):
    lines = AC.da_examples(C.turns(spark, d), "user").withColumn("acts", join_acts(F.col("acts")))
    return lines, nlu.demonstrations(lines, lines, LINE, ["dia_no"])


@query("nlu_demonstrations", DEMOS_SQL + " SELECT dia_no, label, pos, CAST(r AS INTEGER) AS rank, ed AS of_dia, ep AS of_pos, score FROM rk WHERE r <= 2")
def nlu_demonstrations(spark, d):
    """Two demonstrations for every user line, from other dialogues, by the rarest words that they share."""
    _, found = _demonstrated(spark, d)
    return found.select(*LINE, "rank", F.col("example.dia_no").alias("of_dia"), F.col("example.pos").alias("of_pos"), "score")


@query("nlu_extract", DEMOS_SQL + f""", ex AS (SELECT dia_no, label, pos, text, {ACTS_SQL.format('acts')} AS acts, coalesce(lag(text) OVER (PARTITION BY dia_no, label ORDER BY pos), '') AS context, role FROM ta),
 sh AS (SELECT rk.dia_no, rk.label, rk.pos, string_agg('Context: ' || context || chr(10) || 'user: ' || text || chr(10) || '<DA>' || acts || '</DA>' || chr(10), '' ORDER BY r DESC) AS shown FROM rk JOIN ex ON ed = ex.dia_no AND el = ex.label AND ep = ex.pos WHERE r <= 2 GROUP BY ALL),
 pr AS (SELECT ex.dia_no, ex.label, ex.pos, 'Answer with a JSON list of [intent, domain, slot, value] in <DA></DA> tags.' || chr(10) || coalesce(shown, '') || 'Context: ' || context || chr(10) || 'user: ' || text || chr(10) AS prompt FROM ex LEFT JOIN sh USING (dia_no, label, pos) WHERE role = 'user')
 SELECT dia_no, label, pos, md5(prompt) AS prompt_md5, 'inform|general|name|' || CAST(length(prompt) AS VARCHAR) AS acts, CAST(1 AS INTEGER) AS calls, true AS ok FROM pr""")
def nlu_extract(spark, d):
    """Acts of every user line by a generator, asked with the line's demonstrations; the generator here tells its prompt's length."""
    lines, found = _demonstrated(spark, d)
    asked = nlu.prompts(lines, lines, found, LINE, "Answer with a JSON list of [intent, domain, slot, value] in <DA></DA> tags.\n")
    shown = F.array_join(F.transform("acts", lambda a: F.array_join(a, "|")), ";")
    return nlu.extract(asked, LINE, S.LengthGenerator).join(asked, LINE).select(*LINE, F.md5("prompt").alias("prompt_md5"), shown.alias("acts"), "calls", "ok")


@query("perturb_explain", B.with_(B.T, B.U, B.UT, B.K) + """, ch AS (SELECT dia_no, label, turn_no FROM ut WHERE len(tok) BETWEEN 1 AND 130 ORDER BY md5('2025|' || dia_no || '|' || turn_no || '|' || label), dia_no, turn_no, label LIMIT 50)
 SELECT dia_no, turn_no, label, idx, token, round(score, 6) + 0.0 AS score FROM k JOIN ch USING (dia_no, label, turn_no)""")
def perturb_explain(spark, d):
    """Fifty turns in a seeded order, their masks scored as rows, and the explanations that follow from these rows."""
    rows = AT.chosen(C.explanations(spark, d), 50, 1)
    scored = S.score_prob(AT.perturb(rows, "shapley_taylor", 80), S.LogitScorer(), "masked", "y")
    found = AT.solved(scored, rows, "shapley_taylor").select(*AT.KEY, F.explode("explanation").alias("e"))
    one = F.get("e.features", F.lit(0))
    return found.select(*AT.KEY, one["idx"].alias("idx"), one["text"].alias("token"), (F.round("e.score", 6) + 0.0).alias("score"))
