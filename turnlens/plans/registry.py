"""All queries of the dialogue engine over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import METRICS
from ..operators import acts as AC
from ..operators import attribution as AT
from ..operators import dialogue as D
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import joins as J
from ..operators import matching as M
from ..operators import profile as PR
from ..operators import report as R
from ..operators import scoring as S
from ..operators import selection as SE
from ..operators import text as X
from ..sources import conversations as C
from ..streaming import session
from . import bases as B
from . import profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
KEY = ["dia_no", "label", "turn_no"]


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def r6(c) -> F.Column:
    return F.round(c, 6)


def join_acts(acts):
    return F.array_join(F.transform(acts, FE.act_name), ";")


ACT_SQL = "concat_ws('|', a.intent, a.domain, a.slot, a.value)"
ACTS_SQL = "array_to_string(list_transform({}, lambda a: " + ACT_SQL + "), ';')"
DIA_SQL = "d AS (SELECT dia_no, label, string_agg(role || ': ' || text, chr(10) ORDER BY pos) AS dia, CAST(sum(CAST(role = 'user' AS INTEGER)) AS INTEGER) AS n_user FROM t GROUP BY ALL)"


# Shaping -----------------------------------------------------------------------------------------------------------

@query("fill_turn_no", B.with_(B.T, DIA_SQL) + """SELECT dia_no, label, CASE WHEN dia_no % 3 = 0 THEN CAST(dia_no % 2 AS VARCHAR)
  ELSE array_to_string(range(0, CAST((length(dia) - length(replace(dia, 'user: ', ''))) / 6 AS BIGINT)), ',') END AS turn_nos FROM d""")
def fill_turn_no(spark, d):
    rows = C.dialogues(spark, d).withColumn("turn_no", F.when(F.col("dia_no") % 3 == 0, F.col("dia_no") % 2))
    return D.fill_turn_no(rows).select("dia_no", "label", F.array_join(F.transform("turn_nos", lambda x: x.cast("string")), ",").alias("turn_nos"))


@query("dia_explode", B.with_(B.T, B.U) + "SELECT dia_no, label, turn_no, trim(text) AS text FROM u")
def dia_explode(spark, d):
    return D.dia_explode(C.dialogues(spark, d).select("dia_no", "label", "dia")).select("dia_no", "label", F.col("turn_no").cast("int").alias("turn_no"), "text")


@query("role_lines", B.with_(B.T) + "SELECT dia_no, label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE role = 'system' GROUP BY ALL")
def role_lines(spark, d):
    rows = C.dialogues(spark, d).select("dia_no", "label", D.role_lines(F.col("dia"), "system").alias("x")).where(F.size("x") > 0)
    return rows.select("dia_no", "label", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, y: a + F.length(y) - 8).alias("chars"))


@query("user_lines_every_2nd", B.with_(B.T) + """SELECT dia_no, label, string_agg(CASE WHEN role = 'user' THEN text ELSE substr('system: ' || text, 7) END, '|' ORDER BY pos) AS lines FROM
  (SELECT *, row_number() OVER (PARTITION BY dia_no ORDER BY pos) - 1 AS i FROM t) WHERE i % 2 = 0 GROUP BY ALL""")
def user_lines_every_2nd(spark, d):
    return C.dialogues(spark, d).select("dia_no", "label", F.array_join(D.every_second_line(F.col("dia")), "|").alias("lines"))


@query("collapse_lines", r"""SELECT conv_id, turn, array_to_string(list_transform(string_split(replace(regexp_replace(regexp_replace('user: ' || text, '[ \t]*\n[ \t]*(user:|system:)', chr(1) || '\1', 'g'), '[ \t]*\n[ \t]*', ' ', 'g'), chr(1), chr(10)), chr(10)), lambda x: trim(x)), chr(10)) AS line FROM conversations""")
def collapse_lines(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", X.collapse_lines(F.concat(F.lit("user: "), F.col("text"))).alias("line"))


@query("utt_sequence", B.with_(B.T, B.U) + "SELECT dia_no, label, turn_no, '<cls> ' || trim(replace(replace('user: ' || text, 'user:', ''), 'system:', '')) AS input_sequence FROM u")
def utt_sequence(spark, d):
    return C.user_turns(spark, d).select(*KEY, D.utt_sequence(F.concat(F.lit("user: "), F.col("text"))).alias("input_sequence"))


PREV_SQL = """pv AS (SELECT dia_no, label, turn_no, acts, CASE WHEN prev IS NOT NULL THEN prev WHEN opened = 'user'
   THEN [{'intent':'greet','domain':'general','slot':'','value':''}] ELSE [{'intent':'none','domain':'','slot':'','value':''}] END AS prev, text FROM
 (SELECT dia_no, label, pos, role, text, CASE WHEN len(acts) = 0 THEN [{'intent':'none','domain':'','slot':'','value':''}] ELSE acts END AS acts,
   lag(CASE WHEN len(acts) = 0 THEN [{'intent':'none','domain':'','slot':'','value':''}] ELSE acts END) OVER w AS prev,
   first_value(role) OVER w AS opened, CAST(sum(CAST(role = 'user' AS INTEGER)) OVER w - 1 AS INTEGER) AS turn_no FROM ta WINDOW w AS (PARTITION BY dia_no, label ORDER BY pos)) WHERE role = 'user')"""


@query("prev_opponent", B.with_(B.T, B.TA, PREV_SQL) + f"SELECT dia_no, label, turn_no, {ACTS_SQL.format('prev')} AS prev, {ACTS_SQL.format('acts')} AS acts FROM pv")
def prev_opponent(spark, d):
    return D.da_turn(C.turns(spark, d)).select("dia_no", "label", "turn_no", join_acts(F.col("prev_acts")).alias("prev"), join_acts(F.col("acts")).alias("acts"))


def _serial_sql(x: str) -> str:
    return f"CASE WHEN len({x}) = 1 AND {x}[1].intent = 'none' THEN 'none' ELSE array_to_string(list_transform({x}, lambda a: a.intent || ' <slot_sep> ' || a.domain || ' <slot_sep> ' || a.slot), ' <da_sep> ') END"


@query("da_sequence", B.with_(B.T, B.TA, PREV_SQL) + f"SELECT dia_no, label, turn_no, '<cls> ' || {_serial_sql('prev')} || ' <sep> ' || {_serial_sql('acts')} || ' <sep>' AS input_sequence FROM pv")
def da_sequence(spark, d):
    return D.da_turn(C.turns(spark, d)).select("dia_no", "label", "turn_no", D.da_sequence(F.col("prev_acts"), F.col("acts")).alias("input_sequence"))


def _dropped_sql(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR (len({x}) = 1 AND {x}[1].intent = 'none') THEN 'none' ELSE array_to_string(list_transform({x}, lambda a: array_to_string(list_filter([a.intent, a.domain, a.slot], lambda q: q <> ''), ' ')), ' <da_sep> ') END"


@query("da_utt_sequence", B.with_(B.T, B.TA) + f"""SELECT dia_no, label, '<cls> ' || string_agg(CASE WHEN role = 'user' THEN '<usr> ' ELSE '<sys> ' END || {_dropped_sql('acts')}, ' ' ORDER BY pos)
  || ' <sep> <usr> ' || coalesce(string_agg(text, ' <usr> ' ORDER BY pos) FILTER (WHERE role = 'user'), '') AS input_sequence FROM ta GROUP BY dia_no, label""")
def da_utt_sequence(spark, d):
    return C.dialogues(spark, d).select("dia_no", "label", D.da_utt_sequence(F.col("lines")).alias("input_sequence"))


@query("multimodal_sequence", B.with_(B.T, B.TA) + f"""SELECT dia_no, label, '<cls> ' || string_agg(CASE WHEN len(acts) = 0 THEN 'none' ELSE {_serial_sql('acts')} END, ' <da_sep> ' ORDER BY pos) || ' <sep>' AS da_sequence,
  '<cls> ' || string_agg(text, ' <usr> ' ORDER BY pos) FILTER (WHERE role = 'user') || ' <sep>' AS utt_sequence FROM ta GROUP BY dia_no, label""")
def multimodal_sequence(spark, d):
    da, utt = D.multimodal_sequence(F.col("lines"))
    return C.dialogues(spark, d).select("dia_no", "label", da.alias("da_sequence"), utt.alias("utt_sequence"))


@query("encode_combined", B.with_(B.T, B.U, B.UT) + """SELECT dia_no, label, turn_no, array_to_string(list_resize(list_transform(tok[1:128], lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 49999 + 1), 128, 0), ',') AS input_ids,
  CAST(least(len(tok), 128) AS INTEGER) AS n_tokens FROM ut""")
def encode_combined(spark, d):
    ids, mask = D.encode(F.col("text"), 128)
    return C.user_turns(spark, d).select(*KEY, F.array_join(ids, ",").alias("input_ids"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_tokens"))


@query("encode_multimodal", B.with_(B.T, B.TA) + f"""SELECT dia_no, label, CAST(least(len(a), 256) AS INTEGER) AS n_da, CAST(least(len(u), 384) AS INTEGER) AS n_utt, {{}} AS da_sum, {{}} AS utt_sum FROM
  (SELECT dia_no, label, list_filter(string_split('<cls> ' || string_agg(CASE WHEN len(acts) = 0 THEN 'none' ELSE {_serial_sql('acts')} END, ' <da_sep> ' ORDER BY pos) || ' <sep>', ' '), lambda x: x <> '') AS a,
    list_filter(regexp_split_to_array('<cls> ' || string_agg(text, ' <usr> ' ORDER BY pos) FILTER (WHERE role = 'user') || ' <sep>', '\\s+'), lambda x: x <> '') AS u FROM ta GROUP BY dia_no, label)""".format(*[f"CAST(list_sum(list_transform({c}[1:{n}], lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 49999 + 1)) AS BIGINT)" for c, n in (("a", 256), ("u", 384))]))
def encode_multimodal(spark, d):
    """Both inputs of a late-fusion model, each with its own ids and mask; a dialogue without user lines has no utterances."""
    da, utt = D.multimodal_sequence(F.col("lines"))
    rows = C.dialogues(spark, d).where(F.exists("lines", lambda x: x["role"] == "user"))
    (a, am), (u, um) = D.encode(da, 256), D.encode(utt, 384)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("dia_no", "label", total(am).cast("int").alias("n_da"), total(um).cast("int").alias("n_utt"), total(a).alias("da_sum"), total(u).alias("utt_sum"))


AGG_SQL = """, g AS (SELECT dia_no, label, list_slice(flatten(list(list_value(prev, acts) ORDER BY turn_no)), 2, 100000) AS da, list(text ORDER BY turn_no) AS utt FROM pv GROUP BY ALL)"""
UTT_ACTS = "array_to_string(list_transform({}, lambda u: " + ACTS_SQL.format("u") + "), '/')"


def utt_acts(c):
    return F.array_join(F.transform(c, join_acts), "/")


@query("agg_dialogue", B.with_(B.T, B.TA, PREV_SQL) + AGG_SQL + f" SELECT dia_no, label, {UTT_ACTS.format('da')} AS masked_da, array_to_string(utt, chr(10)) AS masked_utt FROM g")
def agg_dialogue(spark, d):
    rows = D.agg_dialogue(D.da_turn(C.turns(spark, d)))
    return rows.select("dia_no", "label", utt_acts(F.col("masked_da")).alias("masked_da"), F.array_join("masked_utt", "\n").alias("masked_utt"))


@query("da_utt", B.with_(B.T, B.TA, PREV_SQL) + AGG_SQL + f" SELECT dia_no, label, '<cls> ' || array_to_string(list_transform(range(1, len(da) + 1), lambda i: CASE WHEN i % 2 = 1 THEN '<usr> ' ELSE '<sys> ' END || {_dropped_sql('da[i]')}), ' ') || ' <sep> <usr> ' || array_to_string(utt, ' <usr> ') AS input_sequence, {UTT_ACTS.format('da')} || '/' || array_to_string(utt, chr(10)) || '|||' AS sample FROM g")
def da_utt(spark, d):
    """Dialogues as one sequence, and their samples: acts and the pseudo-act of the text."""
    out = D.da_utt(D.agg_dialogue(D.da_turn(C.turns(spark, d))))
    return out.select("dia_no", "label", "input_sequence", utt_acts(F.col("sample")).alias("sample"))


@query("prefix_expand", B.with_(B.T, B.TA, PREV_SQL) + AGG_SQL + f""" SELECT dia_no, label, CAST(i - 1 AS INTEGER) AS turn_no, i = len(utt) AS is_complete, {UTT_ACTS.format('list_slice(da, 1, 2 * i - 1)')} AS masked_da,
  array_to_string(list_slice(utt, 1, i), chr(10)) AS masked_utt FROM (SELECT *, unnest(range(1, len(utt) + 1)) AS i FROM g)""")
def prefix_expand(spark, d):
    rows = D.prefix_expand(D.agg_dialogue(D.da_turn(C.turns(spark, d))))
    return rows.select("dia_no", "label", "turn_no", "is_complete", utt_acts(F.col("masked_da")).alias("masked_da"), F.array_join("masked_utt", "\n").alias("masked_utt"))


@query("context_window", B.with_(B.T) + "SELECT dia_no, label, pos, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY dia_no, label ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM t")
def context_window(spark, d):
    return D.context_window(C.turns(spark, d)).select("dia_no", "label", "pos", F.array_join("context", "\n").alias("context"))


# Sets, splits and samples --------------------------------------------------------------------------------------------

def _splits(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("dia_no")).distinct().withColumn("split", F.when(F.col("dia_no") % 10 < 8, "train").when(F.col("dia_no") % 10 == 8, "val").otherwise("test"))


@query("semi_split", B.with_(B.T) + "SELECT dia_no, label, pos FROM t WHERE dia_no % 10 < 8")
def semi_split(spark, d):
    return D.semi_split(C.turns(spark, d), _splits(spark, d), "train").select("dia_no", "label", "pos")


@query("anti_resume", B.with_(B.T) + "SELECT DISTINCT dia_no FROM t WHERE NOT (dia_no % 3 = 0 AND dia_no % 2 = 0)")
def anti_resume(spark, d):
    ids = _splits(spark, d).select("dia_no")
    return D.anti_resume(ids, ids.where("dia_no % 3 = 0").withColumn("is_complete", F.col("dia_no") % 2 == 0))


@query("limit_generate", B.with_(B.T) + "SELECT DISTINCT dia_no FROM t WHERE NOT (dia_no % 3 = 0 AND dia_no % 2 = 0) ORDER BY dia_no LIMIT 10")
def limit_generate(spark, d):
    ids = _splits(spark, d).select("dia_no")
    return D.limit_generate(ids, 10, ids.where("dia_no % 3 = 0").withColumn("is_complete", F.col("dia_no") % 2 == 0))


@query("load_dataset", B.with_(B.T) + """, v AS (SELECT dia_no, x AS variant FROM (SELECT DISTINCT dia_no FROM t), (SELECT unnest(['a', 'b', 'c']) AS x)),
 s AS (SELECT dia_no, 0 AS label, 'human' AS origin FROM (SELECT DISTINCT dia_no FROM t)
  UNION ALL SELECT dia_no, 1, variant FROM (SELECT *, row_number() OVER (PARTITION BY dia_no ORDER BY md5('2025|' || dia_no || '|' || variant), variant) AS n FROM v) WHERE n = 1)
 SELECT dia_no, CAST(label AS INTEGER) AS label, origin, 'conv' AS dataset, CASE WHEN dia_no % 10 < 8 THEN 'train' WHEN dia_no % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM s""")
def load_dataset(spark, d):
    ids = _splits(spark, d)
    human = ids.select("dia_no", F.lit("human").alias("origin"))
    machine = ids.select("dia_no", F.explode(F.array(*map(F.lit, "abc"))).alias("variant")).withColumn("origin", F.col("variant"))
    return D.load_dataset(human, machine, ids, "conv").select("dia_no", "label", "origin", "dataset", "split")


@query("sample_one_per_key", B.with_(B.T) + "SELECT dia_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY dia_no ORDER BY md5('2025|' || dia_no || '|' || pos), pos) AS n FROM t) WHERE n = 1")
def sample_one_per_key(spark, d):
    return D.sample_one_per_key(C.turns(spark, d).select("dia_no", "pos"), "dia_no", "pos")


@query("sample_n_rows", B.with_(B.T, B.U) + "SELECT dia_no, turn_no FROM u ORDER BY md5('2025|' || dia_no || '|' || turn_no), dia_no, turn_no LIMIT 100")
def sample_n_rows(spark, d):
    return D.sample_n_rows(C.user_turns(spark, d).select("dia_no", "turn_no"), ["dia_no", "turn_no"], 100)


@query("union_datasets_offset", B.with_(B.T) + ", i AS (SELECT DISTINCT dia_no FROM t) SELECT dia_no FROM i UNION ALL SELECT dia_no + (SELECT max(dia_no) + 1 FROM i) FROM i")
def union_datasets_offset(spark, d):
    ids = _splits(spark, d).select("dia_no")
    return D.union_datasets_offset(ids, ids)


RING_SQL = """SELECT *, lead({taken}) OVER (PARTITION BY bk ORDER BY h, dia_no, label, turn_no) AS nx, first_value({taken}) OVER (PARTITION BY bk ORDER BY h, dia_no, label, turn_no) AS fst, count(*) OVER (PARTITION BY bk) AS held, row_number() OVER (PARTITION BY bk ORDER BY h, dia_no, label, turn_no) AS place
  FROM (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % greatest(1, (SELECT count(*) FROM {rows}) // 1000) AS bk FROM (SELECT *, md5('2025|' || dia_no || '|' || label || '|' || turn_no) AS h FROM {rows}))"""


@query("negatives_random_pair", B.with_(B.T, B.U, "rg AS (" + RING_SQL.format(taken="text", rows="u") + ")") + "SELECT dia_no, label, turn_no, text, CASE WHEN place = held THEN fst ELSE nx END AS negative FROM rg WHERE held > 1")
def negatives_random_pair(spark, d):
    return D.negatives_random_pair(C.user_turns(spark, d).select(*KEY, "text"), KEY, "text")


# Features and masks --------------------------------------------------------------------------------------------------

@query("utt_features", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, idx, token FROM k")
def utt_features(spark, d):
    return C.explained_tokens(spark, d).select(*KEY, "idx", "token")


@query("n_features", B.with_(B.T, B.U, B.UT) + "SELECT dia_no, label, turn_no, CAST(len(tok) AS INTEGER) AS n_features FROM ut")
def n_features(spark, d):
    return C.explanations(spark, d).select(*KEY, "n_features")


@query("da_features", B.with_(B.T, B.TA, PREV_SQL) + f"""SELECT dia_no, label, turn_no, array_to_string(list_transform(flatten(list_filter([prev, acts], lambda u: NOT (len(u) = 1 AND u[1].intent = 'none'))), lambda a: {ACT_SQL}), ';') AS features FROM pv""")
def da_features(spark, d):
    return D.da_turn(C.turns(spark, d)).select("dia_no", "label", "turn_no", F.array_join(FE.da_features(F.array("prev_acts", "acts")), ";").alias("features"))


@query("dia_features", B.with_(B.T, B.TA, PREV_SQL) + f"""SELECT dia_no, label, turn_no, array_to_string(list_concat(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''),
  list_transform(flatten(list_filter([acts], lambda u: NOT (len(u) = 1 AND u[1].intent = 'none'))), lambda a: {ACT_SQL})), ' ') AS features FROM pv""")
def dia_features(spark, d):
    return D.da_turn(C.turns(spark, d)).select("dia_no", "label", "turn_no", F.array_join(FE.dia_features(F.array("text"), F.array("acts")), " ").alias("features"))


def _every_third(n):
    return F.transform(D.range_to(n), lambda i: F.when(i % 3 == 0, 0).otherwise(1))


@query("mask_apply_utt", B.with_(B.T, B.U, B.UT) + "SELECT dia_no, label, turn_no, trim(array_to_string(list_transform(tok, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '<mask>' ELSE x END), ' ')) AS masked FROM ut")
def mask_apply_utt(spark, d):
    return C.explanations(spark, d).select(*KEY, FE.mask_apply_utt(F.col("tok"), _every_third(F.col("n_features"))).alias("masked"))


@query("mask_apply_da", B.with_(B.T, B.TA, PREV_SQL) + f"""SELECT dia_no, label, turn_no, {UTT_ACTS.format('m')} AS masked FROM (SELECT dia_no, label, turn_no, list_transform([list_filter(prev, lambda a, i: (i - 1) % 3 <> 0 AND a.intent <> 'none'),
   list_filter(acts, lambda a, i: (i - 1 + CASE WHEN prev[1].intent = 'none' THEN 0 ELSE len(prev) END) % 3 <> 0 AND a.intent <> 'none')],
   lambda u: CASE WHEN len(u) = 0 THEN [{{'intent':'none','domain':'','slot':'','value':''}}] ELSE u END) AS m FROM pv)""")
def mask_apply_da(spark, d):
    rows = D.da_turn(C.turns(spark, d)).withColumn("utts", F.array("prev_acts", "acts"))
    return rows.select("dia_no", "label", "turn_no", utt_acts(FE.mask_apply_da(F.col("utts"), _every_third(F.size(F.flatten("utts"))))).alias("masked"))


@query("mask_apply_dia", B.with_(B.T, B.TA, PREV_SQL) + f"""SELECT dia_no, label, turn_no, trim(array_to_string(list_transform(tok, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '<mask>' ELSE x END), ' ')) AS masked_utt, {ACTS_SQL.format('m')} AS masked_da FROM
  (SELECT *, CASE WHEN len(kept) = 0 THEN [{{'intent':'none','domain':'','slot':'','value':''}}] ELSE kept END AS m FROM (SELECT *, list_filter(acts, lambda a, i: (i - 1 + len(tok)) % 3 <> 0 AND a.intent <> 'none') AS kept FROM
   (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS tok FROM pv)))""")
def mask_apply_dia(spark, d):
    rows = D.da_turn(C.turns(spark, d)).withColumn("tok", C.tokens(F.col("text"))).withColumn("utts", F.array("acts"))
    text, acts = FE.mask_apply_dia(F.col("tok"), F.col("utts"), _every_third(F.size("tok") + F.size("acts")))
    return rows.select("dia_no", "label", "turn_no", text.alias("masked_utt"), utt_acts(acts).alias("masked_da"))


@query("text_mask_imdb", B.with_(B.T, B.U, B.UT) + "SELECT dia_no, label, turn_no, array_to_string(list_filter(tok, lambda x, i: (i - 1) % 3 <> 0), ' ') AS masked FROM ut")
def text_mask_imdb(spark, d):
    return C.explanations(spark, d).select(*KEY, FE.mask_drop_words(F.col("tok"), _every_third(F.col("n_features"))).alias("masked"))


# Selection -----------------------------------------------------------------------------------------------------------

def _names(e):
    return F.array_join(F.transform(e, lambda x: F.concat_ws(" ", x["text"], x["idx"].cast("string"))), ",")


TOP_SQL = "SELECT dia_no, label, turn_no, coalesce(string_agg(token || ' ' || idx, ',' ORDER BY r) FILTER (WHERE r <= 3), '') AS features FROM ut LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY {}) AS r FROM {}) USING (dia_no, label, turn_no) GROUP BY ALL"


@query("topk_absolute", B.with_(B.T, B.U, B.UT, B.K) + TOP_SQL.format("abs(score) DESC, idx", "k"))
def topk_absolute(spark, d):
    return C.explanations(spark, d).select(*KEY, _names(SE.topk_absolute(F.col("explanation"), 3)).alias("features"))


@query("topk_prediction", B.with_(B.T, B.U, B.UT, B.K, B.P) + TOP_SQL.format("CASE WHEN pred = 1 THEN -score ELSE score END, idx", "(SELECT * FROM k JOIN p USING (dia_no, label, turn_no))"))
def topk_prediction(spark, d):
    rows = J.join_predictions(C.explanations(spark, d), C.predictions(spark, d))
    return rows.select(*KEY, _names(SE.topk_prediction(F.col("explanation"), F.col("pred"), 3)).alias("features"))


@query("expl_sort", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, string_agg(token || ' ' || idx, ',' ORDER BY abs(score) DESC, idx) AS features FROM k GROUP BY ALL")
def expl_sort(spark, d):
    return C.explanations(spark, d).where("n_features > 0").select(*KEY, _names(SE.expl_sort(F.col("explanation"))).alias("features"))


@query("sample_k_features", B.with_(B.T, B.U, B.UT, B.K) + TOP_SQL.format("md5('2025|' || dia_no || '|' || label || '|' || turn_no || '|' || idx), idx", "k"))
def sample_k_features(spark, d):
    e = C.explanations(spark, d)
    return e.select(*KEY, _names(SE.sample_k_features(F.col("explanation"), 3, [F.col(k) for k in KEY], 2025)).alias("features"))


@query("bias_filter", B.with_(B.T, B.U, B.UT) + "SELECT dia_no, label, turn_no, CAST(len(tok) + 1 AS INTEGER) AS n FROM ut")
def bias_filter(spark, d):
    """Each explanation holds the intercept, which goes, and a feature whose word is "bias", which stays."""
    more = F.array(F.struct(F.lit(-1).alias("idx"), F.lit("bias").alias("text"), F.lit(1.0).alias("score")), F.struct(F.col("n_features").alias("idx"), F.lit("bias").alias("text"), F.lit(1.0).alias("score")))
    e = C.explanations(spark, d).withColumn("explanation", F.concat("explanation", more))
    return e.select(*KEY, F.size(SE.bias_filter(F.col("explanation"))).alias("n"))


@query("id_filter", B.with_(B.T, B.U, B.UT) + "SELECT dia_no, label, turn_no, CAST(len(tok) AS INTEGER) AS n_features FROM ut WHERE (dia_no, label, turn_no) IN (SELECT dia_no, label, max(turn_no) FROM u GROUP BY dia_no, label)")
def id_filter(spark, d):
    """Explanations of given turns, here the last of every dialogue."""
    ids = C.user_turns(spark, d).groupBy("dia_no", "label").agg(F.max("turn_no").alias("turn_no"))
    return SE.id_filter(C.explanations(spark, d), ids).select(*KEY, "n_features")


@query("pred_class_filter", B.with_(B.T, B.U, B.UT, B.K, B.P) + "SELECT dia_no, label, turn_no, pred FROM p WHERE pred IN (1)")
def pred_class_filter(spark, d):
    return SE.pred_class_filter(C.predictions(spark, d), (1,)).select(*KEY, "pred")


@query("important_ids", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (WHERE r <= 3), '') AS ids FROM ut LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY abs(score) DESC, idx) AS r FROM k) USING (dia_no, label, turn_no) GROUP BY ALL")
def important_ids(spark, d):
    ids = SE.important_ids(SE.topk_absolute(F.col("explanation"), 3))
    return C.explanations(spark, d).select(*KEY, F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("importance_mask", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, coalesce(string_agg(CAST(r <= 3 AS INTEGER), '' ORDER BY idx), '') AS mask FROM ut LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY abs(score) DESC, idx) AS r FROM k) USING (dia_no, label, turn_no) GROUP BY ALL")
def importance_mask(spark, d):
    e = C.explanations(spark, d).withColumn("ids", SE.important_ids(SE.topk_absolute(F.col("explanation"), 3)))
    return e.select(*KEY, F.array_join(F.transform(SE.importance_mask(F.col("ids"), F.col("n_features")), lambda x: x.cast("string")), "").alias("mask"))


# Joins and lookups ---------------------------------------------------------------------------------------------------

@query("join_da_utt_expl", B.with_(B.T, B.TA, B.U, B.UA, B.UT, B.AX) + "SELECT dia_no, label, turn_no, CAST(len(tok) AS INTEGER) AS n_features_utt, n AS n_features_da FROM ut JOIN (SELECT dia_no, label, turn_no, count(*) AS n FROM ax GROUP BY ALL) USING (dia_no, label, turn_no)")
def join_da_utt_expl(spark, d):
    da = profiles.turn_acts(spark, d).groupBy(*KEY).agg(F.count("*").alias("n_features"))
    return J.join_da_utt_expl(da, C.explanations(spark, d).select(*KEY, "n_features")).select(*KEY, "n_features_utt", "n_features_da")


@query("join_expl_original", B.with_(B.T, B.TA, PREV_SQL, "s AS (SELECT dia_no, label, role, pos, acts, lag(acts) OVER (PARTITION BY dia_no, label ORDER BY pos) AS sys, CAST(sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY dia_no, label ORDER BY pos) - 1 AS INTEGER) AS turn_no FROM ta)") + "SELECT dia_no, label, turn_no, CAST(len(acts) AS INTEGER) AS n_da, CAST(CASE WHEN sys IS NULL OR len(sys) = 0 THEN 1 ELSE len(sys) END AS INTEGER) AS n_sys_da FROM s WHERE role = 'user'")
def join_expl_original(spark, d):
    rows = J.join_expl_original(C.explanations(spark, d).select(*KEY), C.turns(spark, d))
    return rows.select(*KEY, F.size("acts").alias("n_da"), "n_sys_da")


@query("join_predictions", B.with_(B.T, B.U, B.UT, B.K, B.P) + "SELECT dia_no, label, turn_no, CAST(len(tok) AS INTEGER) AS n_features, pred FROM ut LEFT JOIN p USING (dia_no, label, turn_no)")
def join_predictions(spark, d):
    return J.join_predictions(C.explanations(spark, d).select(*KEY, "n_features"), C.predictions(spark, d)).select(*KEY, "n_features", "pred")


@query("join_dia_modalities", B.with_(B.T, B.TA) + "SELECT dia_no, label, CAST(sum(len(acts)) AS BIGINT) AS n_acts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ta GROUP BY ALL")
def join_dia_modalities(spark, d):
    t = C.turns(spark, d)
    da = t.groupBy("dia_no", "label").agg(F.sum(F.size("acts")).alias("n_acts"))
    return J.join_dia_modalities(da, t.groupBy("dia_no", "label").agg(F.sum(F.length("text")).alias("n_chars")))


@query("lookup_prediction", B.with_(B.T, B.U, B.UT, B.K, B.P) + "SELECT dia_no, label, turn_no, round(prob, 6) AS prob FROM p WHERE pred = 1")
def lookup_prediction(spark, d):
    return C.user_turns(spark, d).select(*KEY).join(C.predictions(spark, d).where("pred = 1"), KEY).select(*KEY, r6("prob").alias("prob"))


#: The same joins as the removal orders take, over tables that are made once: turns with a known act, then the others.
FALLBACK_SQL = B.PROFILE + "," + B.metric_sql("agg_o").replace("m AS (", "m AS MATERIALIZED (", 1) + "," + B.K + """,
 wd AS MATERIALIZED (SELECT dia_no, label, turn_no, lower(token) AS ngram FROM k GROUP BY ALL),
 wn AS MATERIALIZED (SELECT DISTINCT ngram FROM wd),
 pa AS MATERIALIZED (SELECT intent AS i2, domain AS d2, slot AS s2, ngram, score FROM m WHERE scope = 'act' AND intent NOT IN ('greet', 'inform')),
 ps AS MATERIALIZED (SELECT DISTINCT i2, d2, s2 FROM pa),
 pw AS MATERIALIZED (SELECT pa.* FROM pa JOIN wn ON pa.ngram = wn.ngram),
 kn AS MATERIALIZED (SELECT DISTINCT dia_no, label, turn_no, i2, d2, s2 FROM ax JOIN ps ON intent = i2 AND domain = d2 AND slot = s2),
 kt AS MATERIALIZED (SELECT DISTINCT dia_no AS kd, label AS kl, turn_no AS ktn FROM kn),
 ac AS MATERIALIZED (SELECT wd.dia_no, wd.label, wd.turn_no, wd.ngram, sum(pw.score) AS score FROM wd JOIN kn ON wd.dia_no = kn.dia_no AND wd.label = kn.label AND wd.turn_no = kn.turn_no JOIN pw ON pw.i2 = kn.i2 AND pw.d2 = kn.d2 AND pw.s2 = kn.s2 AND pw.ngram = wd.ngram GROUP BY ALL),
 un AS MATERIALIZED (SELECT wd.* FROM wd LEFT JOIN kt ON dia_no = kd AND label = kl AND turn_no = ktn WHERE kd IS NULL),
 gl AS MATERIALIZED (SELECT m.ngram, m.score FROM m JOIN wn ON m.ngram = wn.ngram WHERE scope = 'global')
 SELECT dia_no, label, turn_no, ngram, round(score, 6) AS score FROM ac
 UNION ALL SELECT dia_no, label, turn_no, un.ngram, round(gl.score, 6) FROM un JOIN gl ON un.ngram = gl.ngram"""


@query("lookup_profile_fallback", FALLBACK_SQL)
def lookup_profile_fallback(spark, d):
    p = profiles.profile(spark, d, "agg_o").where("not (scope = 'act' and intent in ('greet', 'inform'))")
    words = C.explained_tokens(spark, d).select(*KEY, F.lower("token").alias("ngram")).distinct()
    return J.lookup_profile(profiles.turn_acts(spark, d), words, p).select(*KEY, "ngram", r6("score").alias("score"))


@query("lookup_slot_desc", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, act_i, CASE WHEN slot = 'price' THEN 'price per night' ELSE slot END AS slot_text FROM ax")
def lookup_slot_desc(spark, d):
    slots = spark.createDataFrame([("price", "price per night")], "slot string, description string")
    return J.lookup_slot_desc(profiles.turn_acts(spark, d), slots).select(*KEY, "act_i", "slot_text")


@query("containment_self", B.with_(B.T, B.U, B.UT, B.NG) + ", ph AS (SELECT DISTINCT label AS scope, ngram AS phrase FROM ng WHERE n <= 2) SELECT DISTINCT a.scope, a.phrase AS long, b.phrase AS short FROM (SELECT scope, phrase, unnest(string_split(phrase, ' ')) AS w FROM ph) a JOIN ph b ON a.scope = b.scope AND b.phrase = a.w AND a.phrase <> b.phrase")
def containment_self(spark, d):
    """Of phrases of one or two words, what a longer phrase can hold is one of its words."""
    rows = profiles.turn_ngrams(spark, d, 2)
    return J.containment_self(rows.select(F.col("label").alias("scope"), F.col("ngram").alias("phrase")).distinct())


# Profiles ------------------------------------------------------------------------------------------------------------

@query("ngrams", B.with_(B.T, B.U, B.UT, B.NG) + "SELECT ngram, count(*) AS n, round(sum(score), 6) AS score FROM ng GROUP BY ALL")
def ngrams(spark, d):
    return profiles.turn_ngrams(spark, d).groupBy("ngram").agg(F.count("*").alias("n"), r6(F.sum("score")).alias("score"))


@query("count_tokens", B.with_(B.T, B.U, B.UT, B.K) + "SELECT lower(token) AS token, count(*) AS n FROM k GROUP BY ALL")
def count_tokens(spark, d):
    return C.explained_tokens(spark, d).groupBy(F.lower("token").alias("token")).count().withColumnRenamed("count", "n")


@query("distinct_da", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT DISTINCT intent, domain, slot FROM ax")
def distinct_da(spark, d):
    return PR.distinct_da(profiles.turn_acts(spark, d))


def _metric_queries(name: str) -> None:
    @query(f"profile_{name}_global", B.PROFILE + "," + B.metric_sql(name) + " SELECT ngram, round(score, 6) AS score FROM m WHERE scope = 'global'")
    def whole(spark, d):
        return profiles.profile_global(profiles.profile_rows(spark, d), name).select("ngram", r6("score").alias("score"))

    @query(f"profile_{name}_by_da", B.PROFILE + "," + B.metric_sql(name) + " SELECT intent, domain, slot, ngram, round(score, 6) AS score FROM m WHERE scope = 'act'")
    def by_act(spark, d):
        return profiles.profile(spark, d, name).where("scope = 'act'").select("intent", "domain", "slot", "ngram", r6("score").alias("score"))


for _name in METRICS:
    _metric_queries(_name)


@query("top20_profile", B.PROFILE + "," + B.metric_sql("fwlor") + """ SELECT scope, intent, domain, slot, side, CAST(rank AS INTEGER) AS rank, ngram, abs(s) AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY scope, intent, domain, slot, side ORDER BY abs(s) DESC, ngram) AS rank FROM
   (SELECT *, round(score, 6) AS s, CASE WHEN round(score, 6) > 0 THEN 'ai' ELSE 'human' END AS side FROM m WHERE round(score, 6) <> 0)) WHERE rank <= 20""")
def top20_profile(spark, d):
    p = profiles.profile(spark, d).withColumn("score", r6("score"))
    return PR.top_profile(p).select("scope", "intent", "domain", "slot", "side", "rank", "ngram", "score")


@query("sum_profiles", B.PROFILE + "," + B.metric_sql("agg_s") + " SELECT intent, ngram, round(sum(score), 6) AS score FROM m WHERE scope = 'act' GROUP BY ALL")
def sum_profiles(spark, d):
    return PR.sum_profiles(profiles.profile(spark, d, "agg_s").where("scope = 'act'"), ["intent"]).select("intent", "ngram", r6("score").alias("score"))


@query("concat_profiles", B.PROFILE + " SELECT scope, intent, slot, count(*) AS n, CAST(sum(a_n) AS BIGINT) AS a_n, CAST(sum(b_n) AS BIGINT) AS b_n FROM c GROUP BY ALL")
def concat_profiles(spark, d):
    return PR.profile_counts(profiles.profile_rows(spark, d)).groupBy("scope", "intent", "slot").agg(F.count("*").alias("n"), F.sum("a_n").alias("a_n"), F.sum("b_n").alias("b_n"))


@query("empty_scopes", B.PROFILE + ", x AS (SELECT DISTINCT 'act' AS scope, intent, domain, slot FROM ax UNION SELECT 'act', 'none', '', '') SELECT x.intent, x.slot, count(c.ngram) AS n FROM x LEFT JOIN c USING (scope, intent, domain, slot) GROUP BY ALL")
def empty_scopes(spark, d):
    acts = profiles.turn_acts(spark, d).select("intent", "domain", "slot").unionByName(spark.createDataFrame([("none", "", "")], "intent string, domain string, slot string"))
    p = PR.with_empty_scopes(profiles.profile(spark, d), acts)
    return p.where("scope = 'act'").groupBy("intent", "slot").agg(F.count("ngram").alias("n"))


SPAN_SQL = """, sp AS (SELECT dia_no, label, turn_no, idx - row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY idx) AS g, idx, token, score FROM k WHERE score > 0),
 ph AS (SELECT dia_no, label, turn_no, min(idx) AS first, string_agg(token, ' ' ORDER BY idx) AS phrase, round(avg(score), 6) AS utt_expl FROM sp GROUP BY dia_no, label, turn_no, g)"""


@query("consecutive_spans", B.with_(B.T, B.U, B.UT, B.K) + SPAN_SQL + " SELECT dia_no, label, turn_no, first, phrase FROM ph")
def consecutive_spans(spark, d):
    return PR.consecutive_spans(C.explained_tokens(spark, d).where("score > 0"), KEY).select(*KEY, "first", "phrase")


@query("phrases", B.with_(B.T, B.U, B.UT, B.K) + SPAN_SQL + " SELECT dia_no, label, turn_no, first, phrase, utt_expl FROM ph")
def phrases(spark, d):
    return PR.phrases(C.explained_tokens(spark, d).where("score > 0"), KEY).select(*KEY, "first", "phrase", r6("utt_expl").alias("utt_expl"))


TAG_SQL = r"regexp_replace(regexp_replace({text}, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])' || regexp_escape({value}) || '($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1<' || {slot} || '>\2', 'g'), '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])' || regexp_escape({value}) || '($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1<' || {slot} || '>\2', 'g')"


@query("slot_tag", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, slot, value, CASE WHEN slot = '' THEN text ELSE regexp_replace(" + TAG_SQL.format(text="text", value="value", slot="slot") + ", '(<' || slot || '>)(\\s+<' || slot || '>)+', '\\1', 'g') END AS tagged FROM ax JOIN u USING (dia_no, label, turn_no) WHERE value <> ''")
def slot_tag(spark, d):
    u = C.user_turns(spark, d).withColumn("a", F.explode("acts")).where(F.col("a.value") != "")
    return u.select(*KEY, F.col("a.slot").alias("slot"), F.col("a.value").alias("value"), PR.slot_tag(F.col("text"), F.col("a.value"), F.col("a.slot")).alias("tagged"))


# Evaluation ----------------------------------------------------------------------------------------------------------

METRIC_SQL = """SELECT {by} cl AS class, n AS n_samples, round(acc, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM
 (SELECT {by} cl, count(*) AS n, avg(CAST(y = p AS INTEGER)) AS acc, sum(CAST(y = cl AND p = cl AS INTEGER)) AS tp, sum(CAST(y <> cl AND p = cl AS INTEGER)) AS fp, sum(CAST(y = cl AND p <> cl AS INTEGER)) AS fn
  FROM {rows}, (SELECT unnest([0, 1]) AS cl) GROUP BY ALL) WHERE tp + fp + fn > 0"""


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("metrics_cls", B.with_(B.T, B.U, B.UT, B.K, B.P) + METRIC_SQL.format(by="", rows="(SELECT label AS y, pred AS p FROM p)"))
def metrics_cls(spark, d):
    return _rounded(E.metrics_cls(C.predictions(spark, d)))


@query("metrics_labels", METRIC_SQL.format(by="", rows="(SELECT toxic AS y, 1 - quality AS p FROM labels)"))
def metrics_labels(spark, d):
    return _rounded(E.metrics_cls(spark.read.parquet(f"{d}/labels.parquet").select(F.col("toxic").alias("label"), (1 - F.col("quality")).alias("pred"))))


@query("metrics_online", B.with_(B.T, B.U, B.UT, B.K, B.P) + ", o AS (SELECT turn_no, label AS y, pred AS p FROM p WHERE turn_no < 10 UNION ALL SELECT -1, label, pred FROM (SELECT *, max(turn_no) OVER (PARTITION BY dia_no) AS last FROM p) WHERE turn_no = last) " + METRIC_SQL.format(by="turn_no,", rows="o"))
def metrics_online(spark, d):
    from pyspark.sql import Window as W

    p = C.predictions(spark, d)
    return _rounded(E.metrics_online(p.withColumn("is_complete", F.col("turn_no") == F.max("turn_no").over(W.partitionBy("dia_no", "label")))))


@query("keep_ratio", B.with_(B.T, B.U, B.UT) + "SELECT round(avg(least(len(tok), 3) / len(tok)), 6) AS keep_ratio FROM ut WHERE len(tok) > 0")
def keep_ratio(spark, d):
    e = C.explanations(spark, d).withColumn("important_features", SE.important_ids(SE.topk_absolute(F.col("explanation"), 3)))
    return _rounded(E.keep_ratio(e))


@query("accuracy_thr", B.with_(B.T, B.U, B.UT, B.K, B.P) + "SELECT round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM p")
def accuracy_thr(spark, d):
    return _rounded(E.accuracy_thr(C.predictions(spark, d)))


@query("pct_like", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, round_even(avg(CAST(score > 0 AS INTEGER)) * 100, 2) AS ai, round_even(avg(CAST(score <= 0 AS INTEGER)) * 100, 2) AS human FROM k GROUP BY ALL")
def pct_like(spark, d):
    e = C.explanations(spark, d).where("n_features > 0")
    return e.select(*KEY, E.pct_like(F.col("explanation"), True).alias("ai"), E.pct_like(F.col("explanation"), False).alias("human"))


@query("timing_stats", "SELECT event_type AS stage, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL")
def timing_stats(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return _rounded(E.timing_stats(rows))


REMOVAL_SQL = """, dt AS (SELECT dia_no, label, turn_no, lower(token) AS token, max(score) AS score FROM k GROUP BY ALL),
 ro AS (SELECT dia_no, label, turn_no, token, score, pred, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY CASE WHEN pred = 1 THEN -score ELSE score END, token) AS step FROM dt JOIN p USING (dia_no, label, turn_no))"""


def _removal(spark, d):
    own = C.explained_tokens(spark, d).groupBy(*KEY, F.lower("token").alias("token")).agg(F.max("score").alias("score"))
    return E.removal_order_original(own.join(C.predictions(spark, d), KEY))


@query("removal_order_original", B.with_(B.T, B.U, B.UT, B.K, B.P) + REMOVAL_SQL + " SELECT dia_no, label, turn_no, CAST(step AS INTEGER) AS step, token FROM ro")
def removal_order_original(spark, d):
    return _removal(spark, d).select(*KEY, "step", "token")


@query("removal_order_accel", B.PROFILE + "," + B.metric_sql("agg_s") + "," + B.K + "," + B.P + """, gl AS (SELECT ngram, round(score, 9) AS s FROM m WHERE scope = 'global'),
 rk AS (SELECT *, row_number() OVER (ORDER BY s DESC, ngram) AS up, row_number() OVER (ORDER BY s, ngram) AS down FROM gl)
 SELECT dia_no, label, turn_no, CAST(CASE WHEN pred = 1 THEN up ELSE down END AS INTEGER) AS step, ngram AS token FROM p JOIN rk ON CASE WHEN pred = 1 THEN up ELSE down END < 10""")
def removal_order_accel(spark, d):
    scores = profiles.profile_global(profiles.profile_rows(spark, d), "agg_s").select("ngram", F.round("score", 9).alias("score"))
    return E.removal_order_accel(scores, C.predictions(spark, d).select(*KEY, "pred"), 10).select(*KEY, "step", "token")


@query("removal_order_random", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, token, CAST(row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY md5('2025|' || dia_no || '|' || turn_no || '|' || label || '|' || token)) AS INTEGER) AS step FROM (SELECT DISTINCT dia_no, label, turn_no, lower(token) AS token FROM k)")
def removal_order_random(spark, d):
    own = C.explained_tokens(spark, d).select(*KEY, F.lower("token").alias("token")).distinct()
    return E.random_order(own)


def _states(spark, d, depth: int = 6):
    order = _removal(spark, d).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "token"))), lambda x: x["token"]).alias("order"))
    rows = C.explanations(spark, d).select(*KEY, "tok").join(order, KEY)
    return E.remove_iterative(rows, depth)


STATES_SQL = REMOVAL_SQL + """, od AS (SELECT dia_no, label, turn_no, list(token ORDER BY step) AS ord FROM ro GROUP BY ALL),
 st AS (SELECT dia_no, label, turn_no, CAST(s AS INTEGER) AS step, list_filter(tok, lambda x: NOT list_contains(list_slice(ord, 1, s), lower(x))) AS state FROM ut JOIN od USING (dia_no, label, turn_no), (SELECT unnest(range(0, 6)) AS s))"""


@query("remove_iterative", B.with_(B.T, B.U, B.UT, B.K, B.P) + STATES_SQL + " SELECT dia_no, label, turn_no, step, array_to_string(state, ' ') AS state FROM st")
def remove_iterative(spark, d):
    return _states(spark, d).select(*KEY, "step", F.array_join("state", " ").alias("state"))


@query("aopc", B.with_(B.T, B.U, B.UT, B.K, B.P) + STATES_SQL + """, pb AS (SELECT dia_no, label, turn_no, step, 1 / (1 + exp(-coalesce(list_sum(list_transform(state, lambda x: (length(x) % 5 - 2) / 10.0)), 0))) AS prob FROM st)
 SELECT dia_no, label, turn_no, step, round(first_value(prob) OVER w - avg(prob) OVER w, 6) AS aopc FROM pb WINDOW w AS (PARTITION BY dia_no, label, turn_no ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def aopc(spark, d):
    logit = F.aggregate(F.transform("state", C.lexicon_weight), F.lit(0.0), lambda a, x: a + x)
    rows = _states(spark, d).withColumn("prob", 1 / (1 + F.exp(-logit)))
    return E.aopc(rows, KEY).select(*KEY, "step", r6("aopc").alias("aopc"))


@query("position_bucket", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, idx, CASE WHEN idx <= len(tok) // 3 THEN 'beginning' WHEN idx > 2 * (len(tok) // 3) THEN 'end' ELSE 'middle' END AS bucket FROM k JOIN ut USING (dia_no, label, turn_no)")
def position_bucket(spark, d):
    n = C.explanations(spark, d).select(*KEY, "n_features")
    return C.explained_tokens(spark, d).join(n, KEY).select(*KEY, "idx", E.position_bucket(F.col("idx"), F.col("n_features")).alias("bucket"))


def _spaced(spark, d):
    return C.user_turns(spark, d).select(*KEY, F.posexplode(X.spaced_tokens(F.col("text"))).alias("idx", "token"))


@query("sentence_index", B.with_(B.T, B.U) + """, s AS (SELECT dia_no, label, turn_no, CAST(i - 1 AS INTEGER) AS idx, w[i] AS token FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT dia_no, label, turn_no, list_filter(regexp_split_to_array(regexp_replace(text, '([,.?''])', ' \\1', 'g'), '\\s+'), lambda x: x <> '') AS w FROM u))),
 e AS (SELECT *, CAST(token IN ('.', '?', '!') AND NOT (token = '.' AND coalesce(lag(token) OVER w IN ('St', 'Mr', 'Mrs', 'Ms', 'Dr', 'Prof', 'Mt'), false)) AND NOT coalesce(regexp_matches(lead(token) OVER w, '^\\p{Ll}'), false) AS INTEGER) AS fin FROM s WINDOW w AS (PARTITION BY dia_no, label, turn_no ORDER BY idx))
 SELECT dia_no, label, turn_no, idx, CAST(coalesce(sum(fin) OVER (PARTITION BY dia_no, label, turn_no ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INTEGER) AS sentence FROM e""")
def sentence_index(spark, d):
    return X.sentences(_spaced(spark, d), KEY).select(*KEY, "idx", "sentence")


@query("top1_token", B.with_(B.T, B.U, B.UT, B.K) + "SELECT dia_no, label, turn_no, idx, token, prev FROM (SELECT *, lag(token) OVER (PARTITION BY dia_no, label, turn_no ORDER BY idx) AS prev, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY score DESC, idx) AS r FROM k) WHERE r = 1")
def top1_token(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy(*KEY)
    k = C.explained_tokens(spark, d).withColumn("prev", F.lag("token").over(w.orderBy("idx"))).withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "idx")))
    return k.where("r = 1").select(*KEY, "idx", "token", "prev")


# Matching ------------------------------------------------------------------------------------------------------------

EMB_SQL = """v AS (SELECT vec_id, label, vec_id % 50 AS g, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
 sm AS (SELECT a.g, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.x, b.x) AS sim FROM v a JOIN v b ON a.g = b.g AND a.label < 5 AND b.label >= 5)"""
CSLS_SQL = """, rk AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY sim DESC, j) AS ri, row_number() OVER (PARTITION BY g, j ORDER BY sim DESC, i) AS rj FROM sm),
 cs AS (SELECT g, i, j, sim, 2 * sim - avg(CASE WHEN ri <= 5 THEN sim END) OVER (PARTITION BY g, i) - avg(CASE WHEN rj <= 5 THEN sim END) OVER (PARTITION BY g, j) AS csls FROM rk)"""
MATCH_SQL = CSLS_SQL + """, ct AS (SELECT g, i, j, round_even(csls, 4) AS csls FROM cs), th AS (SELECT *, min(csls) OVER (PARTITION BY g, i) + 0.9 * (max(csls) OVER (PARTITION BY g, i) - min(csls) OVER (PARTITION BY g, i)) AS lim FROM ct)"""


def _sides(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 50).alias("g"), "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return e.where("label < 5").select("g", F.col("vec_id").alias("i"), "vec"), e.where("label >= 5").select("g", F.col("vec_id").alias("j"), "vec")


@query("cosine_max", B.with_(EMB_SQL) + "SELECT g, i, j, round(sim, 6) AS sim FROM sm")
def cosine_max(spark, d):
    return M.Blocks(*_sides(spark, d), ["g"]).pairwise_sim().select("g", "i", "j", r6("sim").alias("sim"))


@query("csls", B.with_(EMB_SQL) + CSLS_SQL + " SELECT g, i, j, round(csls, 6) AS csls FROM cs")
def csls(spark, d):
    return M.Blocks(*_sides(spark, d), ["g"]).csls().select("g", "i", "j", r6("csls").alias("csls"))


@query("rel_threshold", B.with_(EMB_SQL) + MATCH_SQL + " SELECT g, i, j, csls FROM th WHERE csls >= lim")
def rel_threshold(spark, d):
    return M.Blocks(*_sides(spark, d), ["g"]).match_corpus().select("g", "i", "j", "csls")


@query("match_flip", B.with_(EMB_SQL) + MATCH_SQL + " SELECT g, j, string_agg(i, ',' ORDER BY csls DESC, i) AS tokens FROM th WHERE csls >= lim GROUP BY ALL")
def match_flip(spark, d):
    return M.match_flip(M.Blocks(*_sides(spark, d), ["g"]).match_corpus(), ["g"]).select("g", "j", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"))


@query("da_to_text", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, act_i, trim(regexp_replace(concat_ws(' ', intent, slot, value), ' +', ' ', 'g')) AS text FROM ax")
def da_to_text(spark, d):
    return profiles.turn_acts(spark, d).select(*KEY, "act_i", M.da_to_text(F.col("intent"), F.col("slot"), F.col("value")).alias("text"))


@query("train_pairs", B.with_(B.T, B.TA, PREV_SQL) + """, x AS (SELECT dia_no, label, turn_no, text AS utt, array_to_string(list_transform(acts, lambda a: trim(regexp_replace(concat_ws(' ', a.intent, a.slot, a.value), ' +', ' ', 'g'))), ';') AS w, array_to_string(list_transform(acts, lambda a: trim(regexp_replace(concat_ws(' ', a.intent, a.slot), ' +', ' ', 'g'))), ';') AS o FROM pv),
 pr AS (SELECT *, {'w': w, 'o': o} AS both_ FROM x), rg AS (""" + RING_SQL.format(taken="both_", rows="pr") + """), ng AS (SELECT utt, CASE WHEN place = held THEN fst ELSE nx END AS n FROM rg WHERE held > 1)
 SELECT utt, w AS acts, 1 AS y FROM x UNION ALL SELECT utt, o, 1 FROM x UNION ALL SELECT utt, n.w, 0 FROM ng UNION ALL SELECT utt, n.o, 0 FROM ng""")
def train_pairs(spark, d):
    """Turns with their own acts, and with those of another turn."""
    rows = D.da_turn(C.turns(spark, d))
    texts = lambda v: F.array_join(F.transform("acts", lambda a: M.da_to_text(a["intent"], a["slot"], a["value"] if v else F.lit(""))), ";")
    own = rows.select(*KEY, F.col("text").alias("utt"), F.struct(texts(True).alias("with_value"), texts(False).alias("without_value")).alias("both_"))
    other = D.negatives_random_pair(own, KEY, "both_")
    return M.train_pairs(own.select("utt", "both_.*"), other.select("utt", "negative.*"))


# Acts and texts ------------------------------------------------------------------------------------------------------

@query("mask_sensitive_slot", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, act_i, CASE WHEN slot = 'name' AND value <> '' THEN '[name]' ELSE value END AS value FROM ax")
def mask_sensitive_slot(spark, d):
    u = C.user_turns(spark, d).select(*KEY, F.posexplode(AC.mask_sensitive_slot(F.col("acts"))).alias("act_i", "a"))
    return u.select(*KEY, "act_i", F.col("a.value").alias("value"))


ONTOLOGY = AC.Ontology(frozenset({"inform", "request", "greet", "bye"}), frozenset({"general", "travel"}), {"name": (), "price": ("the", "of")})


@query("check_acts", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, act_i, concat_ws(',', CASE WHEN intent = 'thank' THEN 'intent' END, CASE WHEN slot = 'price' AND value NOT IN ('the', 'of', '') THEN 'value' END) AS invalid FROM ax")
def check_acts(spark, d):
    return AC.check_acts(profiles.turn_acts(spark, d), ONTOLOGY).select(*KEY, "act_i", F.array_join("invalid", ",").alias("invalid"))


@query("fix_acts")
def fix_acts(spark, d):
    rows = AC.fix_acts(C.user_turns(spark, d), ONTOLOGY, "text", "acts")
    return rows.select(*KEY, join_acts(F.col("acts")).alias("acts"))


@query("parse_da_serial", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, act_i, intent, domain, slot, value FROM ax")
def parse_da_serial(spark, d):
    rows = C.user_turns(spark, d).where(F.size("acts") > 0)
    body = F.array_join(F.transform("acts", lambda a: F.concat(F.lit("["), a["intent"], F.lit("]["), a["domain"], F.lit("](["), a["slot"], F.lit("]["), a["value"], F.lit("])"))), ";")
    parsed = rows.select(*KEY, F.posexplode(AC.parse_da_serial(body)).alias("act_i", "a"))
    return parsed.select(*KEY, "act_i", "a.intent", "a.domain", "a.slot", "a.value")


@query("parse_da_json", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, act_i, intent, domain, slot FROM ax")
def parse_da_json(spark, d):
    text = F.concat(F.lit("so <DA>"), F.to_json(F.transform("acts", lambda a: F.array(a["intent"], a["domain"], a["slot"], a["value"]))), F.lit("</DA>"))
    rows = C.user_turns(spark, d).select(*KEY, F.posexplode(AC.parse_da_json(text)).alias("act_i", "a"))
    return rows.select(*KEY, "act_i", *[F.get("a", F.lit(i)).alias(n) for i, n in enumerate(("intent", "domain", "slot"))])


@query("da_examples", B.with_(B.T) + "SELECT dia_no, label, pos, context FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY dia_no, label ORDER BY pos), '') AS context FROM t) WHERE role = 'user'")
def da_examples(spark, d):
    return AC.da_examples(C.turns(spark, d), "user").select("dia_no", "label", "pos", "context")


@query("parse_masked", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(replace(text, '<', ' ')) END AS masked FROM conversations")
def parse_masked(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", F.replace("text", F.lit("<"), F.lit(" ")))
    return c.select("conv_id", "turn", X.parse_masked(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x<DIA>"), "text", F.lit("</DIA>"))).otherwise(F.col("text"))).alias("masked"))


@query("mask_validate", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(text, 'e', '[e]') ELSE text END AS text FROM conversations")
def mask_validate(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    other = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit("e"), F.lit("[e]"))).otherwise(F.concat("text", F.lit("\nmore")))
    return c.select("conv_id", "turn", X.mask_validate(F.col("text"), other).alias("text"))


@query("parse_goal", "SELECT conv_id, turn, '1,2' AS goals, role AS outcomes FROM conversations WHERE turn % 2 = 0")
def parse_goal(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<THINK>x</THINK><GOAL> 1 </GOAL><OUTCOME>"), "role", F.lit("</OUTCOME><ALT_GOAL>2</ALT_GOAL>"))).otherwise(F.lit("<GOAL>1</GOAL>"))
    goals, outcomes = X.parse_goal(text)
    return c.select("conv_id", "turn", F.array_join(goals, ",").alias("goals"), F.array_join(outcomes, ",").alias("outcomes")).where("goals is not null")


@query("parse_admin", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(turn AS INTEGER) ELSE -1 END AS goal FROM conversations")
def parse_admin(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    shown = F.when(F.col("role") == "user", F.col("turn").cast("string")).otherwise("none")
    return c.select("conv_id", "turn", F.coalesce(X.parse_admin(F.concat(F.lit("is <goal> "), shown, F.lit(" </goal>"))), F.lit(-1)).alias("goal"))


@query("parse_utterance", """SELECT conv_id, turn, CASE WHEN NOT contains(text, 'system:') AND NOT contains(text, 'user:') AND regexp_matches(clean, '^[!-~áéíóúàèüöäñçÁÉÍÓÚÀÈÜÖÄÑÇ—€£ãõâêîôûÂÊÎÔÛ ]*$') THEN 'user: ' || clean END AS line
  FROM (SELECT conv_id, turn, text, replace(replace(trim(replace(text, chr(10), ' ')), '‘', chr(39)), '’', chr(39)) AS clean FROM conversations)""")
def parse_utterance(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", X.parse_utterance(F.concat(F.lit("user:"), F.col("text")), "user").alias("line"))


@query("char_whitelist", "SELECT conv_id, turn, regexp_matches(text, '^[!-~áéíóúàèüöäñçÁÉÍÓÚÀÈÜÖÄÑÇ—€£ãõâêîôûÂÊÎÔÛ ]*$') AS ok FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)")
def char_whitelist(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", X.english_only(C.one_line(F.col("text"))).alias("ok"))


@query("strip_end", r"""SELECT conv_id, turn, trim(regexp_replace(said, '(?i)[^\w\s]+\b(?:END|STOP)\b[^\w\s]+', '', 'g')) AS text, regexp_matches(said, '(?i)[^\w\s]+\b(?:END|STOP)\b[^\w\s]+') AS ended
  FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' [END]' ELSE '' END AS said FROM conversations)""")
def strip_end(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    text, ended = X.strip_end(F.concat("text", F.when(F.col("turn") % 2 == 0, " [END]").otherwise("")))
    return c.select("conv_id", "turn", text.alias("text"), ended.alias("ended"))


@query("goal_split", "SELECT conv_id, turn, 'a|' || role AS goals, 'b' AS outcomes FROM conversations")
def goal_split(spark, d):
    goals, outcomes = X.goal_split(F.concat(F.lit("a <sep> "), "role", F.lit(" <outcome> b")))
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(goals, "|").alias("goals"), F.array_join(outcomes, "|").alias("outcomes"))


@query("act_to_readable", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + "SELECT dia_no, label, turn_no, act_i, upper(intent[1]) || intent[2:] || ' - General - ' || CASE WHEN slot = '' THEN '' ELSE upper(slot[1]) || slot[2:] END || ' = ' || CASE WHEN value = '' THEN '[unspecified]' ELSE value END AS readable FROM ax")
def act_to_readable(spark, d):
    return profiles.turn_acts(spark, d).select(*KEY, "act_i", X.act_to_readable(*[F.col(c) for c in ("intent", "domain", "slot", "value")]).alias("readable"))


# Attribution ---------------------------------------------------------------------------------------------------------

@query("masks_banzhaf_all", B.with_(B.T, B.TA, B.U, B.UA) + "SELECT dia_no, label, turn_no, CAST(i AS BIGINT) AS mask_id, array_to_string(list_transform(range(0, n), lambda b: (i >> (n - 1 - b)) & 1), '') AS mask FROM (SELECT *, unnest(range(0, CAST(power(2, n) AS BIGINT))) AS i FROM (SELECT dia_no, label, turn_no, len(acts) AS n FROM ua) WHERE n > 0)")
def masks_banzhaf_all(spark, d):
    """All masks over the acts of each turn."""
    rows = C.user_turns(spark, d).select(*KEY, F.size("acts").alias("n_features"))
    return AT.masks_banzhaf_all(rows).select(*KEY, "mask_id", F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"))


def _terms(df):
    return df.select("dia_no", "turn_no", "label", "n_features", F.round("r2", 4).alias("r2"), F.posexplode("explanation").alias("rank", "e")).select("dia_no", "turn_no", "label", "n_features", "r2", "rank", F.array_join(F.transform("e.features", lambda f: F.concat_ws(" ", f["text"], f["idx"].cast("string"))), "+").alias("features"), F.round("e.score", 4).alias("score"))


@query("faith_shap")
def faith_shap(spark, d):
    scorer = S.LexiconScorer()
    return _terms(AT.attribute(C.explanations(spark, d), scorer.predict, "faith_shap", 200, on_masks=scorer.probabilities_on_masks))


def _ranked_terms(df):
    """``_terms`` with ranks by rounded scores, then by the features' places."""
    rows = df.select("dia_no", "turn_no", "label", "n_features", F.round("r2", 4).alias("r2"), F.explode("explanation").alias("e"))
    rows = rows.select("dia_no", "turn_no", "label", "n_features", "r2", F.transform("e.features", lambda f: f["idx"]).alias("of"), F.array_join(F.transform("e.features", lambda f: F.concat_ws(" ", f["text"], f["idx"].cast("string"))), "+").alias("features"), (F.round("e.score", 4) + 0.0).alias("score"))
    rank = F.row_number().over(W.partitionBy("dia_no", "turn_no", "label").orderBy(F.abs("score").desc(), "of")) - 1
    return rows.withColumn("rank", rank).drop("of")


@query("shapley_taylor", B.with_(B.T, B.U, B.UT, B.K) + """, te AS (SELECT dia_no, label, turn_no, [idx] AS of, token || ' ' || idx AS features, round(score, 4) + 0.0 AS score FROM k
  UNION ALL SELECT a.dia_no, a.label, a.turn_no, [a.idx, b.idx], a.token || ' ' || a.idx || '+' || b.token || ' ' || b.idx, 0.0 FROM k a JOIN k b ON a.dia_no = b.dia_no AND a.label = b.label AND a.turn_no = b.turn_no AND a.idx < b.idx)
 SELECT dia_no, turn_no, label, CAST(len(tok) AS INTEGER) AS n_features, 1.0 AS r2, features, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY dia_no, turn_no, label ORDER BY abs(score) DESC, of) - 1 AS INTEGER) AS rank FROM te JOIN ut USING (dia_no, label, turn_no)""")
def shapley_taylor(spark, d):
    """Single words and pairs: for the linear scorer a word's term is its weight, and no pair has any."""
    scorer = S.LexiconScorer()
    return _ranked_terms(AT.attribute(C.explanations(spark, d), scorer.logit, "shapley_taylor", 50, order=2, on_masks=scorer.on_masks))


@query("shapley_interaction")
def shapley_interaction(spark, d):
    return _terms(AT.attribute(C.explanations(spark, d), S.LexiconScorer().logit, "shapley_interaction", 50, order=2))


@query("perturb_driver")
def perturb_driver(spark, d):
    rows = AT.perturb(C.explanations(spark, d), "faith_shap", 20)
    return S.score_prob(rows, S.LexiconScorer(), "masked", "y").select("dia_no", "turn_no", "label", "mask_id", "masked", r6("y").alias("y"))


# Models, reports and sessions ----------------------------------------------------------------------------------------

@query("score_prob", B.with_(B.T, B.U, B.UT, B.K, B.P) + "SELECT dia_no, label, turn_no, round(prob, 6) AS prob FROM p")
def score_prob(spark, d):
    return S.score_prob(C.user_turns(spark, d).select(*KEY, "text"), S.LexiconScorer()).select(*KEY, r6("prob").alias("prob"))


@query("predict_rows", B.with_(B.T, B.U, B.UT, B.K, B.P) + "SELECT dia_no, label, turn_no, round(1 / (1 + exp(-2 * logit)), 6) AS prob, CAST(logit > 0 AS INTEGER) AS pred_label FROM p")
def predict_rows(spark, d):
    rows = S.predict_rows(C.predictions(spark, d).withColumn("pred_logit", F.array(-F.col("logit"), F.col("logit"))))
    return rows.select(*KEY, r6(F.get("pred_prob", F.lit(1))).alias("prob"), "pred_label")


@query("late_fusion", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: greatest(a.embedding[i], b.embedding[i]))), 4) AS mx, round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i] + b.embedding[i]) / 2)), 4) AS av FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def late_fusion(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    total = lambda how: F.round(F.aggregate(S.fuse(F.col("a"), F.col("b"), how), F.lit(0.0), lambda s, x: s + x), 4)
    return rows.select("vec_id", total("max").alias("mx"), total("average").alias("av"))


@query("phrase_weight", B.PROFILE + "," + B.metric_sql("fwlor") + " SELECT ngram, round(score * ln(len(string_split(ngram, ' ')) + 1), 6) AS weight FROM m WHERE scope = 'global'")
def phrase_weight(spark, d):
    p = profiles.profile_global(profiles.profile_rows(spark, d))
    return p.select("ngram", r6(R.phrase_weight(F.col("score"), F.col("ngram"))).alias("weight"))


@query("phrase_merge")
def phrase_merge(spark, d):
    top = PR.top_profile(profiles.profile(spark, d).withColumn("score", r6("score")))
    rows = R.clouds(top)
    return rows.select(*R.SCOPE, "phrase", r6("weight").alias("weight"))


@query("token_colour", B.with_(B.T, B.U, B.UT, B.K, B.P) + """SELECT dia_no, label, turn_no, idx, round(greatest(0, least(1, coalesce(CASE WHEN pred = 1 THEN CASE WHEN hi = 0 THEN NULL ELSE score / hi END ELSE CASE WHEN lo = 0 THEN NULL ELSE score / lo END END, 0))), 6) AS alpha
 FROM (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM k WINDOW w AS (PARTITION BY dia_no, label, turn_no)) JOIN p USING (dia_no, label, turn_no)""")
def token_colour(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy(*KEY)
    k = C.explained_tokens(spark, d).withColumn("hi", F.max("score").over(w)).withColumn("lo", F.min("score").over(w)).join(C.predictions(spark, d), KEY)
    return k.select(*KEY, "idx", r6(R.token_colour(F.col("score"), F.col("hi"), F.col("lo"), F.col("pred"))).alias("alpha"))


def _filled(pattern: str, **of: str) -> str:
    """The SQL that fills a report template."""
    import re

    parts = re.split(r"\$(\w+)", pattern)
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return " || ".join(f"coalesce(CAST({of[p]} AS VARCHAR), '')" if i % 2 else quoted(p) for i, p in enumerate(parts))


_TOKEN = dict(utterance="utterance", label="shown", percent="percent", number="number", sentence="sentence", token="token", place="place", before="before")
_ACT = dict(n="n_acts", percent="act_percent", number="act_number", label="shown", intent="intent", domain="domain", slot="slot")
REPORT_SQL = ORACLE["sentence_index"].replace("SELECT dia_no, label, turn_no, idx, CAST(coalesce", ", si AS (SELECT dia_no, label, turn_no, idx, CAST(coalesce") + ")," + ",".join((B.UT, B.K, B.P, B.TA, B.UA, B.AX)) + f""",
 kk AS (SELECT *, lag(token) OVER (PARTITION BY dia_no, label, turn_no ORDER BY idx) AS before, count(*) OVER w AS n, sum(CAST(CASE WHEN pred = 1 THEN score > 0 ELSE score <= 0 END AS INTEGER)) OVER w AS number
   FROM k JOIN p USING (dia_no, label, turn_no) WINDOW w AS (PARTITION BY dia_no, label, turn_no)),
 fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY CASE WHEN pred = 1 THEN -score ELSE score END, idx) AS r FROM kk) WHERE r = 1),
 sa AS (SELECT *, (length(value) % 5 - 2) / 10.0 AS score FROM ax JOIN (SELECT dia_no, label, turn_no, pred FROM p) USING (dia_no, label, turn_no)),
 ac AS (SELECT dia_no, label, turn_no, count(*) AS n_acts, sum(CAST(CASE WHEN pred = 1 THEN score > 0 ELSE score <= 0 END AS INTEGER)) AS act_number, arg_min({{'intent': intent, 'domain': domain, 'slot': slot}}, {{'s': CASE WHEN pred = 1 THEN -score ELSE score END, 'i': act_i}}) AS a FROM sa GROUP BY ALL),
 rp AS (SELECT dia_no, label, turn_no, u.text AS utterance, CASE WHEN pred = 1 THEN 'AI' ELSE 'human' END AS shown, number, round_even(CAST(100.0 * number / n AS DOUBLE), 2) AS percent, coalesce(sentence, 1) AS sentence, fk.token, before,
   CASE WHEN idx <= n // 3 THEN 'beginning' WHEN idx > 2 * (n // 3) THEN 'end' ELSE 'middle' END AS place, coalesce(n_acts, 0) AS n_acts, coalesce(act_number, 0) AS act_number, coalesce(round_even(CAST(100.0 * act_number / n_acts AS DOUBLE), 2), 0.0) AS act_percent, a.intent AS intent, a.domain AS domain, a.slot AS slot
   FROM fk JOIN u USING (dia_no, label, turn_no) LEFT JOIN si USING (dia_no, label, turn_no, idx) LEFT JOIN ac USING (dia_no, label, turn_no))
 SELECT dia_no, label, turn_no, CASE WHEN percent >= 50 AND before IS NOT NULL THEN {_filled(R.TOKEN_MOST, **_TOKEN)} WHEN before IS NULL THEN {_filled(R.TOKEN_FIRST, **_TOKEN)} ELSE {_filled(R.TOKEN_FEW, **_TOKEN)} END AS token_text,
  CASE WHEN n_acts = 0 THEN '{R.ACT_NONE}' WHEN act_percent >= 50 THEN {_filled(R.ACT_MOST, **_ACT)} ELSE {_filled(R.ACT_FEW, **_ACT)} END AS act_text FROM rp"""


def report_rows(spark, d):
    """What the report of every user turn says: the token that speaks most for the prediction, the sentence and the third that
    it stands in, what share of tokens and of acts is on the predicted side, and the act that speaks most for it."""
    from pyspark.sql import Window as W

    p, w = C.predictions(spark, d), W.partitionBy(*KEY)
    toward = lambda s: F.when(F.col("pred") == 1, -s).otherwise(s)
    like = lambda s: F.when(F.col("pred") == 1, (s > 0).cast("int")).otherwise((s <= 0).cast("int"))
    k = C.explained_tokens(spark, d).join(p, KEY).withColumn("before", F.lag("token").over(w.orderBy("idx"))).withColumn("n", F.count("*").over(w))
    k = k.withColumn("number", F.sum(like(F.col("score"))).over(w)).withColumn("percent", F.bround(100.0 * F.col("number") / F.col("n"), 2))
    first = k.withColumn("r", F.row_number().over(w.orderBy(toward(F.col("score")), "idx"))).where("r = 1")
    numbered = X.sentences(_spaced(spark, d), KEY).select(*KEY, "idx", "sentence")
    own = _scored_acts(spark, d).join(p.select(*KEY, "pred"), KEY)
    acts = own.groupBy(*KEY).agg(F.count("*").alias("n_acts"), F.sum(like(F.col("score"))).alias("act_number"), F.min_by(F.struct("intent", "domain", "slot"), F.struct(toward(F.col("score")), "act_i")).alias("a"))
    rows = first.join(C.user_turns(spark, d).select(*KEY, F.col("text").alias("utterance")), KEY).join(numbered, [*KEY, "idx"], "left").join(acts, KEY, "left")
    return rows.select(
        *KEY, "pred", "prob", "utterance", F.when(F.col("pred") == 1, "AI").otherwise("human").alias("shown"), "percent", "number", F.coalesce("sentence", F.lit(1)).alias("sentence"), "token", E.position_bucket(F.col("idx"), F.col("n")).alias("place"), "before",
        F.coalesce("n_acts", F.lit(0)).alias("n_acts"), F.coalesce(F.bround(F.try_divide(100.0 * F.col("act_number"), F.col("n_acts")), 2), F.lit(0.0)).alias("act_percent"), F.coalesce("act_number", F.lit(0)).alias("act_number"), "a.intent", "a.domain", "a.slot",
    )


@query("report_text", REPORT_SQL)
def report_text(spark, d):
    """Report texts of every user turn, each with its variants."""
    out = R.report_text(report_rows(spark, d).withColumn("truth", F.col("label")).withColumn("label", F.col("shown")))
    return out.select("dia_no", F.col("truth").alias("label"), "turn_no", "token_text", "act_text")


@query("report_html")
def report_html(spark, d):
    """One page for every dialogue: its probabilities, each turn's coloured tokens and texts, and the clouds of its last acts."""
    texts = R.report_text(report_rows(spark, d).withColumn("truth", F.col("label")).withColumn("label", F.col("shown"))).select("dia_no", F.col("truth").alias("label"), "turn_no", "pred", "prob", "token_text", "act_text")
    coloured = token_colour(spark, d).join(C.explained_tokens(spark, d).select(*KEY, "idx", "token"), [*KEY, "idx"])
    members = R.last_acts(profiles.turn_acts(spark, d))
    clouds = R.act_clouds(members, _class_profiles(spark, d)).withColumn("weight", r6("weight"))
    return R.report_pages(texts, coloured, clouds, members)


@query("session_batch", B.with_(B.T, B.U, B.UT, B.K, B.P) + """SELECT dia_no AS session_id, turn_no, round(prob, 6) AS turn_prob, round(1 / (1 + exp(-sum(kept) OVER w)), 6) AS dia_prob, CAST(count(*) OVER w AS INTEGER) AS n_turns FROM
 (SELECT dia_no, turn_no, any_value(prob) AS prob, coalesce(sum(score) FILTER (WHERE r <= 3), 0) AS kept FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY abs(score) DESC, idx) AS r FROM k) USING (dia_no, label, turn_no) GROUP BY ALL)
 WINDOW w AS (PARTITION BY dia_no ORDER BY turn_no)""")
def session_batch(spark, d):
    rows = session.detect_batch(C.user_turns(spark, d).select(F.col("dia_no").alias("session_id"), F.col("turn_no").alias("seq"), "text"))
    return rows.select("session_id", "turn_no", r6("turn_prob").alias("turn_prob"), r6("dia_prob").alias("dia_prob"), "n_turns")


@query("e2e_convo", "SELECT DISTINCT conv_id AS dia_no, 'find a room' AS goal, 'user: hello there' || chr(10) || 'system: hi' || chr(10) || 'user: thanks' AS dia, true AS is_complete FROM conversations")
def e2e_convo(spark, d):
    from ..operators.generation import e2e_dataset

    goals = _splits(spark, d).select("dia_no", F.array(F.lit("find a room")).alias("goals"), F.array(F.lit("booked")).alias("outcomes"))

    def make(dia_no: int):
        return S.ScriptedGenerator(["user: hello there", "user: thanks [END]"]), S.ScriptedGenerator(["system: hi"]), S.ScriptedGenerator(["<goal>1</goal>"] * 3)

    return e2e_dataset(goals, goals.limit(0).withColumn("is_complete", F.lit(True)), None, make)


AS_SQL = "sa AS (SELECT *, (length(value) % 5 - 2) / 10.0 AS score FROM ax)"


def _scored_acts(spark, d):
    return profiles.turn_acts(spark, d).withColumn("score", C.lexicon_weight(F.col("value")))


@query("top_act", B.with_(B.T, B.TA, B.U, B.UA, B.UT, B.K, B.P, B.AX, AS_SQL) + "SELECT dia_no, label, turn_no, act_i, intent, domain, slot FROM (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY CASE WHEN pred = 1 THEN -score ELSE score END, act_i) AS r FROM sa JOIN p USING (dia_no, label, turn_no)) WHERE r = 1")
def top_act(spark, d):
    from pyspark.sql import Window as W

    rows = _scored_acts(spark, d).join(C.predictions(spark, d), KEY)
    order = W.partitionBy(*KEY).orderBy(F.when(F.col("pred") == 1, -F.col("score")).otherwise(F.col("score")), "act_i")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select(*KEY, "act_i", "intent", "domain", "slot")


@query("top3_boxed", B.with_(B.T, B.U, B.UT, B.K, B.P) + "SELECT dia_no, label, turn_no, idx, token FROM (SELECT *, row_number() OVER (PARTITION BY dia_no, label, turn_no ORDER BY abs(score) DESC, idx) AS r FROM k JOIN p USING (dia_no, label, turn_no) WHERE CASE WHEN pred = 1 THEN score > 0 ELSE score < 0 END) WHERE r <= 3")
def top3_boxed(spark, d):
    from pyspark.sql import Window as W

    rows = C.explained_tokens(spark, d).join(C.predictions(spark, d), KEY).where(F.when(F.col("pred") == 1, F.col("score") > 0).otherwise(F.col("score") < 0))
    order = W.partitionBy(*KEY).orderBy(F.abs("score").desc(), "idx")
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 3").select(*KEY, "idx", "token")


@query("sentence_assign", ORACLE["sentence_index"].replace("SELECT dia_no, label, turn_no, idx, CAST(coalesce", ", si AS (SELECT dia_no, label, turn_no, idx, CAST(coalesce") + ")," + B.UT + "," + B.K + " SELECT dia_no, label, turn_no, idx, k.token, sentence FROM k JOIN si USING (dia_no, label, turn_no, idx)")
def sentence_assign(spark, d):
    numbered = X.sentences(_spaced(spark, d), KEY).select(*KEY, "idx", "sentence")
    return C.explained_tokens(spark, d).join(numbered, [*KEY, "idx"]).select(*KEY, "idx", "token", "sentence")


def _class_profiles(spark, d):
    return PR.top_profile(profiles.profile(spark, d).withColumn("score", r6("score")))


@query("aggregation_class")
def aggregation_class(spark, d):
    return R.last_turn_clouds(profiles.turn_acts(spark, d), _class_profiles(spark, d)).select("dia_no", "label", "side", "phrase", r6("weight").alias("weight"))


@query("global_cloud")
def global_cloud(spark, d):
    top = PR.top_profile(profiles.profile_global(profiles.profile_rows(spark, d)).withColumn("score", r6("score")))
    return R.clouds(top).select("side", "phrase", r6("weight").alias("weight"))


@query("nlu_prompt", B.with_(B.T, B.TA) + f"""SELECT 'Intents:' || chr(10) || '- inform: tells something' || chr(10) || '- request: asks for something' || chr(10) || 'Slots:' || chr(10) || '- price: price per night' || chr(10) || 'Answer with a JSON list of [intent, domain, slot, value] in <DA></DA> tags.' || chr(10)
  || string_agg('Context: ' || context || chr(10) || 'user: ' || text || chr(10) || '<DA>' || {ACTS_SQL.format('acts')} || '</DA>', chr(10) ORDER BY dia_no, pos) AS prompt FROM
  (SELECT * FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY dia_no, label ORDER BY pos), '') AS context FROM ta) WHERE role = 'user' ORDER BY md5('2025|' || dia_no || '|' || pos), dia_no, pos LIMIT 16)""")
def nlu_prompt(spark, d):
    """A prompt with 16 demonstrations, drawn from all lines of the speaker."""
    examples = D.sample_n_rows(AC.da_examples(C.turns(spark, d), "user"), ["dia_no", "pos"], 16)
    return AC.nlu_prompt(examples, [("inform", "tells something"), ("request", "asks for something")], [("price", "price per night")], "user")


@query("turn_templates", B.with_(B.T, B.U) + "SELECT dia_no, label, turn_no, 'Goal: ' || dia_no || '. The user said: ' || text AS prompt FROM u")
def turn_templates(spark, d):
    return C.user_turns(spark, d).select(*KEY, X.template("Goal: $goal. The user said: $said", goal=F.col("dia_no"), said=F.col("text")).alias("prompt"))


@query("sim_to_table", B.with_(EMB_SQL) + CSLS_SQL + " SELECT g, i, j, round_even(csls, 4) AS csls FROM cs")
def sim_to_table(spark, d):
    return M.sim_to_table(M.Blocks(*_sides(spark, d), ["g"]).csls()).select("g", "i", "j", "csls")


#: The hashed embedding of a text.
HE = "list_transform(range(0, 16), lambda q: CAST('0x' || substr(md5({0} || '|' || q), 1, 6) AS BIGINT) / 8388608.0 - 1)"
_FOUR = "array_to_string(list_transform(x[1:4], lambda v: CAST(CAST(round(1000000 * v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) AS BIGINT) AS VARCHAR)), ',')"


def _four(text):
    """The first four components of a text's unit vector, in millionths."""
    return F.array_join(F.transform(F.slice(M.unit(M.hashed_embedding(text)), 1, 4), lambda v: F.round(1000000 * v).cast("long").cast("string")), ",")


@query("word_embed", B.with_(B.T, B.U, B.UT, B.K) + f"SELECT token, {_FOUR} AS vec FROM (SELECT token, {HE.format('lower(token)')} AS x FROM (SELECT DISTINCT token FROM k))")
def word_embed(spark, d):
    """Hashed word vectors: the deterministic stand-in for an embedding model."""
    return C.explained_tokens(spark, d).select("token").distinct().select("token", _four(F.lower("token")).alias("vec"))


@query("da_embed", B.with_(B.T, B.TA, B.U, B.UA, B.AX) + f"SELECT text, {_FOUR} AS vec FROM (SELECT text, {HE.format('lower(text)')} AS x FROM (SELECT DISTINCT trim(regexp_replace(concat_ws(' ', intent, slot, value), ' +', ' ', 'g')) AS text FROM ax))")
def da_embed(spark, d):
    """Acts in words, and their vectors."""
    rows = profiles.turn_acts(spark, d).select(M.da_to_text(F.col("intent"), F.col("slot"), F.col("value")).alias("text")).distinct()
    return rows.select("text", _four(F.lower("text")).alias("vec"))


@query("binomial", "SELECT event_id, event_id % 12 AS n, event_id % 5 AS r, CAST(CASE WHEN event_id % 5 > event_id % 12 THEN 0 ELSE factorial(CAST(event_id % 12 AS INTEGER)) // (factorial(CAST(event_id % 5 AS INTEGER)) * factorial(CAST(event_id % 12 - event_id % 5 AS INTEGER))) END AS BIGINT) AS c FROM events")
def binomial(spark, d):
    from ..functions.attribution import binomial as choose

    @F.pandas_udf("long")
    def run(n: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([choose(int(a), int(b)) for a, b in zip(n, r)], dtype="int64")

    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 12).alias("n"), (F.col("event_id") % 5).alias("r"))
    return e.select("event_id", "n", "r", run("n", "r").alias("c"))


@query("flagship", B.with_(B.T, B.U, B.UT, B.NG) + """, c AS (SELECT 'global' AS scope, '' AS intent, '' AS domain, '' AS slot, ngram, sum(CAST(score > 0 AS INTEGER)) AS a_n, sum(CAST(score < 0 AS INTEGER)) AS b_n, 0.0 AS a_s, 0.0 AS b_s FROM ng WHERE score <> 0 GROUP BY ngram),""" + B.metric_sql("fwlor") + """
 SELECT side, CAST(rank AS INTEGER) AS rank, ngram, abs(s) AS score FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(s) DESC, ngram) AS rank FROM (SELECT *, round(score, 6) AS s, CASE WHEN score > 0 THEN 'ai' ELSE 'human' END AS side FROM m WHERE round(score, 6) <> 0)) WHERE rank <= 20""")
def flagship(spark, d):
    return profiles.flagship(spark, d)


from . import explained, matched, jobs  # noqa: E402, F401  these add their queries
