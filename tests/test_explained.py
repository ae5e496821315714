import numpy as np
from pyspark.sql import functions as F

from turnlens import api
from turnlens.config import Config
from turnlens.operators import attribution as AT
from turnlens.operators import dialogue as D
from turnlens.operators import scoring as S
from turnlens.operators import selection as SE
from turnlens.plans import explained as X
from turnlens.sources import conversations as C
from turnlens.streaming import pipeline as P


def test_acts_and_dialogues_are_attributed_like_the_linear_scorer(spark, sf):
    turns = C.explanations(spark, sf).where("dia_no < 6")
    acts = AT.attribute_acts(turns, X.act_logit, "shapley_taylor", 1).select("dia_no", "turn_no", F.explode("explanation").alias("e")).collect()
    assert acts and all(abs(r["e"]["score"] - (len(r["e"]["features"][0]["text"].rsplit("|", 1)[1]) % 5 - 2) / 10) < 1e-9 for r in acts)
    whole = AT.attribute_dialogue(turns, X.dialogue_logit, "shapley_taylor", 1)
    given = turns.agg(F.sum("n_features"), F.sum(F.size("acts"))).first()
    assert whole.where("kind = 'token'").count() == given[0] and whole.where("kind = 'act'").count() == given[1]
    assert whole.where(F.abs(F.col("score") - C.lexicon_weight(F.element_at(F.split("text", r"\|"), -1))) > 1e-9).count() == 0


def test_gradients_by_act_leave_separators_between_acts_out(spark):
    rows = spark.createDataFrame([(1, 0, 0, [("greet", "general", "", ""), ("inform", "hotel", "price range", "very cheap")]), (2, 0, 0, [])], f"dia_no long, turn_no int, label int, acts {C.ACTS}")
    got = AT.gradients_by_act(rows, lambda ws: np.array([[float(len(w))] for w in ws]), np.ones_like, np.zeros(1), 4)
    sep = 3 * len("<slot_sep>")
    assert sorted((r["dia_no"], r["act_i"], r["score"]) for r in got.collect()) == [(1, 0, 12.0 + sep), (1, 1, 6.0 + 5 + 10 + 9 + sep)]


def test_selection_by_place_and_keys(spark):
    e = spark.createDataFrame([(1, [(-1, "bias", 1.0), (0, "bias", 2.0), (1, "x", 0.1)])], "k long, e array<struct<idx:int,text:string,score:double>>")
    assert [x["idx"] for x in e.select(SE.bias_filter(F.col("e"))).first()[0]] == [0, 1]
    assert SE.id_filter(e, e.select("k").unionByName(e.select("k"))).count() == 1 and SE.pred_class_filter(e.withColumn("pred", F.lit(1)), (0,)).count() == 0


def test_batches_hold_every_row_once(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = D.batches(df, ["k"], 7, parts=3)
    assert got.count() == 100 and got.groupBy("part", "batch").count().where("count > 7").count() == 0
    plain = D.batches(df, ["k"], 7, seed=None, parts=1).collect()
    assert all(r["batch"] == r["k"] // 7 for r in plain)


def test_repeated_scores_are_averaged_and_terms_are_shown(spark):
    rows = spark.createDataFrame([(1, 0, 0, ["a", "bb", "ccc"])], "dia_no long, turn_no int, label int, tok array<string>")
    got = AT.sampled(rows, lambda df: df.withColumn("y", F.col("try").cast("double")), "faith_shap", 6, times=3).collect()
    assert got and all(r["y"] == 2.0 for r in got)
    shown = AT.display(AT.attribute(rows, S.LexiconScorer().logit, "faith_shap", 50, valid=20), 2).collect()
    assert [r["rank"] for r in shown] == [1, 2] and " " in shown[0]["features"]


def test_the_pipeline_streams_like_its_batch_twin(spark, sf, tmp_path):
    rows = C.user_turns(spark, sf).where("dia_no < 5").select(F.col("dia_no").alias("session_id"), F.col("turn_no").cast("long").alias("seq"), "text")
    rows.withColumn("reset", F.lit(False)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, seq long, text string, reset boolean").parquet(str(tmp_path / "in"))
    q = P.run_stream(stream, idle_ms=None).writeStream.format("memory").queryName("online").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    pick = lambda df: sorted((r["session_id"], r["turn_no"], r["masked"], r["masked_acts"], *(round(r[c], 6) for c in ("utt_prob", "da_prob", "dia_prob"))) for r in df.collect())
    assert pick(spark.table("online")) == pick(P.run_batch(rows)) and rows.count() > 0


def test_training_in_stages(spark, sf, tmp_path):
    turns, dialogues = D.da_turn(C.turns(spark, sf)), C.dialogues(spark, sf)
    splits = dialogues.select("dia_no").distinct().withColumn("split", F.when(F.col("dia_no") % 3 > 0, "train").otherwise("test"))
    cfg = Config()
    got = api.train_all(turns, dialogues, splits, cfg, str(tmp_path))
    assert {(r["level"], r["split"]) for r in got.collect()} == {(a, b) for a in ("da", "utt", "dia") for b in ("train", "test")}
    assert set(api.load_models(spark, str(tmp_path), cfg)) == {"da", "utt", "dia"}
    rows = api.prepare(turns, splits, "utt")
    assert rows.where(F.size("input_ids") != 128).count() == 0
    fresh = api.refresh_train(rows, rows.limit(2).drop("split"))
    assert fresh.where("split = 'train'").count() == 2 and fresh.where("split <> 'train'").count() == rows.where("split <> 'train'").count()
