import json
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from turnlens import api
from turnlens.config import Config
from turnlens.operators import dialogue, generation
from turnlens.operators import scoring as S
from turnlens.plans import registry
from turnlens.sources import conversations as C
from turnlens.sources import files
from turnlens.streaming import session

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    text = lambda x: "" if x is None or x is pd.NA or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_agree_with_sql(spark, sf, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_other_queries_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_front(spark, sf):
    turns = dialogue.da_turn(C.turns(spark, sf)).withColumn("tok", C.tokens(F.col("text"))).where("dia_no < 6")
    cfg, scorer = Config(utt_k=3, perturbations=40, max_ngram=2, aopc_depth=4), S.LexiconScorer()
    out = api.explain(turns, cfg, scorer)
    assert out.where("size(important_features) > 3").count() == 0 and out.count() == turns.count()
    assert api.explain(turns, cfg.but(utt_explanation="none"), scorer).count() == turns.count()
    assert api.explain(turns, cfg.but(ordering="prediction", interaction_order=1), scorer).count() == turns.count()
    found = api.detect(turns, cfg, scorer)
    assert found.count() == turns.count() and api.metrics(found).where("turn_no = -1").count() > 0
    scored = turns.withColumn("scores", F.transform("tok", C.lexicon_weight))
    assert api.profile(scored, cfg).where("scope = 'global'").count() > 0
    orders = turns.select("dia_no", "label", "turn_no", F.lit("local").alias("method"), F.transform("tok", lambda t: F.lower(t)).alias("order"))
    curve = api.aopc(turns, orders, cfg, scorer)
    assert curve.where("step = 0 and aopc <> 0").count() == 0 and curve.count() == 4 * turns.count()


def test_sessions_stream_like_the_batch_twin(spark, sf, tmp_path):
    rows = C.user_turns(spark, sf).where("dia_no < 8").select(F.col("dia_no").alias("session_id"), F.col("turn_no").cast("long").alias("seq"), "text")
    for i in (0, 1):
        rows.where(F.col("seq") >= 2 if i else F.col("seq") < 2).withColumn("reset", F.lit(False)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, seq long, text string, reset boolean").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = api.session(stream, Config(utt_k=3), S.LexiconScorer(), idle_ms=None).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    deadline = time.time() + 90
    while time.time() < deadline and spark.table("sessions").count() < rows.count():
        assert q.exception() is None
        time.sleep(1)
    q.stop()
    pick = lambda df: sorted((r["session_id"], r["turn_no"], round(r["turn_prob"], 6), round(r["dia_prob"], 6), r["n_turns"], r["masked"]) for r in df.collect())
    assert pick(spark.table("sessions")) == pick(session.detect_batch(rows, 3))


def test_generation():
    say = S.ScriptedGenerator
    talk = lambda u, s, o, n=15: generation.converse(say(u), say(s), say(o), ["g1", "g2"], ["o1", "o2"], n, 2)
    assert talk(["user: hi", "user: bye *END*"], ["system: yes"], ["<goal>1</goal>"]) == ("user: hi\nsystem: yes\nuser: bye", True)
    assert talk(["bad", None, "user: x"], [], []) == ("", False)
    assert talk(["bad", "user: x"], ["system: y"], ["<goal>?</goal>", "none"]) == ("user: x", False)
    assert talk(["user: [END]"], [], []) == ("", False)
    assert talk(["user: a"] * 3, ["system: b"] * 3, ["<goal>2</goal>"] * 3, 2)[1] is False


def test_files(spark, tmp_path):
    onto = {"domains": {"travel": {"slots": {"seat": {"description": "class", "is_categorical": True, "possible_values": ["business", "dontcare"]}, "price": {"description": "cost", "is_categorical": False, "possible_values": []}}}}, "intents": {"inform": {"description": "tells"}}}
    (tmp_path / "o.json").write_text(json.dumps(onto))
    o = files.read_ontology(spark, str(tmp_path / "o.json"))
    assert {r["slot"] for r in files.dim_slot(o, "travel").collect()} == {"seat", "price"} and files.dim_intent(o).first()["intent"] == "inform"
    assert json.loads(files.ontology_slots(files.dim_slot(o)).first()["slots"])["seat"] == '["business"]'
    assert json.loads(files.ontology_slots(files.dim_slot(o), "[v]").first()["slots"])["price"] == "[v]"
    with pytest.raises(ValueError):
        files.dim_slot(o, "space")
    for c, t in (("pos", "good<br />one  "), ("neg", "bad")):
        (tmp_path / "imdb" / c).mkdir(parents=True)
        (tmp_path / "imdb" / c / "1.txt").write_text(t)
    assert sorted(map(tuple, files.load_text_folder(spark, str(tmp_path / "imdb")).collect())) == [("bad", 0), ("good one", 1)]
    for n in (2, 10):
        (tmp_path / "run" / f"checkpoint-{n}").mkdir(parents=True)
        (tmp_path / "run" / f"checkpoint-{n}" / "optimizer.pt").write_text("x")
    assert files.latest_checkpoint(spark, str(tmp_path / "run")).endswith("checkpoint-10") and files.latest_checkpoint(spark, str(tmp_path / "none")) is None
    assert len(files.prune_checkpoints(spark, str(tmp_path / "run"))) == 2
    store, made = files.Artefacts(spark, str(tmp_path / "art")), []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert [store.get("x", Config().key(), make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    assert store.get("x", Config(utt_k=1).key(), make).count() == 3 and len(made) == 2
    store.clear()
    files.write_text(spark, "<p>ä</p>", str(tmp_path / "r.html"))
    assert (tmp_path / "r.html").read_text() == "<p>ä</p>"
    files.write_csv(spark.createDataFrame([(1, 'a "b"\nc')], "i int, t string"), str(tmp_path / "c"))
    assert files.read_goals(spark, str(tmp_path / "c")).first()["t"] == 'a "b"\nc'
    files.append_rows(spark.range(2), str(tmp_path / "g"))
    files.append_rows(spark.range(2), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4
    files.write_json(spark.range(1), str(tmp_path / "j"))


def test_models(spark, tmp_path):
    df = spark.createDataFrame([("good fine", 0.0), ("bad worse", 1.0)] * 20, "input_sequence string, label double")
    model = S.train_detector(df, "input_sequence")
    model.write().overwrite().save(str(tmp_path / "m"))
    again = S.PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).where("prediction <> label").count() == 0
    tie = spark.createDataFrame([([1.0, 1.0],), ([0.0, 800.0],)], "pred_logit array<double>")
    assert [r["pred_label"] for r in S.predict_rows(tie).collect()] == [0, 1]
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(S.fuse(F.col("a"), F.col("b"), "max")).collect()
    assert spark.createDataFrame([([1.0], [2.0, 3.0])], "a array<double>, b array<double>").select(S.fuse(F.col("a"), F.col("b"), "concat")).first()[0] == [1.0, 2.0, 3.0]
    tries = iter([None, 3])
    assert S.repeat_until(lambda: next(tries), lambda x: x is not None, 5) == 3
    assert S.repeat_until(lambda: 1, lambda x: False, 2, default=9) == 9 and S.repeat_until(lambda: 1, lambda x: False, 2, latest=True) == 1
