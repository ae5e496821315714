import pytest
from pyspark.sql import functions as F

from turnlens import api
from turnlens.config import Config
from turnlens.operators import generation as G
from turnlens.operators import scoring as S
from turnlens.sources import conversations as C
from turnlens.sources.manifest import Manifest


def test_a_part_counts_once_it_is_committed(spark, tmp_path):
    store = Manifest(spark, f"file://{tmp_path}/m", "id long")
    assert store.read().count() == 0 and store.committed() == {}
    made = []

    def make(part):
        made.append(part)
        if part == "b" and made.count("b") == 1:
            raise RuntimeError("the job dies")
        return spark.range(3).withColumn("id", F.col("id") + 10 * ord(part))

    with pytest.raises(RuntimeError):
        store.run("abc", make)
    assert set(store.committed()) == {"a"} and store.read().count() == 3
    spark.range(5).write.parquet(f"file://{tmp_path}/m/data/b-lost")  # what a job wrote that died before its commit
    again = Manifest(spark, f"file://{tmp_path}/m", "id long")
    assert again.run("abc", make) == ["b", "c"] and made == ["a", "b", "b", "c"]
    assert again.read().count() == 9 and again.read(lambda p: p == "c").count() == 3
    assert not again.commit("a", spark.range(100)) and again.read().count() == 9  # another run was first
    assert "b-lost" in again.vacuum() and again.read().count() == 9


def test_explanations_go_on_where_a_job_stopped(spark, sf, tmp_path, monkeypatch):
    turns = C.explanations(spark, sf).where("dia_no < 12")
    splits = turns.select("dia_no").distinct().withColumn("split", F.when(F.col("dia_no") % 3 > 0, "train").otherwise("test"))
    cfg, where = Config(utt_explanation="stii", utt_k=3, perturbations=40), f"file://{tmp_path}/e"
    n = turns.count()
    real, calls = api.attributions, []

    def dies(rows, *args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the job dies")
        return real(rows, *args)

    monkeypatch.setattr(api, "attributions", dies)
    with pytest.raises(RuntimeError):
        api.explain_splits(turns, splits, cfg, S.LogitScorer(), where, part_turns=max(1, n // 6))
    out = api.explain_splits(turns, splits, cfg, S.LogitScorer(), where, part_turns=max(1, n // 6))
    store = Manifest(spark, f"{where}/attributions-{cfg.key(api.DEPENDS)}", api.ATTRIBUTED)
    assert len(store.committed()) == len(calls) - 1 >= 6
    pick = lambda df: sorted(map(tuple, df.select("dia_no", "label", "turn_no", "masked_sample").collect()))
    assert pick(out) == pick(api.explain(turns, cfg, S.LogitScorer())) and out.select("split").distinct().count() == 2
    before = len(calls)
    other = api.explain_splits(turns, splits, cfg.but(utt_k=1), S.LogitScorer(), where, part_turns=max(1, n // 6))
    assert len(calls) == before and pick(other) == pick(api.explain(turns, cfg.but(utt_k=1), S.LogitScorer()))


def test_generation_commits_groups_and_repeats_what_is_incomplete(spark, tmp_path):
    goals = spark.createDataFrame([(i, [f"goal {i}"], ["done"]) for i in range(20)], "dia_no long, goals array<string>, outcomes array<string>")
    where = f"file://{tmp_path}/g"

    def make(fails):
        def of(dia_no):
            if dia_no in fails:
                raise RuntimeError("no answer")
            user = ["user: hello there", "user: thanks [END]"] if dia_no % 4 else ["user: hello there"]
            return S.ScriptedGenerator(user * 9), S.ScriptedGenerator(["system: hi"] * 9), S.ScriptedGenerator(["<goal>1</goal>"] * 9)

        return of

    with pytest.raises(Exception, match="no answer"):
        G.generate(goals, where, make({13}), group=5, max_turns=2, again=1)
    store = Manifest(spark, where, G.DIALOGUES)
    first = store.committed()
    out = G.generate(goals, where, make(set()), group=5, max_turns=2, again=1)
    assert set(first.items()) <= set(store.committed().items()) and 0 < len(store.committed()) <= 6
    assert out.count() == 20 and sorted(r["dia_no"] for r in out.where("not is_complete").collect()) == [0, 4, 8, 12, 16]
    again = G.generate(goals, where, lambda i: (S.ScriptedGenerator(["user: hello there", "user: bye [END]"]), S.ScriptedGenerator(["system: hi"]), S.ScriptedGenerator(["<goal>1</goal>"])), requested=2, group=5)
    assert again.count() == 20 and sorted(r["dia_no"] for r in again.where("not is_complete").collect()) == [8, 12, 16]
