import json

import pytest
from pyspark.sql import functions as F

from turnlens import cli
from turnlens.operators import attribution as AT
from turnlens.operators import dialogue as D
from turnlens.sources import conversations as C
from turnlens.sources import files


@pytest.fixture(scope="module")
def data(spark, sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id < 8").coalesce(1).write.parquet(f"file://{path}/conversations.parquet")
    return f"file://{path}"


def test_verbs_write_their_tables(spark, data, tmp_path):
    out = f"file://{tmp_path}"
    cli.main(["detect", "--data", data, "--out", f"{out}/d", "--utt-k", "3", "--perturbations", "30", "--utt-explanation", "stii", "--ordering", "prediction"], spark)
    assert spark.read.parquet(f"{out}/d/detected").where("prob between 0 and 1").count() == C.user_turns(spark, data).count()
    assert spark.read.json(f"{out}/d/metrics").count() > 0
    cli.main(["profile", "--data", data, "--out", f"{out}/p", "--perturbations", "30", "--metric", "agg_s"], spark)
    assert spark.read.parquet(f"{out}/p/profile").select("scope").distinct().count() == 2
    cli.main(["aopc", "--data", data, "--out", f"{out}/a", "--aopc-depth", "3", "--methods", "local", "random"], spark)
    assert {(r["method"], r["step"]) for r in spark.read.json(f"{out}/a/aopc").collect()} == {(m, s) for m in ("local", "random") for s in range(3)}


def test_explanations_from_stored_perturbations(spark, data, tmp_path):
    out = f"file://{tmp_path}"
    cli.main(["perturb", "--data", data, "--out", out, "--instances", "6", "--most", "40", "--perturbations", "60", "--valid", "9", "--times", "2", "--method", "shapley_taylor", "--scorer", "turnlens.operators.scoring:LogitScorer"], spark)
    rows = spark.read.parquet(f"{out}/instances")
    assert rows.count() == 6 and rows.where("size(tok) > 40").count() == 0
    assert spark.read.parquet(f"{out}/valid").select(*AT.KEY).distinct().count() == 6
    cli.main(["explain", "--data", data, "--out", out, "--perturbed", out, "--method", "shapley_taylor"], spark)
    e = spark.read.parquet(f"{out}/explained").select(F.explode("explanation").alias("e"), "n_features")
    assert e.where(F.abs(F.col("e.score") - C.lexicon_weight(F.get("e.features", F.lit(0))["text"])) > 1e-9).count() == 0
    assert spark.read.parquet(f"{out}/explained").where("n_features <> size(explanation)").count() == 0


def test_flags_are_the_settings():
    args = cli.parser().parse_args(["detect", "--data", "a", "--out", "b", "--no-use-da-turn", "--fusion", "max"])
    assert args.use_da_turn is False and args.fusion == "max" and args.perturbations == 200
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["detect", "--data", "a", "--out", "b", "--fusion", "sum"])


def test_combined_samples_and_slot_descriptions(spark, tmp_path):
    act = ("inform", "hotel", "", "cheap")
    rows = spark.createDataFrame([(1, [[act, ("request", "", "area", "")], [("none", "", "", "")], [act]], ["hello", "bye now"])], f"k int, masked_da array<{C.ACTS}>, masked_utt array<string>")
    got = D.da_utt(rows).first()
    assert got["input_sequence"] == "<cls> <usr> inform hotel <da_sep> request area <sys> none <usr> inform hotel <sep> <usr> hello <usr> bye now"
    assert [tuple(a) for a in got["sample"][-1]] == [("hello\nbye now", "", "", "")] and len(got["sample"]) == 4
    assert D.da_utt(rows, use_turn=False, use_value=True, use_utt=False).first()["input_sequence"] == "<cls> <usr> inform hotel cheap <da_sep> request area <usr> none <usr> inform hotel cheap"
    (tmp_path / "s.json").write_text(json.dumps({"slots": {"price": "price per night", "area": None}, "other": {"x": 1}}))
    assert [tuple(r) for r in files.read_slot_descriptions(spark, str(tmp_path / "s.json")).collect()] == [("price", "price per night")]
