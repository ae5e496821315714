import pytest
from pyspark.sql import functions as F

from turnlens.plans import registry
from turnlens.sources import conversations as C

KEY = ["dia_no", "label", "turn_no"]


@pytest.mark.parametrize("name", ["shapley_taylor", "shapley_interaction"])
def test_turns_are_explained_whole(spark, sf, name):
    out = registry.QUERIES[name](spark, sf).select(*KEY, "n_features").distinct()
    want = C.explanations(spark, sf).where("n_features > 1").select(*KEY, "n_features")
    assert want.where("n_features > 8").count() > 0 and want.exceptAll(out).count() == 0


def test_turns_are_perturbed_whole(spark, sf):
    out = registry.QUERIES["perturb_driver"](spark, sf).groupBy(*KEY).agg(F.max(F.size(F.split("masked", " "))).cast("int").alias("n_features"))
    want = C.explanations(spark, sf).where("n_features > 0").select(*KEY, "n_features")
    assert want.where("n_features > 8").count() > 0 and want.exceptAll(out).count() == 0
