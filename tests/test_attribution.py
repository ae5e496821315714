import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.config import Config
from turnlens.functions import attribution as A
from turnlens.operators import attribution as AT
from turnlens.operators import scoring as S


def linear(w, b=0.3):
    return lambda x: x @ np.array(w) + b


def pairwise(x):
    return 1.5 * x[:, 0] - x[:, 1] + 2.0 * x[:, 0] * x[:, 2]


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_faith_shap_masks(d):
    m = A.masks_faith_shap(d, 60, A.instance_rng(1, d))
    assert (m.sum(axis=1) == 0).any() and (m.sum(axis=1) == d).any() and set(np.unique(m)) <= {0, 1}
    assert (m == A.masks_faith_shap(d, 60, A.instance_rng(1, d))).all()


def test_all_masks():
    assert len(np.unique(A.masks_all(4), axis=0)) == 16 and len(A.masks_banzhaf(3, 8, A.instance_rng(0))) == 8
    with pytest.raises(ValueError):
        A.masks("unheard", 2, 2, 1, A.instance_rng(0))


def test_regression_finds_a_linear_scorer():
    w = [0.4, -0.2, 0.0, 0.3, -0.5]
    x = A.masks_faith_shap(5, 200, A.instance_rng(3)).astype(float)
    found = A.solve_faith_shap(x, linear(w)(x), 1, alpha=0.001)
    assert [found[(i,)] for i in range(5)] == pytest.approx(w, abs=0.01)
    assert sum(found[(i,)] for i in range(5)) == pytest.approx(sum(w), abs=2e-3)
    for method in ("ridge", "ols"):
        assert [A.solve_faith_shap(x, linear(w)(x), 1, method, 1e-9)[(i,)] for i in range(5)] == pytest.approx(w, abs=1e-4)
    loss, r2 = A.infidelity_r2(x, linear(w)(x), found)
    assert loss < 1e-3 and r2 > 0.99


def test_lasso_meets_its_optimality_conditions():
    r = np.random.default_rng(1)
    for _ in range(15):
        x, y, alpha = r.normal(size=(40, 6)), r.normal(size=40), 0.05
        w = A.lasso(x, y, alpha)
        g = x.T @ (y - x @ w) / 40
        assert (np.abs(g) <= alpha + 1e-8).all() and np.allclose(g[w != 0], alpha * np.sign(w[w != 0]), atol=1e-8)


def test_interactions():
    x = A.masks_shapley_taylor(3, 60, 2, A.instance_rng(5)).astype(float)
    found = A.solve_shapley_taylor(x, pairwise(x), 2)
    assert found[(0,)] == pytest.approx(1.5) and found[(1,)] == pytest.approx(-1) and found[(0, 2)] == pytest.approx(2) and found[(0, 1)] == pytest.approx(0)
    assert sum(v for k, v in found.items() if k) == pytest.approx(pairwise(np.ones((1, 3)))[0])
    x = A.masks_shapley_interaction(3, 60, 2, A.instance_rng(5)).astype(float)
    found = A.solve_shapley_interaction(x, pairwise(x), 2)
    assert found[(0, 2)] == pytest.approx(2) and found.get((1, 2), 0) == pytest.approx(0)


@pytest.mark.parametrize("d,order", [(0, 2), (1, 2), (2, 2), (6, 2), (5, 3), (4, 1)])
def test_taylor_masks_are_blocks_of_subsets_on_what_precedes_them(d, order):
    rng, rows = A.instance_rng(8, d), [np.isin(np.arange(d), c).astype(np.int8) for k in range(order) for c in combinations(range(d), k)]
    lower = len(rows) - 1
    for _ in range(int((50 - lower) / (lower + A.binomial(d, order) or 1)) + 1):
        p = rng.permutation(d)
        for places in combinations(range(d), order):
            A._blocks(rows, d, [int(p[i]) for i in places], p[: places[0]])
    assert (A.masks_shapley_taylor(d, 50, order, A.instance_rng(8, d)) == np.array(rows)).all()


def test_long_turns_are_explained_in_array_passes():
    d, weight = 120, np.arange(120) % 5 / 10 - 0.2
    began = time.process_time()
    x = A.masks("shapley_taylor", d, 50, 2, A.instance_rng(1))
    found = A.explain("shapley_taylor", x, y := A.by_rows(lambda part: part @ weight, x), 2, 0.0)
    assert A.infidelity_r2(x, y, found)[1] == pytest.approx(1) and len(found) == 1 + 120 + 60 * 119
    assert [found[(i,)] for i in range(d)] == pytest.approx(list(weight)) and time.process_time() - began < 1.0


def test_gradients_of_a_quadratic_add_up():
    value, base = np.array([[1.0, 2.0], [3.0, -1.0]]), np.zeros((2, 2))
    got = A.integrated_gradients(value, base, lambda v: 2 * v, 50)
    assert got.sum() == pytest.approx((value**2).sum(), rel=1e-3)


def test_plans_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(1, 0, 0, "one three fiver".split()), (2, 1, 1, []), (3, 0, 0, ["only"])], "dia_no long, turn_no int, label int, tok array<string>")
    score = S.LexiconScorer()
    run = lambda d: {r["dia_no"]: (r["n_features"], r["explanation"]) for r in AT.attribute(d, score.logit, "faith_shap", 64).collect()}
    got = run(df)
    assert got == run(df.repartition(3)) and got[2] == (0, [])
    by = {e["features"][0]["text"]: e["score"] for e in got[1][1]}
    assert by["fiver"] == pytest.approx(-0.2, abs=0.01) and by["one"] == pytest.approx(0.1, abs=0.01)
    assert AT.perturb(df, "banzhaf_all").groupBy("dia_no").count().where("dia_no = 1").first()["count"] == 8
    rows = AT.masks_banzhaf_all(spark.createDataFrame([(1, 3), (2, 0)], "dia_no long, n_features int"))
    assert rows.count() == 8 and rows.select(F.array_join("mask", "")).distinct().count() == 8
    ig = AT.integrated_gradients(df, lambda ws: np.array([[len(w) % 5 - 2.0] for w in ws]) / 10, lambda v: np.ones_like(v), np.zeros(1)).collect()
    assert {e["features"][0]["text"]: round(e["score"], 6) for r in ig if r["dia_no"] == 1 for e in r["explanation"]} == {"one": 0.1, "three": -0.2, "fiver": -0.2}


def test_configuration():
    assert Config().key() == Config().key() != Config(utt_k=3).key()
    with pytest.raises(ValueError):
        Config(metric="unheard")
