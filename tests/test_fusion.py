import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.config import FUSIONS
from turnlens.operators import fusion as FU

EVERY = {f: FU.Settings(f, buckets=64, dims=4) for f in FUSIONS} | {"shared": FU.Settings("concat", True, 64, 4), "shared_max": FU.Settings("max", True, 64, 4)}


def data(n=40, seed=1):
    r = np.random.default_rng(seed)
    ids = lambda: [r.integers(0, 64, r.integers(0, 6)).tolist() for _ in range(n)]
    return ids(), ids(), r.integers(0, 2, n).astype(float)


def model(settings, seed=3):
    """Towers that differ, so that the larger of two features is never a tie."""
    r, m = np.random.default_rng(seed), FU.TwoTowers.drawn(settings)
    m.vectors, m.bias = r.normal(size=m.vectors.shape), 0.3
    return m


@pytest.mark.parametrize("name", sorted(EVERY))
def test_gradient_is_the_slope_of_the_loss(name):
    a, b, y = data()
    m = model(EVERY[name])
    found, loss = m.gradient(a, b, y)
    z = m.logits(a, b)
    assert abs(loss - np.logaddexp(0, np.where(y > 0, -z, z)).sum()) < 1e-9
    r = np.random.default_rng(5)
    for _ in range(40):
        kind = r.choice(sorted(found))
        x = m.head if kind == FU.HEAD else m.vectors[kind] if kind < FU.HEAD else None
        h = 1e-6
        if x is None:
            at, old = (0, 0), m.bias
            ends = []
            for s in (h, -h):
                m.bias = old + s
                ends.append(m.gradient(a, b, y)[1])
            m.bias = old
        else:
            at = tuple(int(r.integers(k)) for k in x.shape)
            old, ends = x[at], []
            for s in (h, -h):
                x[at] = old + s
                ends.append(m.gradient(a, b, y)[1])
            x[at] = old
        assert abs((ends[0] - ends[1]) / (2 * h) - found[kind][at]) < 1e-4


def test_one_tower_for_equal_inputs_is_two_equal_towers():
    a, _, y = data()
    one, two = model(FU.Settings("concat", True, 64, 4)), model(FU.Settings("concat", False, 64, 4))
    two.vectors, two.head = np.repeat(one.vectors, 2, axis=0), one.head
    assert np.allclose(one.logits(a, a), two.logits(a, a))
    (g, loss), (h, loss2) = one.gradient(a, a, y), two.gradient(a, a, y)
    assert abs(loss - loss2) < 1e-9 and np.allclose(g[FU.FIRST], h[FU.FIRST] + h[FU.SECOND]) and np.allclose(g[FU.HEAD], h[FU.HEAD])


def test_a_step_over_partitions_is_the_full_batch_gradient(spark):
    a, b, y = data()
    split = ["train" if i % 4 else "val" for i in range(40)]
    models = {n: model(s) for n, s in EVERY.items()}
    rows = spark.createDataFrame([*zip(a, b, y.tolist(), split)], "first array<int>, second array<int>, label double, split string").repartition(5)
    found = FU.summed_gradients(rows, models)
    train = [i for i in range(40) if i % 4]
    for name, m in models.items():
        want, loss = m.gradient([a[i] for i in train], [b[i] for i in train], y[train])
        own = found[found["model"] == name]
        for kind, g in want.items():
            got = np.zeros(g.shape)
            part = own[own["kind"] == kind]
            got[part["row"].to_numpy()] = np.stack(part["g"].to_numpy())[:, : g.shape[1]]
            assert np.allclose(got, g)
        losses = own[own["kind"] == FU.LOSSES]["g"].iloc[0]
        assert abs(losses[0] - loss) < 1e-9 and losses[1] == 30 and losses[3] == 10


def test_training_stops_by_validation_and_models_come_back(spark, tmp_path):
    rows = [(i, f"inform|x {'price' if i % 2 else 'name'}", f"w{i % 7} {'yes' if i % 3 else 'no'}", float((i % 2) ^ (i % 3 > 0)) if i % 5 else None, ("train", "val", "test")[0 if i % 10 < 7 else 1 if i % 10 == 7 else 2]) for i in range(200)]
    rows += [(1000, None, "", 1.0, "train"), (1001, "", None, 0.0, "test")]
    df = spark.createDataFrame(rows, "id int, da string, utt string, label double, split string").withColumn("prob", F.lit("clash"))
    found = FU.train(df, EVERY | {"concat": FU.Settings("concat", buckets=64, dims=4, seed=7)}, steps=25, rate=0.2)
    for m in found.values():
        out = FU.predict(df.drop("prob"), m)
        assert out.count() == 202 and out.where("prob is null or prob < 0 or prob > 1").count() == 0
    linear = FU.train(df.withColumn("label", (F.col("id") % 2).cast("double")), {"average": EVERY["average"]}, steps=25, rate=0.2)["average"]
    assert FU.predict(df.drop("prob"), linear).where("split = 'test' and id < 1000 and prediction <> id % 2").count() == 0
    FU.save(spark, linear, str(tmp_path / "m"))
    again = FU.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.vectors, linear.vectors) and again.settings == linear.settings and again.bias == linear.bias
    drawn = FU.train(df.where("false"), {"max": EVERY["max"]})["max"]
    assert np.array_equal(drawn.vectors, FU.TwoTowers.drawn(EVERY["max"]).vectors)
    with pytest.raises(ValueError):
        FU.Settings("sum")
