import numpy as np
import pytest

from turnlens.llm import embedding_dedup as E


def brute(x, least=0.9):
    n = np.linalg.norm(x, axis=1)
    hit = (x @ x.T) / (n[:, None] * n[None, :]) >= least
    np.fill_diagonal(hit, False)
    return hit


def clustered(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 12), dim))
    return centres[r.integers(0, len(centres), n)] + spread * r.normal(size=(n, dim))


@pytest.mark.parametrize("dim,spread", [(2, 0.1), (8, 0.15), (64, 0.04), (64, 0.35)])
def test_traversal_counts_like_brute_force(dim, spread):
    side = lambda x, w: E.Side(x, E.levels(E.unit(x)), w)
    for seed in range(3):
        x, w = clustered(seed, 300, dim, spread), np.random.default_rng(seed).integers(1, 4, 300)
        hit, one = brute(x), side(x, w)
        a, b, root = E.traverse(one, one, True, 0.9)
        own = np.array([w[hit[i]].sum() for i in range(300)])
        # A full node also counts a vector's equals within it; equal vectors are one row here, so there are none.
        assert (a + b == own).all()
        assert all(root[i] == root[j] for i, j in zip(*np.nonzero(hit)))
        cut = 120
        a, b, root = E.traverse(side(x[:cut], w[:cut]), side(x[cut:], w[cut:]), False, 0.9)
        assert (a == [w[cut:][hit[i, cut:]].sum() for i in range(cut)]).all()
        assert (b == [w[:cut][hit[i, :cut]].sum() for i in range(cut, 300)]).all()


def rotated(by: float, dim: int, r) -> np.ndarray:
    """A unit vector at the chord ``by`` from the first axis."""
    side = np.concatenate([[0.0], r.normal(size=dim - 1)])
    cosine = 1 - by * by / 2
    return cosine * np.eye(dim)[0] + np.sqrt(1 - cosine * cosine) * side / np.linalg.norm(side)


def test_no_link_at_the_threshold_is_lost_to_a_small_covering_radius():
    """A leader, members that are almost equal to it, and vectors just within reach of a member but not of the leader."""
    limit = np.sqrt(0.2)
    for seed in range(100):
        r = np.random.default_rng(seed)
        far = rotated(limit + 3e-8, 8, r)
        towards = far - np.eye(8)[0]
        near = E.unit((np.eye(8)[0] + 6e-8 * towards / np.linalg.norm(towards))[None, :])[0]
        x = np.stack([np.eye(8)[0], near, far, *(-rotated(1.0, 8, r) for _ in range(5)), 3 * near])
        hit, one = brute(x), E.Side(x, E.levels(E.unit(x)), np.ones(len(x), np.int64))
        a, b, root = E.traverse(one, one, True, 0.9)
        assert (a + b == hit.sum(axis=1)).all() and hit[1, 2]


def test_nets_are_nested_and_cover():
    u = E.unit(clustered(1, 200, 6, 0.2))
    above = None
    for lead, radius in zip(E.levels(u), E.RADII):
        assert (np.linalg.norm(u - u[lead], axis=1) <= radius + 1e-6).all() and (lead[lead] == lead).all()
        if above is not None:
            assert set(above) <= set(lead) and (above[lead] == above).all()
        above = lead


def test_rows(spark):
    x = clustered(4, 160, 16, 0.1).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [float(v) for v in x[3]]) for i in range(30)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [None, *[1.0] * 15]), (504, [float("nan")] * 16), (505, [float("inf"), *[1.0] * 15]), (506, [1.0, 0.0]), (507, [1.0, 0.01]), (508, [-0.0, *[0.0] * 15])]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<float>, label int, id int").repartition(3)
    out = E.near_duplicates(df, sizes=E.Sizes(chunk=40)).toPandas().set_index("vec_id")
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 16]
    ids, hit = [i for i, _ in good], brute(np.array([v for _, v in good], np.float32).astype(float))
    up = {i: i for i, _ in rows}
    for _ in range(20):
        for k, i in enumerate(ids):
            up[i] = min([up[i], *(up[ids[j]] for j in np.flatnonzero(hit[k]))])
    up[507] = 506
    want = {i: int(hit[k].sum()) for k, i in enumerate(ids)} | {506: 1, 507: 1}
    assert len(out) == len(rows)
    for i, _ in rows:
        assert out.loc[i, "n_links"] == want.get(i, 0) and out.loc[i, "component_id"] == up[i] and out.loc[i, "kept"] == (up[i] == i), i
    assert E.near_duplicates(df.where("false")).count() == 0


def agree(spark, x, ids=None, sizes=E.Sizes()):
    """near_duplicates gives what all pairs give."""
    ids = list(range(len(x))) if ids is None else ids
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    hit = brute(x)
    up = np.array(ids)
    while True:
        # Rows of one vec_id are one node of the components.
        low = np.array([min([up[i], *up[hit[i]]]) for i in range(len(x))])
        low = np.array([low[np.array(ids) == i].min() for i in ids])
        if (low == up).all():
            break
        up = low
    want = sorted(zip(ids, hit.sum(axis=1).tolist(), up.tolist()))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(df, sizes=sizes).collect()) == want


def test_dealing_equal_directions_ends():
    """450,000 multiples of one vector: every level parts what met at the level above, whatever the fans have in common."""
    sizes, x = E.Sizes(), np.ones((1, 4)) / 2
    cells, level = [np.arange(450_000)], 0
    while cells:
        below = []
        for ids in cells:
            child = E.dealt(ids, level, len(E.centres_of(x, len(ids), sizes=sizes)))
            below += [part for part in (ids[child == c] for c in range(child.max() + 1)) if len(part) > sizes.chunk]
        assert max(map(len, below), default=0) <= max(map(len, cells)) / 2
        cells, level = below, level + 1
    assert level <= 3
    assert len(E.centres_of(E.unit(clustered(3, 200, 4, 0.3)), 5000, stuck=True, sizes=sizes)) == 10


DEEP = E.Sizes(sample=60, fan=8, chunk=30, group=2, placed=40, some=4)


def test_deep_trees_and_shared_ids(spark):
    # Half of the rows are multiples of one vector: no net parts them, and they link with their neighbours.
    base = clustered(6, 1, 6, 0.0)[0]
    x = np.vstack([base * np.linspace(1, 9, 90)[:, None], clustered(7, 80, 6, 0.1), base + 0.02 * np.random.default_rng(1).normal(size=(10, 6))])
    agree(spark, x[np.random.default_rng(2).permutation(180)], [i // 2 if i > 120 else i for i in range(180)], DEEP)
