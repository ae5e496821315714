import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.llm import mixing as M

from .conftest import messy_rows


def test_targets_stop_at_twice_the_source_and_share_the_rest():
    goal = [float(x) for x in M.targets([10, 100, 100, 90])]
    assert goal[0] == 20 and abs(sum(goal) - 450) < 1e-9
    assert all(g <= 2 * n + 1e-9 for g, n in zip(goal, [10, 100, 100, 90]))
    assert M.targets([]) == [] and [float(x) for x in M.targets([0, 4])] == [0, 6]


def test_the_tree_is_exact():
    quotas = np.array([40, 3, 0, 17])
    out = M.split_tree(quotas, 7, seed=5)
    assert (out.sum(axis=1) == quotas).all() and np.ptp(out.sum(axis=0)) <= 1 and (out >= 0).all()
    assert (out == M.split_tree(quotas, 7, seed=5)).all()


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_rows(messy, nothing):
    out = M.mix(messy, shards=4).toPandas()
    assert sorted(zip(out["doc_id"], out["size"])) == sorted((i, size(t)) for i, t, *_ in messy_rows())
    assert (out["taken"] <= 2 * out["size"]).all()
    names = sorted({s for *_, s in messy_rows()}, key=lambda s: (s is None, s or ""))
    held = [sum(size(t) for _, t, _, s in messy_rows() if s == n) for n in names]
    for n, h, goal in zip(names, held, M.targets(held)):
        own = out[out["source"].isna() if n is None else out["source"] == n]
        assert (own["source_size"] == h).all() and abs(own["target"].iloc[0] - float(goal)) < 1e-6
        assert abs(own["taken"].sum() - float(goal)) <= 1
    draws = [d for ds in out["draws"] for d in ds]
    assert {d["shard"] for d in draws} <= set(range(4)) and sum(d["words"] for d in draws) == out["taken"].sum()
    assert M.mix(nothing).count() == 0


def test_reruns_agree_on_other_partitions_and_rows_are_carried(messy):
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "taken").toPandas().to_numpy().tolist()))
    assert pick(M.mix(messy)) == pick(M.mix(messy.repartition(7)))
    whole = M.mix(messy, whole=True, carry=True)
    assert whole.select("row.*").columns == messy.columns
    assert all(t % n == 0 for t, n in whole.select("taken", "size").where("size > 0").toPandas().to_numpy().tolist())
    assert M.shuffled(M.mix(messy)).count() == sum(len(x["draws"]) for x in M.mix(messy).select("draws").collect())


def test_edges_are_refined(messy, monkeypatch):
    monkeypatch.setattr(M, "MOST_BITS", 2)
    want = M.mix(messy).toPandas().groupby("source", dropna=False)["taken"].sum()
    monkeypatch.setattr(M, "EDGE_ROWS", 1)
    assert (M.mix(messy).toPandas().groupby("source", dropna=False)["taken"].sum() == want).all()


def taken_of(out):
    return sorted((str(i), n, t) for (i, n), t in out.groupby(["doc_id", "size"], dropna=False)["taken"].sum().items())


def test_rows_that_are_equal_are_numbered_at_the_edge(spark):
    """Forty equal rows of a source, and sixty rows over three ids: what is taken meets the targets to the word."""
    for rows in ([(5, "w " * 300, "a")] * 40 + [(i, "x y z", "b") for i in range(30)], [(i % 3, "w " * 250, "a") for i in range(60)] + [(9, "x", "b")] * 50, [(None, "p q r s t", "a")] * 33 + [(1, "u", None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = M.mix(docs).toPandas()
        assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all()
        for _, own in out.groupby("source", dropna=False):
            assert own["taken"].sum() == round(own["target"].iloc[0])
        assert taken_of(out) == taken_of(M.mix(docs.repartition(5)).toPandas())


def test_sources_in_any_number(spark, monkeypatch):
    monkeypatch.setattr(M, "TOGETHER", 16)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 10)
    rows = [(i, "w " * (1 + i * i % 23), f"s{i % 50:02d}") for i in range(400)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).toPandas()
    held = out.groupby("source")["size"].sum()
    for goal, (_, own) in zip(M.targets(held.tolist()), out.groupby("source")):
        assert abs(own["target"].iloc[0] - float(goal)) < 1e-6 and own["taken"].sum() == round(goal)


@pytest.mark.parametrize("bits", [2, 16])
def test_what_each_document_gives_like_brute_force(spark, monkeypatch, bits):
    """Whole passes over a source, then its rows in the order of their hash until the target's words are met."""
    monkeypatch.setattr(M, "MOST_BITS", bits)
    rows = [(i, "w " * (1 + i * i % 37), "abc"[i % 3] if i % 7 else None) for i in range(600)] + [(700, "", "a"), (701, None, "b"), (702, "x", "empty"), (703, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(17), docs["doc_id"], F.xxhash64(docs["text"])), 1)
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", h.alias("h")).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    want = {}
    for name, goal in zip(names, M.targets([sum(size[i] for i, _, s in rows if s == n) for n in names])):
        own, held = sorted((i for i, _, s in rows if s == name), key=lambda i: (order[i], size[i])), sum(size[i] for i, _, s in rows if s == name)
        passes, need = divmod(round(goal), held) if held else (0, 0)
        for i in own:
            part = min(size[i], need)
            need -= part
            want[i] = passes * size[i] + part
    assert {r["doc_id"]: r["taken"] for r in M.mix(docs).select("doc_id", "taken").collect()} == want
