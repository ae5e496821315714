import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.llm import minhash_dedup as M
from turnlens.llm.common import Scratch
from turnlens.llm.components import components

from .conftest import messy_rows, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, percent, k):
    sets = {}
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    rows = [(i, shingle_set(t, k)) for i, t in docs]
    for i, a in rows:
        for j, b in rows:
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    del sets
    return sorted((i, len(s), root(i)) for i, s in rows)


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("percent,k,members", [(85, 3, 1024), (80, 5, 1024), (85, 3, 8)])
def test_against_brute_force(spark, monkeypatch, percent, k, members):
    monkeypatch.setattr(M, "BLOCK_MEMBERS", members)
    r = random.Random(7)
    docs = [(i, t) for i, t, *_ in messy_rows()]
    core = prose(90, 150)
    docs += [(200 + i, edited(core, r, r.randrange(12))) for i in range(60)] + [(300 + i, core) for i in range(25)]
    chain = prose(91, 200)
    for i in range(12):
        docs.append((400 + i, chain))
        chain = edited(chain, r, 2)
    docs += [(500 + i, f"w{i % 3} w{i % 2}") for i in range(6)]
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, bucket int, f1 int").repartition(3)
    out = M.near_duplicates(df, percent, k).toPandas()
    assert sorted(map(tuple, out[["doc_id", "n_shingles", "component_id"]].to_numpy().tolist())) == brute(docs, percent, k)
    assert (out["kept"] == (out["doc_id"] == out["component_id"])).all()


def test_empty_and_null_ids(spark, nothing):
    assert M.near_duplicates(nothing).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (None, "x y z")], "doc_id long, text string")
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in M.near_duplicates(df).collect()}
    assert out == {(None, 1, False), (1, 1, True), (None, None, True)}


def test_signatures_do_not_depend_on_blocks_and_estimate_similarity(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 2, 30, 700, 5000)]
    sets.append(np.concatenate([sets[5][:4000], np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))]))
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    whole = M.signatures(np.concatenate(sets), ends, 140)
    monkeypatch.setattr(M, "TOGETHER", 97)
    assert (whole == M.signatures(np.concatenate(sets), ends, 140)).all()
    assert np.isinf(whole[0]).all() and np.isfinite(whole[1:]).all()
    assert abs((whole[5] == whole[6]).mean() - 4000 / 6000) < 0.15


def test_banding_keeps_the_promised_recall():
    for percent in (40, 50, 70, 80, 85, 95, 100):
        count, rows = M.banding(percent)
        assert (1 - (percent / 100) ** rows) ** count <= M.MISS and count * rows <= M.MOST_SLOTS
    assert M.banding(85) == (28, 5) and M.banding(80) == (41, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    out = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long").repartition(3), "c").toPandas().set_index("node")["component"]
    assert (out.loc[0:40] == 0).all() and (out.loc[100:159] == 100).all() and (out.loc[[200, 250, 300]] == 200).all() and len(out) == 41 + 60 + 3
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "d").count() == 0


def test_buckets_with_the_same_members_go_on_once(spark, monkeypatch):
    text, kept, put = prose(92, 300), {}, Scratch.keep

    def keep(self, df, name):
        out = put(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    docs = [(1, text), (2, text + " end"), (3, prose(93, 300))]
    out = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")["component_id"]
    assert out.to_dict() == {1: 1, 2: 1, 3: 3} and kept["spots"] == 2
    assert "second-0" not in kept  # no block found a link, so the components stand


def test_only_texts_that_may_be_needed_pass(spark):
    texts = spark.range(-500, 1500).selectExpr("id as doc_id", "'t' as text").unionByName(spark.createDataFrame([(None, "t")], "doc_id long, text string"))
    wanted = {-500, -1, 0, 7, 32768 % 1500, 1499}
    got = [r["doc_id"] for r in M._passed(texts, spark.createDataFrame([(x,) for x in [*wanted, None]], "low long")).collect()]
    assert wanted <= set(got) and len(got) == len(set(got)) <= 2 * len(wanted)


def test_stars_need_no_round_to_confirm_them(spark, monkeypatch):
    kept, put = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or put(self, df, name))
    out = components(Scratch(spark, "test"), spark.createDataFrame([(1, 5), (9, 1), (2, 3)], "a long, b long"), "c").collect()
    assert sorted(map(tuple, out)) == [(1, 1), (2, 2), (3, 2), (5, 1), (9, 1)] and kept == ["c-0"]


def test_bits_follow_the_number_of_ids_and_lose_none(spark):
    texts = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    wanted = spark.range(0, 5_000, 50).select(F.col("id").alias("low"))
    passed = M._passed(texts, wanted)
    held = {r["doc_id"] for r in passed.select("doc_id").collect()}
    assert {r["low"] for r in wanted.collect()} <= held and len(held) < 500
    assert "32768" in passed._jdf.queryExecution().toString()  # 33,554,432 bits whatever the number
