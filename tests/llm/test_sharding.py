import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from turnlens.llm import sharding as S

from .conftest import messy_rows


def bins(sizes):
    sizes = np.array(sizes, np.int64)
    return S.Bins(np.arange(len(sizes), dtype=np.int64), np.full(len(sizes), 63), sizes, sizes, np.ones(len(sizes), bool))


def best(sizes, k):
    """Smallest largest part by dynamic programming."""
    up = np.concatenate([[0], np.cumsum(sizes)])
    least = up.astype(float)
    for _ in range(k - 1):
        least = np.array([min(max(least[j], up[i] - up[j]) for j in range(i + 1)) for i in range(len(up))])
    return int(least[-1])


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_minimal_and_cuts_keep_it(seed):
    r = random.Random(seed)
    sizes, k = [r.choice([1, 5, 40, 300]) + r.randrange(9) for _ in range(r.randrange(1, 60))], r.randrange(1, 9)
    b = bins(sizes)
    low, high = S.bounds(b, k)
    assert low == high == best(sizes, k)
    ends = S.cuts(b, high, k)
    parts = np.diff([0, *ends])
    assert len(ends) == k and ends[-1] == len(sizes) and (parts >= 0).all()
    assert max(sum(sizes[a:e]) for a, e in zip([0, *ends], ends)) <= high


def test_bins_are_opened_until_the_capacity_is_exact(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_BITS", 4)
    r = random.Random(3)
    rows = [(r.randrange(1 << 63), r.choice([10, 50, 3000])) for _ in range(400)]
    capacity, firsts = S.boundaries(spark.createDataFrame(rows, "key long, size long"), 7)
    total = defaultdict(int)
    for k, s in rows:
        total[k] += s
    assert capacity == best([total[k] for k in sorted(total)], 7)
    assert len(firsts) == 6 and firsts == sorted(firsts)


def test_rows(messy, nothing):
    out = S.shard(messy, shards=5).toPandas()
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in messy_rows())
    assert sorted(map(tuple, out[["doc_id", "size", "text_crc32"]].to_numpy().tolist())) == [tuple(w) for w in want]
    assert (out["law"] == "bytes").all() and out["grown_shard"].isna().all()
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert out.groupby("text_crc32")["shard"].nunique().max() == 1
    assert out.groupby("shard")["size"].sum().max() <= out["capacity"].iloc[0]
    assert S.shard(nothing, shards=5).count() == 0


def test_a_large_group_stays_whole_and_the_rest_is_even(spark):
    docs = spark.createDataFrame([(i, "x" * 50 if i < 300 else f"text {i} " * 6) for i in range(900)], "doc_id long, text string")
    by = S.shard(docs, shards=10).toPandas().groupby("shard")["size"].sum().sort_values()
    assert len(by) == 10 and by.iloc[-1] == 300 * 66 and by.iloc[-2] < 1.3 * by.iloc[:-1].mean()
