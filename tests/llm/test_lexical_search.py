import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.llm import lexical_search as S

from .conftest import messy_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) of each item, by all pairs."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, length = len(held), sum(size for *_, size in held)
    df, out = Counter(t for _, c, _ in held for t in c), []
    for item, text in items:
        found = []
        for doc, c, size in held:
            m = 10 + 90 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, d[-1], -d[0]) for rank, d in enumerate(sorted(found, key=lambda d: d[:3])[:k], 1)]
    return out


def test_code_round_trip():
    for values in ([], [0], [127, 128, 0, 1 << 14, (1 << 62) + 5, 3], np.random.default_rng(1).integers(0, 1 << 40, 1000)):
        assert S.unpack(S.pack(np.array(values, np.int64))).tolist() == list(values)


def test_best_is_exact():
    for seed in range(400):
        r = random.Random(seed)
        lists = []
        for _ in range(r.randrange(1, 9)):
            places = sorted(r.sample(range(120), r.randrange(1, 100)))
            lists.append((places, [r.randrange(0, r.choice([2, 5, 1000])) for _ in places], r.randrange(1, r.choice([2, 50]) + 1)))
        score = Counter()
        for places, parts, w in lists:
            for p, x in zip(places, parts):
                score[p] += w * x
        want = sorted(((s, p) for p, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))
        assert S.best(lists, 10) == want[:10]


@pytest.mark.parametrize("only", [True, False])
def test_like_brute_force(spark, only):
    docs = [(r[0], r[1]) for r in messy_rows()] + [(None, prose(77, 30)), (None, prose(77, 30)), (500, "École 7 ÉCOLE école"), (501, "école"), (502, "...")] + [(600 + i, "same words here") for i in range(25)]
    items = [(i, prose(90 + i, 12)) for i in range(8)] + [(1, "ÉCOLE école"), (None, "idle quick"), (None, "stone river house"), (9, ""), (10, None), (11, "nowhere absent"), (12, "same WORDS here"), (12, "same words here")]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, n int, rid int, terms int").repartition(5)
    queries = spark.createDataFrame([(*q, 4) for q in items], "item_id long, text string, query int")
    wanted = queries.select(F.explode(S.terms(F.col("text"))).alias("term")).distinct() if only else None
    found = S.index(df, wanted, shard_docs=16)
    assert found.postings.select("shard").distinct().count() > 4
    out = S.search(found, queries, block_queries=5)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark, messy, nothing):
    some = spark.createDataFrame([(1, "the blue river")], "item_id long, text string")
    assert S.search(S.index(nothing), some).count() == 0
    assert S.search(S.index(messy), some.where("false")).count() == 0
    assert S.search(S.index(messy), some).count() == 10
