import hashlib
import re

import pytest

from turnlens.llm import decontamination as D

from .conftest import messy_rows, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    spans = {(i, tuple(w[k : k + window])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - window + 1)) if w}
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, content in spans:
            n = len(content)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == content:
                    hit.update(range(k, k + n))
                    ids.add(item)
        text = ",".join(sorted("" if x is None else str(x) for x in ids))
        yield i, len(w), len(hit), len(ids), hashlib.sha256(text.encode()).hexdigest(), bool(hit)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").toPandas().to_numpy().tolist()), key=str)


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "FILTER_BITS", bits)
    long = prose(2, 30_000).split()
    items = [(1, prose(50, 30)), (2, prose(51, 9)), (3, "Two  WORDS"), (4, "Ölweg"), (5, ""), (6, None), (7, "a a a a a a a a a a a a"), (1, prose(52, 12)), (10, prose(51, 9).upper()), (8, " ".join(long[20_000:20_015])), (None, prose(60, 11))]
    docs = [(i, t) for i, t, *_ in messy_rows()]
    docs += [(100, "start " + prose(50, 30)[5:] + " end"), (101, prose(50, 9)), (102, prose(51, 9) + "!" + prose(51, 9)), (103, "x two, words y"), (104, "ÖLWEG ölweg"), (105, "Ölweg ölweg"), (106, "a " * 25), (107, prose(52, 12)), (107, prose(52, 12)), (108, prose(60, 11) + " " + prose(50, 30))]
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, sid int")
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, rid int, pos int").repartition(3)
    assert rows(D.contaminated(df, bench)) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark, messy, nothing):
    bench = spark.createDataFrame([(1, prose(5, 30))], "item_id long, text string")
    assert D.contaminated(nothing, bench).count() == 0
    out = D.contaminated(messy, bench.where("false")).toPandas()
    assert len(out) == len(messy_rows()) and not out["contaminated"].any() and (out["items_sha256"] == hashlib.sha256(b"").hexdigest()).all()
