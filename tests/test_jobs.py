import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.operators import cloud
from turnlens.operators import collate as CO
from turnlens.operators import embedder as EM
from turnlens.operators import fusion as FU
from turnlens.operators import matching as M
from turnlens.operators import nlu
from turnlens.operators import tokenizer as TK
from turnlens.plans import jobs


@pytest.mark.parametrize("left", [False, True])
def test_batches_are_padded_to_their_longest(spark, left):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(1, 99, r.integers(0, 60)).tolist(), r.integers(1, 99, 3).tolist() if i % 9 else None) for i in range(203)] + [(7, [5], [6])]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>").repartition(6)
    out = CO.collate(df, ["a", "b"], ["k"], 10, left=left).toPandas()
    assert len(out) == 204 and sorted(out.groupby("batch").size()) == [4] + [10] * 20 and out["turn"].nunique() == 21
    ids = lambda xs, m: [x for x, keep in zip(xs, m) if keep]
    given = sorted(map(str, [(k, a, b or []) for k, a, b in rows]))
    assert given == sorted(str((int(k), [int(x) for x in ids(a, am)], [int(x) for x in ids(b, bm)])) for k, a, am, b, bm in zip(out["k"], out["a"], out["a_mask"], out["b"], out["b_mask"]))
    for _, own in out.groupby("batch"):
        held = [int(sum(m)) for m in own["a_mask"]]
        assert {len(a) for a in own["a"]} == {max(held)} and max(held) // CO.STEP - min(held) // CO.STEP <= 3
        assert all(list(m) == sorted(m, reverse=not left) for m in own["a_mask"])
    assert CO.collate(df.where("false"), ["a"], ["k"], 10).count() == 0


def test_subwords_have_marks_of_their_own(spark):
    tok = TK.new_tokenizer(spark, jobs.VOCABULARY)
    texts = ["<cls> Hello there, é 😀 <sep>", "<usr><sys>", "", None, "a<da_sep>b", "no marks <|endoftext|> here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r["i"]: r["ids"] for r in rows.select("i", TK.subword_ids(tok, F.col("text")).alias("ids")).collect()}
    for i, text in enumerate(texts):
        assert tok.text(got[i]) == (text or "")
    assert got[0][0] == tok.id_of("<cls>") and got[0][-1] == tok.id_of("<sep>") and got[1] == [tok.id_of("<usr>"), tok.id_of("<sys>")] and got[2] == got[3] == []
    assert 50256 not in got[5] and len(tok) == 50257 + len(TK.MARKS) and len({tok.id_of(m) for m in tok.marks}) == len(tok.marks)
    assert rows.select(F.max(F.size(TK.subword_ids(tok, F.col("text"), 2)))).first()[0] == 2
    model, ids = TK.for_classification(tok, "max", dims=4)
    assert model.vectors.shape[1] == len(tok)
    df = spark.createDataFrame([(f"{'yes' if i % 2 else 'no'} {i}", "x", float(i % 2), "train") for i in range(30)], "da string, utt string, label double, split string")
    trained = FU.train(df, {"m": model.settings}, steps=15, rate=0.3, words=ids)["m"]
    assert FU.predict(df, trained, words=ids).where("prediction <> label").count() == 0


def test_contrastive_gradient_and_training(spark):
    model = EM.Embedder.drawn(buckets=40, dims=6, seed=3)
    r = np.random.default_rng(2)
    one, two = ([r.integers(0, 40, r.integers(1, 5)).tolist() for _ in range(7)] for _ in range(2))
    two[3] = two[5]
    g, loss, n = model.gradient(one, two)
    assert n == 7
    for _ in range(40):
        at, h = (int(r.integers(40)), int(r.integers(6))), 1e-6
        ends = []
        for s in (h, -h):
            v = model.vectors.copy()
            v[at] += s
            ends.append(EM.replace(model, vectors=v).gradient(one, two)[1])
        assert abs((ends[0] - ends[1]) / (2 * h) - g[at]) < 1e-4
    rows = spark.createDataFrame([(i // 3, a, b) for i, (a, b) in enumerate(zip(one[:6], two[:6]))], "group int, one array<int>, two array<int>").repartition(3)
    got, mean, n = EM.summed(rows, model)
    parts = [model.gradient(one[i : i + 3], two[i : i + 3]) for i in (0, 3)]
    assert n == 6 and np.allclose(got, sum(p[0] for p in parts) / 6) and abs(mean - sum(p[1] for p in parts) / 6) < 1e-9

    slots = ["price", "food", "area", "day", "people", "stars", "time", "name", "train", "hotel"]
    pair = lambda i: (f"i want the {slots[i % 10]} w{i}", f"inform {slots[i % 10][::-1]} now", "train" if i // 10 % 5 else "test")
    df = spark.createDataFrame([pair(i) for i in range(200)] + [(None, "x", "train"), ("x", "", "train")], "utt string, acts string, split string")
    trained, losses = EM.train(df.where("split = 'train'"), steps=12, rate=0.05)
    assert losses[-1] < 0.5 * losses[0]
    held = EM.embedded(EM.embedded(df.where("split = 'test'"), trained, "utt", "u"), trained, "acts", "a").toPandas()
    u, a = np.stack(held["u"]), np.stack(held["a"])
    s, same = u @ a.T, np.array([[x == y for y in held["acts"]] for x in held["acts"]])
    assert all(s[i][same[i]].min() > s[i][~same[i]].max() for i in range(len(s)))
    tokens = EM.embedded(df.where("split = 'test'").select(F.monotonically_increasing_id().alias("i"), F.lit(1).alias("g"), "utt"), trained, "utt").select("g", "i", "vec")
    acts = EM.embedded(df.where("split = 'test'").select("acts").distinct().select(F.monotonically_increasing_id().alias("j"), F.lit(1).alias("g"), "acts"), trained, "acts").select("g", "j", "vec")
    assert M.match_corpus(tokens, acts, ["g"]).select("i").distinct().count() == tokens.count()
    drawn, none = EM.train(df.where("false"))
    assert none == [] and np.array_equal(drawn.vectors, EM.Embedder.drawn().vectors)


def test_clouds_hold_every_phrase_and_none_overlap():
    phrases = [(f"phrase {'x' * (i % 13)} {i}", float((i * 7) % 31)) for i in range(60)] + [("minus", -3.0), ("none", None)]
    boxes = cloud.layout(phrases)
    assert sorted(b.phrase for b in boxes) == sorted(p for p, _ in phrases)
    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            assert a.x + a.width <= b.x or b.x + b.width <= a.x or a.y + a.height <= b.y or b.y + b.height <= a.y
    weight = dict(phrases)
    sizes = [(max(0.0, weight[b.phrase] or 0.0), b.size) for b in boxes]
    assert sizes == sorted(sizes, reverse=True) and sizes[0][1] == cloud.MOST and sizes[-1][1] == cloud.LEAST
    assert cloud.layout([]) == [] and "<text" not in cloud.svg([]) and "&lt;b&gt;" in cloud.svg([("<b>", 1.0)])


def test_demonstrations_like_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i // 4, 0, i % 4, " ".join(f"w{int(x * x)}" for x in r.integers(1, 9, r.integers(0, 7)))) for i in range(60)] + [(99, 0, 0, None), (98, 0, 0, "unheard")]
    df = spark.createDataFrame(rows, "dia_no long, label int, pos int, text string").repartition(4)
    got = nlu.demonstrations(df, df, ["dia_no", "label", "pos"], ["dia_no"], k=2, listed=10**6)
    held = {row[:3]: set((row[3] or "").split()) for row in rows}
    df_of = {w: sum(w in ws for ws in held.values()) for ws in held.values() for w in ws}
    for key, ws in held.items():
        asked = sorted(ws, key=lambda w: (df_of[w], w))[: nlu.ASKED]
        best = sorted((round(sum(1 / df_of[w] for w in asked if w in o), 9) for k, o in held.items() if k[0] != key[0] and any(w in o for w in asked)), reverse=True)[:2]
        own = got.where(f"dia_no = {key[0]} and pos = {key[2]}").orderBy("rank").collect() if key[0] in (0, 3, 7, 98, 99) else None
        assert own is None or [x["score"] for x in own] == best
    few = nlu.demonstrations(df, df, ["dia_no", "label", "pos"], ["dia_no"], k=50, listed=3)
    assert few.groupBy("dia_no", "label", "pos").count().agg(F.max("count")).first()[0] <= 3 * nlu.ASKED


class Flaky:
    """Raises, answers nonsense, or answers; counts how many calls run at once."""

    def __init__(self):
        self.lock, self.now, self.most, self.seen = threading.Lock(), 0, 0, {}

    def chat(self, prompt):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.seen[prompt] = self.seen.get(prompt, 0) + 1
            nth = self.seen[prompt]
        time.sleep(0.002)
        with self.lock:
            self.now -= 1
        n = int(prompt)
        if n % 5 == 0 and nth == 1:
            raise OSError("no answer")
        if n % 7 == 0:
            return "<DA>[[1]]</DA>"
        return f'sure <DA>[["inform", "a", "b", "{prompt}-{self.most <= 3}"]]</DA>'


def test_extraction_is_bounded_and_repeated(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(150)], "i int, prompt string").repartition(2)
    got = {r["i"]: r for r in nlu.extract(df, ["i"], Flaky, at_once=3, tries=3).collect()}
    assert len(got) == 150
    for i, r in got.items():
        if i % 7 == 0:
            assert not r["ok"] and r["acts"] == [] and r["calls"] == 3
        else:
            assert r["ok"] and r["acts"] == [["inform", "a", "b", f"{i}-True"]] and r["calls"] == 1 + (i % 5 == 0)
    assert nlu.parsed("<DA>[]</DA>") == [] and nlu.parsed("<DA>x</DA>") is None and nlu.parsed(None) is None


def test_groups_are_gathered_once_for_all_passes(spark, monkeypatch):
    model, plans, put = EM.Embedder.drawn(64, 4), [], None
    rows = spark.createDataFrame([(i // 3, [i % 7, i], [i + 1]) for i in range(12)], "group int, one array<int>, two array<int>")
    want, grouped, put = EM.summed(rows, model), EM.gathered(rows).persist(), type(rows).toPandas
    monkeypatch.setattr(type(rows), "toPandas", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or put(self))
    got = EM.summed(grouped, model)
    assert np.allclose(got[0], want[0]) and got[1] == pytest.approx(want[1]) and got[2] == 12
    assert plans[0].split("InMemoryTableScan")[0].count("Exchange") == 1  # gradients by parameter row
    grouped.unpersist()
