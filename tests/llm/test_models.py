import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnlens.llm import lm_scoring as L
from turnlens.llm import quality as Q
from turnlens.llm import toxicity as T

from .conftest import messy_rows, prose


def out_of(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus == 2


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(700):
        toxic, good = i % 5 == 0, i % 3 > 0
        words = prose(i, r.randrange(20, 120)).split()
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(r.randrange(len(words)), "zuk" + r.choice(["el", "ar", "ito", "onda", f"i{r.choice('abcdef')}"]))
        text = " ".join(words) if good else " ".join(w + r.choice(["###", "$$$", "!!"]) for w in words)
        docs.append((i, text, 1.5))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000 + i, t, 0.5) for i, t, *_ in messy_rows()]
    labels += [(1000, 1, None), (1001, None, 1), (3, 1, 0), (3, 1, 0), (5, 1, 0), (5, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,threshold", [(T, "toxic", 0.3), (Q, "quality", 0.7)])
def test_held_out_accuracy(labelled, module, label, threshold):
    docs, labels = labelled
    out = module.score(docs, module.train(docs, labels, label), threshold).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= threshold)).all()
    truth = labels.where("doc_id < 700 and doc_id not in (3, 5)").toPandas().set_index("doc_id")[label]
    own = out[out["doc_id"].isin(truth.index) & out["doc_id"].map(lambda i: out_of(i, 4))].set_index("doc_id")
    assert (own["predicted"] == truth.loc[own.index]).mean() > 0.95
    same = out[out["doc_id"].isin([1010, 1011])]["score"]
    assert same.nunique() == 1
    assert module.score(docs.where("false"), module.train(docs, labels, label), threshold).count() == 0


@pytest.mark.parametrize("module,label", [(T, "toxic"), (Q, "quality")])
def test_labels_of_held_out_rows_do_not_matter_and_one_class_is_a_constant(labelled, module, label):
    docs, labels = labelled
    assert module.train(docs, labels.where("false"), label) == 0.0
    assert module.train(docs, labels.where(f"{label} = 1 and doc_id < 700"), label) == 1.0
    out = module.score(docs, 1.0, 0.5).toPandas()
    assert (out["score"] == 1).all() and (out["predicted"] == 1).all()
    from pyspark.sql import functions as F
    from turnlens.llm.common import held_out

    other = labels.withColumn(label, F.when(held_out(F.col("doc_id"), 4), 1 - F.col(label)).otherwise(F.col(label)).cast("int"))
    pick = lambda ls: module.score(docs, module.train(docs, ls, label)).toPandas().sort_values(["doc_id", "score"])["score"].to_numpy()
    assert np.allclose(pick(labels), pick(other))


def kneser_ney(words, order=T.ORDER, d=T.DISCOUNT, shared=T.SHARED):
    """Straight from the definition: words (text, toxic, ordinary) to p(class, context, byte)."""
    grams = [Counter(), Counter()]  # of each class: the last up to ``order`` bytes before and with every byte
    for text, *times in words:
        raw = bytes([T.BEGIN]) + text.encode() + bytes([T.END])
        for i in range(1, len(raw)):
            for c in (0, 1):
                grams[c][raw[max(0, i + 1 - order) : i + 1]] += times[c]
    levels = {order: [Counter({g: n for g, n in x.items() if len(g) == order}) for x in grams]}
    for k in range(order - 1, 0, -1):
        levels[k] = [Counter({g: n for g, n in x.items() if len(g) == k}) for x in grams]
        for c in (0, 1):
            for g, n in levels[k + 1][c].items():
                levels[k][c][g[1:]] += n > 0

    def level(counts, context, byte, lower):
        own = {g: n for g, n in counts.items() if g[:-1] == context and n > 0}
        mass = sum(own.values())
        return (max(own.get(context + byte, 0) - d, 0) / mass + d * len(own) / mass * lower if mass else lower), mass

    def p(c, context, byte):
        """c: 0 toxic, 1 ordinary, 2 both together."""
        k = len(context) + 1
        both = levels[k][0] + levels[k][1]
        if k == 1:
            return (both[byte] + 1) / (sum(both.values()) + 256)
        if c == 2:
            return level(both, context, byte, p(2, context[1:], byte))[0]
        own, mass = level(levels[k][c], context, byte, p(c, context[1:], byte))
        return (mass * own + shared * p(2, context, byte)) / (mass + shared)

    return p


def test_kneser_ney_probabilities_sum_to_one_and_follow_the_definition():
    given = [("abc", 3, 1), ("abd", 0, 2), ("ab", 1, 1), ("b", 0, 4), ("abcabcabcabc", 2, 0), ("xyz", 0, 1)]
    word, key, size = T.windows(pa.array([w for w, *_ in given]))
    code, first, where = np.unique(key, return_index=True, return_inverse=True)
    times = [np.bincount(where, weights=np.array([g[c] for g in given])[word]).astype(np.int64) for c in (1, 2)]
    model, p = T.fit(code, size[first].astype(np.int8), *times), kneser_ney(given)
    begin = bytes([T.BEGIN])
    for context in (begin, begin + b"a", begin + b"ab", b"bcabcab", b"abcabca", b"qqqqqqq", begin + b"q", b"zabcabc"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        got = model.probabilities(keys, np.full(256, len(context) + 1))
        assert np.allclose(got.sum(axis=0), 1, atol=1e-5)
        for b in b"abcqxz\x02":
            assert np.allclose(got[b], [p(c, context, bytes([b])) for c in (0, 1)], rtol=1e-5), (context, b)
    for text in ("abc", "abx", "new", "é", "", "abcabcabcabcabd"):
        raw = begin + text.encode() + bytes([T.END])
        want = [sum(math.log(p(c, raw[max(0, i + 1 - T.ORDER) : i], raw[i : i + 1])) for i in range(1, len(raw))) for c in (0, 1)]
        assert np.allclose(model.likelihoods(pa.array([text]))[0], want, rtol=1e-4)


def test_runs_are_hashed_by_their_bytes():
    h, text = Q.runs(pa.array(["ab ab!!12", "", "ab", "x" * 5 + " ab"]))
    assert text.tolist() == [0, 0, 0, 0, 2, 3, 3] and h[0] == h[1] == h[4] == h[6] and len(set(h.tolist())) == 4


def test_word_vectors_and_pools_like_brute_force(spark):
    """Frequent words have vectors of their own, the others share those of their classes; every neighbour counts as itself."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "b", "c", "d", "e", f"rare{r.randrange(200)}"]) + r.choice(["", "!", " 7"]) for _ in range(r.randrange(0, 40))) for _ in range(80)] + [None, "", "a"]
    vectors = Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), most=6)
    read = lambda t: [int(x) for x in Q.runs(pa.array([t or ""]))[0]]
    counts = Counter(h for t in texts for h in read(t))
    least = next(n for n in range(2, 10_000) if sum(c >= n for c in counts.values()) <= 6)
    words = sorted(h for h, c in counts.items() if c >= least)
    assert vectors.words.tolist() == words and 3 <= len(words) <= 6
    place = lambda h: Q.BUCKETS + words.index(h) if h in words else h % Q.BUCKETS

    def index(h):
        out = np.zeros(Q.DIMS)
        for k in range(Q.NONZERO):
            bits = int(Q.mix64(np.array([(h + k + 1) % 2**64], np.uint64))[0])
            out[bits % Q.DIMS] += 1 if bits >> 63 else -1
        return out

    total = np.zeros((Q.BUCKETS + len(words), Q.DIMS))
    for t in texts:
        own = read(t)
        for i, h in enumerate(own):
            for j in range(max(0, i - Q.REACH), min(len(own), i + Q.REACH + 1)):
                total[place(h)] += index(own[j]) if i != j else 0
    unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors.table, unit, atol=1e-5)
    pooled = Q.pool(pa.array(texts, pa.string()), vectors)
    for t, got in zip(texts, pooled):
        held = Counter(map(place, read(t)))
        weight = sum(math.sqrt(n) for n in held.values())
        want = sum((math.sqrt(n) * unit[i] for i, n in held.items()), np.zeros(Q.DIMS)) / max(1.0, weight)
        assert np.allclose(got, [*want, math.log1p(len(read(t)))], atol=1e-5)


def small_hmm(states, symbols, seed):
    r = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return L.Hmm(norm(r.random(states), 0), norm(r.random((states, states)), 1), norm(r.random((symbols, states)), 0))


def test_forward_is_exact():
    m = small_hmm(3, 4, 1)
    seqs = [np.array(s) for s in ([0], [1, 2], [3, 3, 0, 1], [2, 0, 1])]
    want = []
    for s in seqs:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[x, b]
            total += p
        want.append(math.log10(total))
    assert np.allclose(L.likelihood(m, seqs), want)
    assert np.isfinite(L.likelihood(m, [np.zeros(5000, int)])).all()


def test_expected_counts_of_mixed_lengths_are_exact_by_runs_of_steps():
    r = np.random.default_rng(4)
    m = small_hmm(3, 5, 4)
    seqs = [r.integers(0, 5, n) for n in (4, 1, 6, 4, 2, 6, 1, 3)]
    got = L.Expected(3, 5)
    got.add(m, seqs)
    start, move, emit, log = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for s in seqs:
        ways = list(itertools.product(range(3), repeat=len(s)))
        p = np.array([m.start[w[0]] * np.prod([m.move[a, b] for a, b in zip(w, w[1:])]) * np.prod([m.emit[x, k] for x, k in zip(s, w)]) for w in ways])
        log += np.log(p.sum())
        for w, share in zip(ways, p / p.sum()):
            start[w[0]] += share
            for a, b in zip(w, w[1:]):
                move[a, b] += share / m.move[a, b]
            for x, k in zip(s, w):
                emit[x, k] += share
    assert np.allclose(got.start, start) and np.allclose(got.move, move) and np.allclose(got.emit, emit) and np.isclose(got.log, log)
    flat, at, _ = L.lined_up(seqs)
    assert L.runs(at) == [(0, 8, 1), (8, 14, 1), (14, 19, 1), (19, 23, 1), (23, 27, 2)]
    alphas, scale, emits = L.forward(m, flat, at)
    assert [a.shape for a in alphas] == [(1, 3, 8), (1, 3, 6), (1, 3, 5), (1, 3, 4), (2, 3, 2)] and all(np.allclose(a.sum(axis=1), 1) for a in alphas)
    assert np.isclose(np.log(scale).sum(), log) and all(e.shape == a.shape for e, a in zip(emits, alphas))


def test_baum_welch_does_not_lower_the_likelihood():
    r = np.random.default_rng(3)
    seqs = [r.integers(0, 3, r.integers(1, 40)) + 3 * (i % 2) for i in range(60)]
    shares = np.full(6, 1 / 6)
    m = small_hmm(2, 6, 2)
    before = L.likelihood(m, seqs).sum()
    for _ in range(6):
        e = L.Expected(2, 6)
        for g in L.grouped(seqs, 100):
            e.add(m, [seqs[i] for i in g])
        assert e.emit.sum() == pytest.approx(sum(map(len, seqs)))
        m = e.model(m, shares)
    assert L.likelihood(m, seqs).sum() > before
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_scores(spark, messy, nothing, monkeypatch):
    monkeypatch.setattr(L, "VOCABULARY", 40)
    out = L.score(messy, vocabulary=40).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = sorted(((i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]) for i, t, *_ in messy_rows()), key=lambda x: (x[0], len(x[1])))
    counts = Counter(w for i, ws in docs if not out_of(i, 7) for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert out["doc_id"].tolist() == [i for i, _ in docs] and out["n_tokens"].tolist() == [len(w) for _, w in docs]
    assert (out["train_tokens"] == n).all() and out["held_out"].tolist() == [out_of(i, 7) for i, _ in docs]
    assert out["n_known"].tolist() == [sum(counts[w] > 0 for w in ws) for _, ws in docs]
    assert np.allclose(out["base_score"], [sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) for _, ws in docs])
    assert np.isfinite(out["score"]).all() and (out["score"] < 0).all()
    assert L.score(nothing).count() == 0


def test_scores_are_the_probabilities_of_the_model(spark, monkeypatch):
    """Forward sums without scaling, word by word, under the model that training ended with; and the same scores for rows in
    other partitions and another order."""
    r = random.Random(4)
    rows = [(i, " ".join(f"{'abcd'[i % 4]}{r.randrange(12)}" + (str(r.randrange(400)) if r.random() < 0.2 else "") for _ in range(r.randrange(0, 25)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models, real = [], L.Expected.model
    monkeypatch.setattr(L.Expected, "model", lambda self, *a: (models.append(real(self, *a)), models[-1])[1])
    out = L.score(docs.repartition(2), vocabulary=30).toPandas().set_index("doc_id")["score"]
    m = models[-1]
    words = {i: t.split() for i, t in rows}
    counts = Counter(w for i, ws in words.items() if not out_of(i, 7) for w in ws)
    every = sorted({w for ws in words.values() for w in ws})
    code = {w: int(h) for w, h in zip(every, L.word_hashes(pa.array(every)))}
    least = next(n for n in range(2, 1000) if sum(c >= n for c in counts.values()) <= 30)
    symbols = sorted(code[w] for w, c in counts.items() if c >= least)
    inside = Counter()
    for w, c in counts.items():
        if c < least:
            inside[code[w] % L.CLASSES, "n"] += c
            inside[code[w] % L.CLASSES, "v"] += 1
    assert len(m.emit) == 1 + L.CLASSES + len(symbols) and np.allclose(m.emit.sum(axis=0), 1)
    for i, ws in words.items():
        a = m.start
        for k, w in enumerate([*ws, None]):
            if w is None:
                e = m.emit[L.END]
            elif code[w] in symbols:
                e = m.emit[1 + L.CLASSES + symbols.index(code[w])]
            else:
                c = code[w] % L.CLASSES
                e = m.emit[1 + c] * (counts[w] + 1) / (inside[c, "n"] + inside[c, "v"] + 1)
            a = (a @ m.move if k else a) * e
        assert out[i] == pytest.approx(math.log10(a.sum()), rel=1e-9), i
    again = L.score(docs.orderBy("text").repartition(7), vocabulary=30).toPandas().set_index("doc_id")["score"]
    assert np.allclose(again.loc[out.index], out, rtol=1e-6)


def test_scores_without_training_rows(spark):
    ids = [i for i in range(400) if out_of(i, 7)][:5]
    out = L.score(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).toPandas()
    assert (out["n_known"] == 0).all() and (out["train_tokens"] == 0).all() and np.allclose(out["base_score"], 0) and np.isfinite(out["score"]).all()


def test_rare_grams_stay_in_the_toxicity_model(spark):
    r = random.Random(9)
    name = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [" ".join(name(9) for _ in range(1000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model, _ = T.train(docs, labels)
    used = [w for i, t in enumerate(texts) if not out_of(i, 4) for w in t.split()]
    _, key, size = T.windows(pa.array(used))
    want = np.unique(key[size == T.ORDER])
    assert len(want) > 90_000 and np.isin(want, model.grams[T.ORDER][0]).all()


def test_every_baum_welch_round_covers_whole_training_texts_until_the_gain_is_small(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"{'ab'[i % 2]}{w % 7}" for w in range(2500 if i < 4 else 60))) for i in range(40)], "doc_id long, text string").repartition(3)
    real, seen = L._expectation, []

    def spy(rows, model):
        seen.append(real(rows, model))
        return seen[-1]

    monkeypatch.setattr(L, "_expectation", spy)
    monkeypatch.setattr(L, "begin", lambda *a, begin=L.begin: (seen.clear(), begin(*a))[1])
    monkeypatch.setattr(L.Expected, "add", lambda *a: pytest.fail("rounds run on the driver"))
    n = L.score(docs).first()["train_tokens"]
    assert len(seen) > 2 and all(e.emit.sum() == pytest.approx(n) for e in seen)
    gains = [(b.log - a.log) / abs(b.log) for a, b in zip(seen, seen[1:])]
    assert gains[-1] <= L.GAIN and all(g > L.GAIN for g in gains[:-1])


def test_the_driver_gets_grams_of_toxicity_by_the_folds_that_have_them(spark, monkeypatch):
    got, whole = [], type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: got.append(whole(self)) or got[-1])
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(40)), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    T.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    grams = next(x for x in got if "key" in x.column_names)
    assert len(set(grams["key"].to_pylist())) > 5_000
    assert grams.nbytes < 24 * len(set(grams["key"].to_pylist()))  # a column for each fold and class took 44 a gram


def test_sizes_of_grams_follow_from_their_bytes():
    _, key, size = T.windows(pa.array(["a", "ab", "house", "stonehouses", "\u00e9t\u00e9"]))
    assert T.sizes(key).tolist() == size.tolist()
