"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary documents, share their lowest level and score each word with its
boundaries. Words enter with the number of distinct documents that hold them, so a word that one document repeats weighs
once. Higher levels use counts of their class, lower levels continuation counts (how many different bytes precede a
gram), and every level mixes a few observations of both classes together into each, so that rare expressions lean on what
the classes share. Each class gives every byte after every context a probability, with its own back-off where training has
not seen the gram; a word's evidence is the difference of its two log-likelihoods. A document's evidence is that difference
normalised by its length in words: over all words, over those with clear evidence, and for the strongest word, as an insult
in a long text is as toxic as in a short one. A logistic curve turns evidence into a probability; it is fitted on evidence
that each labelled document gets from counts without its own fold.

Labels are learned from a bounded sample: of the allowed rows, about ``MOST_ROWS`` distinct texts of each class, by a hash of
the text. Texts are read whole, in training and scoring alike, and the models keep every gram of the sample: its rows
alone bound what the driver gets and sends.

Defined cases: a null or wordless text has no evidence and gets the score of that; without labels of both classes every
score is the share of toxic labels (0 without any label); repeated rows score alike, and equal texts of a class are one in
the sample; labels that are null or repeated with different values are left out; rows that share an id with other texts are
labelled alike; very long texts are read whole, a bounded part of them at a time; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_table, collected, held_out, slices, table, words_of

#: Bytes of the longest gram (boundaries count), Kneser-Ney's discount, rows of each class in the sample, and folds.
ORDER, DISCOUNT, MOST_ROWS, FOLDS = 8, 0.75, 6_000, 4
#: Observations of both classes together that each class's distribution after a context is mixed with.
SHARED = 30.0
#: Evidence of a word beyond which it counts by itself.
CLEAR = 2.0
#: Bytes of texts that a task looks at together.
PART_BYTES = 3 << 20
BEGIN, END = 1, 2
LETTERS = byte_table(keep=lambda b: b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122 or b == 39)


def word_types(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, each text's words as their indexes, and where each text's begin."""
    flat, at = words_of(texts, LETTERS)
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), at


def windows(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every bounded word but its beginning: the word, and the last up to ORDER bytes as one number
    with their count."""
    words = words.cast(pa.large_string())
    if words.offset:
        words = pa.concat_arrays([words])
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    data = words.buffers()[2]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(words)), size + 2)
    first = np.cumsum(size + 2) - (size + 2)
    pos = np.arange(len(word)) - first[word]
    byte = np.zeros(len(word), np.uint64)
    byte[pos == 0] = BEGIN
    byte[pos == size[word] + 1] = END
    byte[(pos > 0) & (pos <= size[word])] = raw
    key, shifted = byte.copy(), byte
    for k in range(1, ORDER):
        shifted = np.concatenate([np.zeros(1, np.uint64), shifted[:-1]])
        key |= np.where(pos >= k, shifted << np.uint64(8 * k), np.uint64(0))
    own = pos > 0
    return word[own], key[own], np.minimum(pos[own] + 1, ORDER)


def mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * k) - 1)


def sizes(key: np.ndarray) -> np.ndarray:
    """Bytes of each gram; none of them is zero."""
    return np.searchsorted(np.array([1 << 8 * k for k in range(ORDER)], np.uint64), key, side="right").astype(np.int8)


@dataclass
class Model:
    """Per order: sorted grams with their probabilities (toxic, ordinary, both together) after their context, and sorted
    contexts with what an unseen byte keeps of the level below: own shares of both classes, what either takes of the common
    distribution, and that distribution's share."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float

    def probabilities(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """[byte][class]: probability of the last byte of each window after those before it, by the longest gram that training
        saw, and from there up by each class's back-off after every longer context that training saw."""
        p = np.full((len(key), 3), self.unseen, np.float64)
        level, todo = np.zeros(len(key), np.int8), np.arange(len(key))
        for k in range(len(self.grams) - 1, 0, -1):
            grams, prob = self.grams[k]
            if not len(grams) or not len(todo):
                continue
            g = key[todo] & mask(k)
            i = np.searchsorted(grams, g).clip(max=len(grams) - 1)
            hit = (size[todo] >= k) & (grams[i] == g)
            p[todo[hit]], level[todo[hit]] = prob[i[hit]], k
            todo = todo[~hit]
        for k in range(2, len(self.grams)):
            contexts, share = self.contexts[k]
            up = np.flatnonzero((level < k) & (size >= k))
            if not len(contexts) or not len(up):
                continue
            c = (key[up] >> np.uint64(8)) & mask(k - 1)
            i = np.searchsorted(contexts, c).clip(max=len(contexts) - 1)
            hit = contexts[i] == c
            up, own = up[hit], share[i[hit]]
            both = p[up, 2]
            p[up, 0], p[up, 1], p[up, 2] = own[:, 0] * p[up, 0] + own[:, 2] * both, own[:, 1] * p[up, 1] + own[:, 3] * both, own[:, 4] * both
        return p[:, :2]

    def likelihoods(self, words: pa.Array) -> np.ndarray:
        """[word][class]: log-likelihoods of the words, their ends included."""
        word, key, size = windows(words)
        logs = np.log(self.probabilities(key, size))
        return np.stack([np.bincount(word, weights=logs[:, c], minlength=len(words)) for c in (0, 1)], axis=1)

    def evidence(self, words: pa.Array) -> np.ndarray:
        """Of each word the difference of its two log-likelihoods."""
        both = self.likelihoods(words)
        return both[:, 0] - both[:, 1]


def levels(key: np.ndarray, size: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> dict:
    """For each length its sorted grams and their counts by class, from counts of the longest grams, which may repeat.
    Grams shorter than ORDER begin a word."""
    order, level = ORDER, {}
    for k in range(order, 0, -1):
        own = size == k
        g, counts = key[own], [toxic[own], plain[own]]
        if k < order:  # continuation counts: different grams of the level above that end in this one, by class
            g = np.concatenate([g, level[k + 1][0] & mask(k)])
            counts = [np.concatenate([c, up > 0]) for c, up in zip(counts, level[k + 1][1])]
        by = np.argsort(g)
        g = g[by]
        first = np.flatnonzero(np.diff(g, prepend=~g[:1]))
        level[k] = (g[first], [np.add.reduceat(c[by].astype(np.int64), first).astype(np.int32) if len(first) else np.empty(0, np.int32) for c in counts])
    return level


def fit(key: np.ndarray, size: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> Model:
    return smoothed(levels(key, size, toxic, plain))


def smoothed(level: dict) -> Model:
    """The model from ``levels``, which this empties. Columns of one class are held at a time, as the driver has little room."""
    order, grams, contexts = ORDER, {}, {}
    who, total = level.pop(1)
    mass = float(total[0].sum()) + float(total[1].sum()) + 256
    shared = (total[0].astype(float) + total[1] + 1) / mass
    prob = [shared, shared, shared]
    grams[1] = (who, np.stack(prob, axis=1).astype(np.float32))
    for k in range(2, order + 1):
        lower_who, lower_prob = who, prob
        who, total = level.pop(k)
        low = np.searchsorted(lower_who, who & mask(k - 1)).astype(np.int32)
        new = np.diff(who >> np.uint64(8), prepend=~(who[:1] >> np.uint64(8))) != 0
        first, at = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)

        def after(count, lower):
            mass, kinds = (np.add.reduceat(x.astype(float), first) if len(first) else np.empty(0) for x in (count, count > 0))
            back = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1), 1.0)
            out = np.maximum(count - DISCOUNT, 0)
            out /= np.maximum(mass, 1)[at]
            out += back[at] * lower[low]
            return out, mass, back

        (pooled, _, common), prob, shares = after(total[0] + total[1], lower_prob[2]), [], [[], []]
        for x in (0, 1):
            own, mass_of, back = after(total[x], lower_prob[x])
            own *= mass_of[at]
            own += SHARED * pooled
            own /= (mass_of + SHARED)[at]
            prob.append(own)
            shares[0].append(mass_of * back / (mass_of + SHARED))
            shares[1].append(SHARED * common / (mass_of + SHARED))
        prob.append(pooled)
        grams[k] = (who, np.stack([p.astype(np.float32) for p in prob], axis=1))
        contexts[k] = (who[first] >> np.uint64(8), np.stack([s.astype(np.float32) for s in (*shares[0], *shares[1], common)], axis=1))
    nothing = (np.empty(0, np.uint64), np.empty(0, np.float32))
    return Model([nothing, *[grams[k] for k in range(1, order + 1)]], [nothing, nothing, *[contexts[k] for k in range(2, order + 1)]], 1 / mass)


def features(model: Model, texts: pa.Array) -> np.ndarray:
    """Of each text: the mean evidence of its words, the strongest word's, and the mean of what words have above
    ``CLEAR``, over its length and over the length's root (a mean's noise falls with the root)."""
    types, index, at = word_types(texts)
    own = model.evidence(types)[index] if len(index) else np.empty(0)
    n = np.diff(at)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    most = np.zeros(len(texts))
    if len(own):
        most[n > 0] = np.maximum.reduceat(own, at[:-1][n > 0])
    above = total(np.maximum(own - CLEAR, 0))
    return np.stack([total(own) / np.maximum(n, 1), most, np.log1p(100 * above / np.maximum(n, 1)), np.log1p(10 * above / np.sqrt(np.maximum(n, 1)))], axis=1)


@dataclass
class Curve:
    """Logistic regression over scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> "Curve":
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        for _ in range(rounds):  # Newton's method, halved where it overshoots
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
            w = w + np.clip(step, -2, 2)
        return Curve(mean, scale, w)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, most: int) -> DataFrame:
    """text, label y (0 or 1) and fold of the bounded sample: distinct texts, about ``most`` of each class at most."""
    agreed = labels.where(labels["doc_id"].isNotNull() & labels[label].isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("y")).where("low = y").select("doc_id", "y")
    chosen = docs.select(docs["doc_id"], docs["text"]).where(docs["text"].isNotNull() & ~held_out(docs["doc_id"], modulus))
    rows = chosen.select("doc_id", F.xxhash64("text").alias("h")).join(agreed, "doc_id")
    firsts = rows.groupBy("y", "h").agg(F.min("doc_id").alias("doc_id"))
    counts = {r["y"]: r["n"] for r in firsts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    wanted = None
    for y, n in counts.items():
        share = min(1.0, most / n)
        own = firsts.where((F.col("y") == y) & (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20)))) if share < 1 else firsts.where(F.col("y") == y)
        wanted = own if wanted is None else wanted.unionByName(own)
    if wanted is None:
        return chosen.select("text", F.lit(0).alias("y"), F.lit(0).alias("fold")).limit(0)
    wanted = wanted.select("doc_id", "h", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(FOLDS)).cast("int").alias("fold"))
    return chosen.withColumn("h", F.xxhash64("text")).join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("text", "y", "fold")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, most: int = MOST_ROWS) -> tuple[Model, Curve] | float:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(sample(docs, labels, label, modulus, most), "sample")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                types, index, at = word_types(part.column("text"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(at))
                once = np.unique(doc * len(types) + index) if len(index) else index
                y, fold = np.asarray(part.column("y")), np.asarray(part.column("fold"))
                kind = (2 * fold + 1 - y)[once // max(1, len(types))]
                word, key, _ = windows(types)
                code, where = np.unique(key, return_inverse=True)
                for v in range(2 * FOLDS):
                    times = np.bincount((once % max(1, len(types)))[kind == v], minlength=len(types))
                    sums = np.bincount(where, weights=times[word], minlength=len(code)).astype(np.int64)
                    own = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(code[own].view(np.int64)), pa.array(np.full(len(own), v, np.int8)), pa.array(sums[own])], ["key", "kind", "n"])

    # One row for each fold and class that has a gram: most have one, so the driver gets a third of what a column for each would take.
    counted = rows.mapInArrow(count, "key long, kind byte, n long")
    grams = counted.groupBy("key", "kind").agg(F.sum("n").cast("int").alias("n")).toArrow()
    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        scratch.drop()
        return float(next(iter(kinds), 0))
    key, kind, n = grams["key"].to_numpy().view(np.uint64), grams["kind"].to_numpy(), grams["n"].to_numpy()
    del grams
    pa.default_memory_pool().release_unused()
    size = sizes(key)
    by_class = lambda own: levels(key[own], size[own], np.where(kind[own] % 2 == 0, n[own], 0), np.where(kind[own] % 2 == 1, n[own], 0))
    parts = []
    for f in range(FOLDS):  # one after the other: the driver and its tasks hold one fold's model at a time
        sent = rows.sparkSession.sparkContext.broadcast(smoothed(by_class(kind // 2 != f)))

        def look(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, "text", PART_BYTES):
                    x = features(sent.value, part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("y"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))], ["y", "x"])

        parts.append(collected(rows.where(F.col("fold") == f).select("text", "y").mapInArrow(look, "y int, x array<double>")))
        sent.destroy()
    scratch.drop()
    seen = pd.concat([part for part in parts if len(part)])
    x = np.stack(seen["x"].to_numpy())
    order = np.lexsort(x.T)  # rows arrive in any order
    level = by_class(slice(None))
    del key, kind, n, size
    return smoothed(level), Curve.fit(x[order], seen["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: tuple[Model, Curve] | float, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of ``keep``, score and predicted (under ``names``) of every document."""
    spark = docs.sparkSession
    own = docs.select(*[docs[c] for c in dict.fromkeys([*keep, "text"])])
    kinds = dict(own.dtypes)
    if isinstance(model, float):
        return own.select(*keep, F.lit(model).alias(names[0]), F.lit(int(model >= threshold)).cast("int").alias(names[1]))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                kn, curve = sent.value
                p = curve.score(features(kn, part.column("text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, *names])

    return own.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"{names[0]} double, {names[1]} int"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")
