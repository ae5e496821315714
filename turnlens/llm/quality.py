"""Quality by random-indexing word vectors and a two-layer network.

A text is read as runs of letters, digits or signs: its words. Every word has a sparse random index vector (a few +1 and -1),
which follows from a hash of the word alone. A word's vector is the sum of the index vectors around its occurrences,
gathered over all documents. The ``WORDS`` most frequent words, by counts over all documents, have vectors of their own; all
other words share the vectors of ``BUCKETS`` classes, by their hash, but still give their neighbours index vectors of their
own. Each task adds up its partition into one table of bounded size, and the tables are summed by word. A document is pooled as
the mean of its words' unit vectors, with damped counts. A network with one hidden layer, trained in numpy on the labelled
sample, gives a logit; a temperature chosen on labelled rows that training leaves out makes it a probability.

Labels are learned from a bounded sample: at most ``most`` distinct texts of each class. Word vectors need no labels and
cover all documents. Texts are read whole.

Defined cases: a null or blank text is pooled as zeros; without labels of both classes every score is the share of
labels that are 1 (0 without any label); repeated rows score alike; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, collected, held_out, mapped, mix64, most_frequent, slices, table
from .toxicity import sample

#: Words with vectors of their own, classes of the others, dimensions, entries of an index vector, and words to either side.
WORDS, BUCKETS, DIMS, NONZERO, REACH = 1 << 16, 1 << 13, 32, 4, 2
#: Texts that are pooled at once, and bytes of texts that a task looks at together.
AT_ONCE, PART_BYTES = 512, 2 << 20
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 5e-3, 1e-4
MOST_ROWS = 20_000
#: Classes of bytes: 0 white space, 1 letters (and all bytes of other scripts), 2 digits, 3 signs.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of the texts, and the text of each run. Runs are hashed by a polynomial of their bytes."""
    same = mapped(texts, np.arange(256, dtype=np.uint8))
    offsets = np.frombuffer(same.buffers()[1], np.int64, len(same) + 1)
    raw = np.frombuffer(same.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(same) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = KIND[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    own = kind[start] > 0
    start, end = start[own], end[own]
    with np.errstate(over="ignore"):
        power = np.empty(len(raw) + 1, np.uint64)
        power[0] = 1
        power[1:] = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(power, dtype=np.uint64)
        inverse = np.empty(len(raw) + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        inverse = np.cumprod(inverse, dtype=np.uint64)
        up = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        h = mix64((up[end] - up[start]) * inverse[start])
    return h, np.searchsorted(offsets, start, "right") - 1


def places(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The row of each word in the table of vectors: its own, if it is one of ``words`` (sorted hashes), after those of the classes."""
    i = np.searchsorted(words, h).clip(max=max(0, len(words) - 1))
    own = words[i] == h if len(words) else np.zeros(len(h), bool)
    return np.where(own, BUCKETS + i, (h & np.uint64(BUCKETS - 1)).astype(np.int64))


def add_contexts(total: np.ndarray, place: np.ndarray, h: np.ndarray, text: np.ndarray) -> None:
    """Adds to the flat table [place][dim] the index vectors of each run's neighbours within the same text."""
    entries = []
    for k in range(NONZERO):  # each entry has bits of the word's hash of its own
        bits = mix64(h + np.uint64(k + 1))
        entries.append(((bits % np.uint64(DIMS)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)))
    for step in range(1, REACH + 1):
        same = text[step:] == text[:-step]
        a, b = np.flatnonzero(same), np.flatnonzero(same) + step
        for who, near in ((a, b), (b, a)):
            at = place[who] * DIMS
            for dim, sign in entries:
                np.add.at(total, at + dim[near], sign[near])


def frequent_words(scratch: Scratch, texts: DataFrame, most: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of all texts, ``most`` at most, of those that occur twice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                h, n = np.unique(runs(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = scratch.keep(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "counted")
    return np.sort(collected(most_frequent(counted, "n", most).select("h"))["h"].to_numpy(np.int64).view(np.uint64))


@dataclass
class Vectors:
    """Unit vectors of the classes, then of the words (sorted hashes)."""

    words: np.ndarray
    table: np.ndarray


def word_vectors(docs: DataFrame, most: int = WORDS) -> Vectors:
    """Unit vectors from all documents; a class that no document has stays zero."""
    scratch = Scratch(docs.sparkSession, "quality")
    texts = docs.select(docs["text"]).where(docs["text"].isNotNull())
    words = frequent_words(scratch, texts, most)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        known, size = sent.value, (BUCKETS + len(sent.value)) * DIMS
        total = np.zeros(size)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                h, text = runs(part.column("text"))
                add_contexts(total, places(h, known), h, text)
        rows = total.reshape(-1, DIMS).astype(np.int32)
        own = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[own, d])) for d in range(DIMS))], ["place", *(f"d{d}" for d in range(DIMS))])

    tables = texts.mapInArrow(run, "place int, " + ", ".join(f"d{d} int" for d in range(DIMS)))
    summed = collected(tables.groupBy("place").agg(*[F.sum(f"d{d}").cast("float").alias(f"d{d}") for d in range(DIMS)]))
    out = np.zeros((BUCKETS + len(words), DIMS), np.float32)
    out[summed["place"].to_numpy()] = summed.drop(columns="place").to_numpy(np.float32)
    scratch.drop()
    return Vectors(words, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9))


def pool(texts: pa.Array, vectors: Vectors) -> np.ndarray:
    """Of each text: its words' mean vector, counts damped, and the logarithm of its number of words."""
    h, text = runs(texts)
    size = len(vectors.table)
    key, counts = np.unique(text * size + places(h, vectors.words), return_counts=True)
    who, damped = key // size, np.sqrt(counts)
    n = np.bincount(text, minlength=len(texts))
    out = np.zeros((len(texts), DIMS))
    first = np.flatnonzero(np.diff(who, prepend=-1))
    if len(first):
        out[who[first]] = np.add.reduceat(damped[:, None] * vectors.table[key % size], first, axis=0)
    weight = np.bincount(who, weights=damped, minlength=len(texts))
    return np.hstack([out / np.maximum(weight, 1)[:, None], np.log1p(n)[:, None]])


def pooled_parts(batches, vectors: Vectors):
    for batch in batches:
        for part in slices(batch, "text", PART_BYTES):
            for low in range(0, part.num_rows, AT_ONCE):
                few = part.slice(low, AT_ONCE)
                yield few, pool(few.column("text"), vectors)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - mean) / scale
        p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(max(EPOCHS, min(600, 200_000 // len(z)))):
            order = rng.permutation(len(z))
            for low in range(0, len(z), 256):
                i = order[low : low + 256]
                h = np.maximum(z[i] @ p[0] + p[1], 0)
                error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
                back = np.outer(error, p[2]) * (h > 0)
                grads = [z[i].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ error + DECAY * p[2], error.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss, from a grid of ratios."""
        z = self.logit(x)
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -z, z) / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 16, 97), key=loss))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, most: int = MOST_ROWS) -> tuple[Vectors, Network] | float:
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def look(batches):
        for few, x in pooled_parts(batches, sent.value):
            yield pa.RecordBatch.from_arrays([few.column("y"), few.column("fold"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))], ["y", "fold", "x"])

    seen = collected(sample(docs, labels, label, modulus, most).mapInArrow(look, "y int, fold int, x array<double>"))
    seen["fit"] = seen["fold"] > 0
    if seen["y"].nunique() < 2 or seen.loc[seen["fit"], "y"].nunique() < 2:
        return float(seen["y"].mean()) if len(seen) else 0.0
    order = np.lexsort(np.stack(seen["x"].to_numpy()).T)  # rows arrive in any order
    x, y, fit = np.stack(seen["x"].to_numpy())[order], seen["y"].to_numpy(float)[order], seen["fit"].to_numpy(bool)[order]
    network = Network.fit(x[fit], y[fit])
    if (~fit).any():
        network.calibrate(x[~fit], y[~fit])
    return vectors, network


def score(docs: DataFrame, model: tuple[Vectors, Network] | float, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document."""
    own = docs.select(docs["doc_id"], docs["text"])
    if isinstance(model, float):
        return own.select("doc_id", F.lit(model).alias("score"), F.lit(int(model >= threshold)).cast("int").alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors, network = sent.value
        for few, x in pooled_parts(batches, vectors):
            p = network.score(x)
            yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")
